"""Periodic runs of words, from a dictionary of basic factors.

A run is a stretch of words in which words ``period`` apart are equal, repeated at least
``exponent`` times, and which neither neighbour extends. For every power of two the factors
of that many words are named, a factor's name being the pair of the names of its halves.
Where a factor's next occurrence follows within twice its length, and the one after it at the
same distance, the three stand in arithmetic progression and propose that distance as a
period. Neighbouring progressions of one distance are one proposal; it is extended word by
word, and what several lengths propose is taken once.

A run of period p and 4 * p words or more is always proposed, by factors of p to 2 * p words:
inside it the next occurrence of such a factor is p words on, never nearer, since a nearer one
would give a shorter period. Factors met once in a text are left out of all longer ones, so
texts without repetition cost little more than naming their words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrajobs.llm import bytescan as B
from terrajobs.llm.common import released, small_batches

EXPONENT = 4
MIN_WORDS = 6
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dense names of the keys, which of them occur more than once)."""
    _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
    return name, count[name] > 1


def find_runs(keys: np.ndarray, row: np.ndarray, min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> np.ndarray:
    """(start, length, period) of every run, by start and period, in words of several texts.

    ``keys`` name the words, equal for equal words of one text and different between texts;
    ``row`` numbers the texts in ascending order.
    """
    if exponent < 4:
        raise ValueError("shorter repetitions than of four periods need not be proposed")
    name, again = _named(keys)
    word = name
    at, name = np.flatnonzero(again), name[again]
    size, found = 1, []
    while len(at):
        order = np.argsort(name, kind="stable")
        gap = np.zeros(len(at), np.int64)
        same = name[order][1:] == name[order][:-1]
        gap[order[:-1][same]] = at[order[1:][same]] - at[order[:-1][same]]
        gap[gap > 2 * size] = 0
        breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(gap) != 0)) + 1
        first, last = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(at)]])
        period = gap[first]
        proposed = (period > 0) & (last - first > period)  # at least three terms
        period = period[proposed]
        found.append(np.stack([at[first[proposed]], at[last[proposed] - 1] + size + period, period], axis=1))
        known = np.full(len(word), -1)
        known[at] = name
        at = at[at + size < len(word)]
        at = at[(known[at + size] >= 0) & (row[at] == row[at + size])]
        if not len(at):
            break
        name, again = _named(known[at] * (known.max() + 1) + known[at + size])
        at, name, size = at[again], name[again], 2 * size
    runs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)
    runs = _extended(runs, word, row)
    runs = np.unique(runs[runs[:, 1] >= np.maximum(min_words, exponent * runs[:, 2])], axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _extended(runs: np.ndarray, word: np.ndarray, row: np.ndarray) -> np.ndarray:
    """(start, end, period) to (start, length, period), grown as far as the period holds."""
    start, end, period = runs.T.copy()
    for place, step in ((start, -1), (end, 1)):
        moving = np.arange(len(place))
        while len(moving):
            new = place[moving] + min(step, 0)
            twin = new - step * period[moving]
            inside = (new >= 0) & (new < len(word))
            moving, new, twin = moving[inside], new[inside], twin[inside]
            holds = (word[new] == word[twin]) & (row[new] == row[twin])
            moving = moving[holds]
            place[moving] += step
    return np.stack([start, end - start, period], axis=1)


def periodic_runs(documents: DataFrame, min_words: int = MIN_WORDS, exponent: int = EXPONENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row.

    Words are runs of characters other than ASCII white space, numbered from 0. ``runs`` is
    an array of (start, length, period) by start, then period: maximal stretches of smallest
    period ``period`` and at least ``min_words`` and ``exponent`` (4 or more) periods.
    ``collapsed`` has the words that no run contains after its first ``period`` words, joined
    by single spaces. Null, empty and blank texts have no words, no runs and an empty
    ``collapsed``. Rows are independent of each other: repeated rows give repeated results,
    null ids stay null, texts of any length are taken whole, and an empty table gives an empty
    result. Other columns are not read, whatever their names. Words are compared by 64-bit
    hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in B.slices(batch.column("text")):
                start, end, first = B.words(data, offsets)
                row = np.repeat(np.arange(b - a), np.diff(first))
                runs = find_runs(B.mix(B.span_hashes(data, start, end) ^ B.mix(row.astype(np.uint64))), row, min_words, exponent)
                edge = np.zeros(len(start) + 1, np.int64)
                np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
                np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
                kept = np.cumsum(edge)[:-1] == 0
                raw, texts = data.tobytes(), []
                for r in range(b - a):
                    lo, hi = first[r], first[r + 1]
                    s, e = start[lo:hi][kept[lo:hi]].tolist(), end[lo:hi][kept[lo:hi]].tolist()
                    texts.append(b" ".join([raw[x:y] for x, y in zip(s, e, strict=True)]))
                own = row[runs[:, 0]] if len(runs) else np.empty(0, np.int64)
                at = np.searchsorted(own, np.arange(b - a + 1)).astype(np.int32)
                listed = pa.StructArray.from_arrays([pa.array(runs[:, 0] - first[own]), pa.array(runs[:, 1].copy()), pa.array(runs[:, 2].copy())], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(at), listed), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    rows = small_batches(documents).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: str = "runs") -> Column:
    """The run of greatest length / period, compared exactly; the first on ties."""
    better = "best is null or r.length * best.period > best.length * r.period"
    return F.expr(f"aggregate({runs}, cast(null as struct<start:bigint,length:bigint,period:bigint>), (best, r) -> if({better}, r, best))")


def planted(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with repetition planted into a tenth of the documents, by their ids.

    With h the crc32 of the decimal id and g = h div 10: where h mod 10 is 0 and there are
    n > 0 words, each word i from a = g mod n on becomes word a + (i - a) mod p, p being
    1 + (n - a) div (3 + g mod 8), and the words are joined by single spaces. Other texts,
    and those of null ids, stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                h = 1 if doc is None else zlib.crc32(b"%d" % doc)
                words = text.as_py().split() if h % 10 == 0 and text.is_valid else []
                if not words:
                    texts.append(text.as_py())
                    continue
                g, n = h // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                repeated = words[a : a + p]
                texts.append(b" ".join(words[:a] + [repeated[i % p] for i in range(n - a)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    rows = small_batches(documents).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, text string")


def digests(documents: DataFrame) -> DataFrame:
    """The digest form over planted documents: the strongest run and hashes of all."""
    found = periodic_runs(planted(documents)).withColumn("best", strongest())
    listed = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\\n'), '')")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
