"""Benchmark passages in training texts, by spaced seeds.

Each mask samples a window of words at fixed places and ignores the others, so windows
still meet if words at ignored places differ. Training windows whose hash passes a filter
of the benchmark's hashes are joined with them, and each meeting is verified along its
diagonal with substitutions allowed, ``RADIUS`` words to each side; what meets is joined. The filter has a fixed number of bits whatever the
benchmark's size; when it fills up, more windows reach the join, which decides alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrajobs.llm import bytescan as B
from terrajobs.llm.common import released, small_batches, without_ids
from terrajobs.storage import stash

# The masks, 1 for a word that counts.
MASKS = ("11111111", "1101100110111", "11101001010111", "110010101101011")
RADIUS = 40
FILTER_BITS = 21
MIN_WORDS = 13
MIN_SHARE = 80
ABSENT_DOC, ABSENT_ITEM = 0, 1  # stand for words before the first and after the last one


def masked_hashes(word: np.ndarray, first: np.ndarray, mask: str, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first word) of all of a mask's windows that lie inside one row."""
    span = len(mask)
    count = len(word) - span + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.full(count, tag, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            h = h * np.uint64(0xD6E8FEB86659FD93) + word[k : k + count]
    inside = np.ones(count, bool)
    for k in range(1, span):
        edge = first[1:-1] - k
        inside[edge[(edge >= 0) & (edge < count)]] = False
    at = np.flatnonzero(inside)
    return B.mix(h[at]), at


def _context(word: np.ndarray, lo: int, hi: int, at: int, absent: int) -> bytes:
    out = np.full(2 * RADIUS, absent, np.uint64)
    a, b = max(lo, at - RADIUS), min(hi, at + RADIUS)
    out[a - at + RADIUS : b - at + RADIUS] = word[a:b]
    return out.tobytes()


def windows(texts: DataFrame, absent: int, bits: list[np.ndarray] | None = None) -> DataFrame:
    """(id, hash, place, context) of every masked window, or of those that pass the filter."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            column = batch.column("text")
            for a, _, data, offsets in B.slices(column):
                start, end, first = B.words(data, offsets)
                word = B.span_hashes(B.LOWER[data], start, end)
                ids, hashes, places, around = [], [], [], []
                for tag, mask in enumerate(MASKS):
                    h, at = masked_hashes(word, first, mask, tag + 1)
                    if bits is not None:
                        for k, table in enumerate(bits):
                            slot = (h >> np.uint64(FILTER_BITS * k)) & np.uint64((1 << FILTER_BITS) - 1)
                            hit = (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
                            h, at = h[hit == 1], at[hit == 1]
                    rows = np.searchsorted(first, at, side="right") - 1
                    for x, p, r in zip(h.view(np.int64).tolist(), at.tolist(), rows.tolist(), strict=True):
                        ids.append(a + r)
                        hashes.append(x)
                        places.append(p - int(first[r]))
                        around.append(_context(word, int(first[r]), int(first[r + 1]), p, absent))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(ids, pa.int64())), pa.array(hashes, pa.int64()), pa.array(places, pa.int64()), pa.array(around, pa.binary())],
                    names=["id", "hash", "place", "context"],
                )

    return small_batches(texts).mapInArrow(released(run), "id long, hash long, place long, context binary")


def hash_filter(hashes: DataFrame) -> list[np.ndarray]:
    """Three bit tables of 2**21 bits over disjoint parts of the hash; at most 3 * 2**15
    numbers reach the driver."""
    mask = F.lit((1 << FILTER_BITS) - 1)
    parts = F.array(*[F.struct(F.lit(k).alias("part"), F.shiftrightunsigned("hash", FILTER_BITS * k).bitwiseAND(mask).alias("slot")) for k in range(3)])
    rows = (
        hashes.select(F.explode(parts).alias("p"))
        .groupBy("p.part", F.shiftright("p.slot", 6).alias("block"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p.slot").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
        .toPandas()
    )
    tables = [np.zeros(1 << (FILTER_BITS - 6), np.int64) for _ in range(3)]
    for k in range(3):
        own = rows[rows["part"] == k]
        tables[k][own["block"].to_numpy(np.int64)] = own["bits"].to_numpy(np.int64)
    return [t.view(np.uint64) for t in tables]


def _reach(equal: np.ndarray) -> tuple[int, int]:
    """(length, matches) of the best-scoring stretch from the start: 1 a match, -2 a miss."""
    if not len(equal):
        return 0, 0
    score = np.cumsum(np.where(equal, 1, -2))
    best = int(score.argmax())
    return (best + 1, int(equal[: best + 1].sum())) if score[best] > 0 else (0, 0)


def overlap(doc: pd.Series, item: pd.Series) -> pd.DataFrame:
    out = []
    for p, q in zip(doc, item, strict=True):
        p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
        equal = p == q
        n1, m1 = _reach(equal[RADIUS:])
        n0, m0 = _reach(equal[:RADIUS][::-1])
        inside = q != ABSENT_ITEM
        whole = bool(inside.sum() < 2 * RADIUS and (equal & inside).sum() * 100 >= MIN_SHARE * inside.sum())
        out.append((n0, n1, m0 + m1, whole))
    return pd.DataFrame(out, columns=["before", "after", "matches", "whole"]).astype({"before": "int32", "after": "int32", "matches": "int32", "whole": "bool"})


def overlaps(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, words): verified overlaps, the longest of each pair. Stretches of one
    diagonal that meet are one overlap, so its length has no limit.

    Words are lower-cased (A-Z) runs without ASCII white space. An overlap is a stretch on
    one diagonal around a seed in which at least ``MIN_WORDS`` words are equal and make up
    ``MIN_SHARE`` percent, or one in which that share of a whole item shorter than the
    stretch examined is equal. Items of fewer words than the shortest mask match nothing.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("id is not null")
    known = stash(windows(items, ABSENT_ITEM), "seeds")
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    compare = F.pandas_udf(overlap, "struct<before:int,after:int,matches:int,whole:boolean>")
    hits = windows(docs, ABSENT_DOC, hash_filter(known))
    met = (
        hits.select(F.col("id").alias("doc_id"), "hash", F.col("place").alias("dp"), F.col("context").alias("dc"))
        .join(known.select(F.col("id").alias("item_id"), "hash", F.col("place").alias("ip"), F.col("context").alias("ic")), "hash")
        .select("doc_id", "item_id", (F.col("dp") - F.col("ip")).alias("diagonal"), "dp", compare("dc", "ic").alias("o"))
    )
    good = (F.col("o.matches") >= MIN_WORDS) & (F.col("o.matches") * 100 >= (F.col("o.before") + F.col("o.after")) * MIN_SHARE) | F.col("o.whole")
    parts = met.filter(good).select("doc_id", "item_id", "diagonal", (F.col("dp") - F.col("o.before")).alias("lo"), (F.col("dp") + F.col("o.after")).alias("hi")).distinct()
    line = Window.partitionBy("doc_id", "item_id", "diagonal").orderBy("lo", "hi")
    fresh = F.coalesce(F.col("lo") > F.max("hi").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    parts = parts.withColumn("fresh", fresh.cast("int")).withColumn("stretch", F.sum("fresh").over(line))
    stretches = parts.groupBy("doc_id", "item_id", "diagonal", "stretch").agg((F.max("hi") - F.min("lo")).alias("words"))
    return stretches.groupBy("doc_id", "item_id").agg(F.max("words").cast("long").alias("words"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept, n_items, longest, item_ids) for every document: kept if it overlaps no item.

    Null ids and null or empty texts are kept. Rows of one id are judged together. Empty
    tables are allowed on both sides; other columns are not read.
    """
    found = overlaps(documents, benchmark, id_col, text_col).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.max("words").alias("longest"), F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    return (
        documents.select(F.col(id_col).cast("long").alias("doc_id"))
        .join(found, "doc_id", "left")
        .select(
            "doc_id",
            F.col("n_items").isNull().alias("kept"),
            F.coalesce("n_items", F.lit(0)).alias("n_items"),
            F.coalesce("longest", F.lit(0)).alias("longest"),
            F.coalesce("item_ids", F.expr("cast(array() as array<long>)")).alias("item_ids"),
        )
    )


def clean(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that overlap no item of the benchmark."""
    leaks = stash(overlaps(documents, benchmark, id_col, text_col).select("doc_id").distinct(), "leaks")
    return without_ids(documents, id_col, leaks, "doc_id")
