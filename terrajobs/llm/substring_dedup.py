"""Repeated passages by content-defined chunks.

A gear rolling hash over the last 16 bytes ends a chunk wherever its top bits are zero, so
chunk borders depend on nearby bytes only and an insertion moves none but its own. Chunks
are deduplicated by digest. In a text, each run of chunks that occurs earlier is extended
byte by byte against its first occurrence, to the passage's real ends. Extended runs that
touch or overlap form a repeated passage if together they are long enough, and are cut out.

Two passes keep wide data out of shuffles: the first counts 64-bit digests, the second
chunks the texts again and sends on only what passes a filter of fixed size over the
digests that occur more than once. The filter may pass more; grouping by the 128-bit digest
decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from terrajobs.llm import bytescan as B
from terrajobs.llm.common import narrowed, released, small_batches, split_by_ids
from terrajobs.storage import discard, stash

SMALLEST = 16  # bytes; also the reach of the rolling hash
LARGEST = 512
BORDER_BITS = 5
MIN_BYTES = 128
FILTER_BITS = 26
PART = 64  # bytes of the pieces that wider contexts are compared by
GEAR = (B.BYTE_CODE >> np.uint64(13)).astype(np.uint32)


def borders(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends of all chunks, first chunk of each row and the total)."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        older = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += older
    may = (h >> np.uint32(32 - BORDER_BITS)) == 0
    may[:-1] &= (data[1:] & 0xC0) != 0x80
    spots = np.flatnonzero(may) + 1
    at = np.searchsorted(spots, offsets)
    ends, first = [], [0]
    for r in range(len(offsets) - 1):
        last, stop = int(offsets[r]), int(offsets[r + 1])
        for p in [*spots[at[r] : at[r + 1]].tolist(), stop]:
            while p - last > LARGEST:
                cut = last + LARGEST
                while cut > last + SMALLEST and data[cut] & 0xC0 == 0x80:
                    cut -= 1
                ends.append(cut)
                last = cut
            if p - last >= SMALLEST or p == stop and p > last:
                ends.append(p)
                last = p
        first.append(len(ends))
    return np.array(ends, np.int64), np.array(first, np.int64)


def _chunked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for a, _, data, offsets in B.slices(batch.column("text")):
        if not len(data):
            continue
        end, first = borders(data, offsets)
        count = np.diff(first)
        start = np.empty_like(end)
        start[1:] = end[:-1]
        start[first[:-1][count > 0]] = offsets[:-1][count > 0]
        yield a, data, offsets, start, end, np.repeat(np.arange(len(count)), count), B.span_hashes(data, start, end)


def repeated_digests(documents: DataFrame) -> DataFrame:
    """(short): 64-bit digests of chunks that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, h in _chunked(batch):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["short"])

    return documents.select("text").mapInArrow(released(run), "short long").groupBy("short").agg(F.count("*").alias("n")).filter("n > 1").select("short")


def digest_filter(digests: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit table over the digests' low ``bits`` bits: 2**bits / 8 bytes, packed by block
    where the digests are, so that is all that reaches the driver."""
    block = min(15, bits)
    low = F.col("short").bitwiseAND(F.lit((1 << bits) - 1))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << block, bool)
        flags[pdf["slot"].to_numpy(np.int64) & ((1 << block) - 1)] = True
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    rows = digests.select(low.alias("slot")).distinct().withColumn("block", F.shiftright("slot", block)).groupBy("block").applyInPandas(packed, "block long, bits binary").collect()
    table, size = np.zeros(1 << (bits - 3), np.uint8), 1 << (block - 3)
    for r in rows:
        table[r.block * size : (r.block + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return table


def likely_repeats(documents: DataFrame, table: np.ndarray, bits: int) -> DataFrame:
    """(doc_id, version, k, start, stop, digest) of the chunks that pass the filter."""
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for a, data, offsets, start, end, row, h in _chunked(batch):
                slot = h & np.uint64((1 << bits) - 1)
                hit = np.flatnonzero((table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
                if not len(hit):
                    continue
                digest = [hashlib.blake2b(data[s:e].tobytes(), digest_size=16).digest() for s, e in zip(start[hit].tolist(), end[hit].tolist(), strict=True)]
                source = pa.array(row[hit] + a)
                base = offsets[:-1][row[hit]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(source), batch.column("version").take(source), pa.array(start[hit] - base), pa.array(end[hit] - base), pa.array(digest, pa.binary())],
                    names=["doc_id", "version", "start", "stop", "digest"],
                )

    return documents.mapInArrow(released(run), "doc_id long, version long, start long, stop long, digest binary")


def _joined_runs(spans: Column, least: int) -> Column:
    """Touching or overlapping spans, sorted by start, joined; those of at least ``least`` bytes stay."""
    kind = "array<struct<start:long,stop:long>>"
    merged = F.aggregate(
        spans,
        F.expr(f"cast(array() as {kind})"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= x["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return F.filter(merged, lambda x: x["stop"] - x["start"] >= least)


def _context(runs: DataFrame, documents: DataFrame, doc: str, version: str, start: str, stop: str, width: int, name: str) -> DataFrame:
    """``runs`` with the ``width`` bytes before and after one of their places."""
    texts = narrowed(documents, "doc_id", runs, doc).select(F.col("doc_id").alias("_d"), F.col("version").alias("_v"), F.col("text").cast("binary").alias("_data"))
    before = f"substring(_data, cast(greatest({start} - {width}, 0) + 1 as int), cast(least({start}, {width}) as int)) as {name}_before"
    after = f"substring(_data, cast({stop} + 1 as int), {width}) as {name}_after"
    return runs.join(texts, (F.col(doc) == F.col("_d")) & (F.col(version) == F.col("_v"))).selectExpr(*runs.columns, before, after)


def _agreeing(a: bytes, b: bytes) -> int:
    """How many bytes two strings begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


@F.pandas_udf(StructType([StructField("before", IntegerType()), StructField("after", IntegerType()), StructField("more", BooleanType())]))
def _common(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, before: pd.Series, after: pd.Series, width: pd.Series) -> pd.DataFrame:
    """Equal bytes at the ends of a and b and at the starts of c and d, whole characters only,
    and the ``before`` and ``after`` ones that were left out as equal."""
    out = []
    for p, q, x, y, i, j, w in zip(a, b, c, d, before, after, width, strict=True):
        n, m = _agreeing(p[::-1], q[::-1]), _agreeing(x, y)
        more = n + i == w or m + j == w
        while n and p[-n] & 0xC0 == 0x80:
            n -= 1
        while m and any(m < len(z) and z[m] & 0xC0 == 0x80 for z in (x, y)):
            m -= 1
        out.append((n + i, m + j, more))
    return pd.DataFrame(out, columns=["before", "after", "more"])


def _near_change(both: DataFrame, width: int) -> DataFrame:
    """``both`` with only the part of each context around the first difference, and how many
    equal bytes (skip_before, skip_after) were left out next to the run. Whole contexts stay in
    Spark, where their pieces are compared; a piece and two characters on both sides go to Python."""
    part = max(PART, min(width // PART, PART * PART))

    def skipped(x: str, y: str, first: str, second: str) -> str:
        pieces = f"least(length({x}), length({y})) div {part}"
        alike = f"transform(sequence(1L, {pieces}), k -> {first} = {second})"
        return f"if({pieces} = 0, 0L, greatest(coalesce(nullif(array_position({alike}, false), 0L) - 1, {pieces}) * {part} - 8, 0L))"

    last = lambda c: f"substring({c}, cast(length({c}) - k * {part} + 1 as int), {part})"
    next_ = lambda c: f"substring({c}, cast((k - 1) * {part} + 1 as int), {part})"
    sides = ["later_before", "first_before", "later_after", "first_after"]
    both = both.withColumn("skip_before", F.expr(skipped(*sides[:2], *map(last, sides[:2])))).withColumn("skip_after", F.expr(skipped(*sides[2:], *map(next_, sides[2:]))))
    held = part + 16
    for c in sides[:2]:
        both = both.withColumn(c, F.expr(f"substring({c}, cast(greatest(length({c}) - skip_before - {held}, 0) + 1 as int), cast(least(length({c}) - skip_before, {held}) as int))"))
    for c in sides[2:]:
        both = both.withColumn(c, F.expr(f"substring({c}, cast(skip_after + 1 as int), {held})"))
    return both


def extended(runs: DataFrame, documents: DataFrame, width: int = 64) -> DataFrame:
    """(doc_id, version, start, stop) of ``runs`` (doc_id, version, start, stop, first_doc,
    first_version, shift), as far as both texts agree. Wider contexts are read for the runs
    that agree up to the end of theirs, until none does."""
    keys, parts = runs.columns, []
    while True:
        later = _context(runs, documents, "doc_id", "version", "start", "stop", width, "later")
        both = _context(later, documents, "first_doc", "first_version", "start + shift", "stop + shift", width, "first")
        if width > PART:
            both = _near_change(both, width)
        else:
            both = both.withColumns({"skip_before": F.lit(0), "skip_after": F.lit(0)})
        found = both.withColumn("e", _common("later_before", "first_before", "later_after", "first_after", "skip_before", "skip_after", F.lit(width)))
        found = stash(found.select(*keys, "e"), "extended")
        parts.append(found.filter("not e.more").selectExpr("doc_id", "version", "start - e.before as start", "stop + e.after as stop"))
        runs = found.filter("e.more").select(*keys)
        if not runs.limit(1).count():
            break
        width *= 8
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def repeated_spans(documents: DataFrame, min_bytes: int = MIN_BYTES, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, version, spans): byte spans of later repeated passages, per text with any."""
    twice = stash(repeated_digests(documents), "digests")
    chunks = stash(likely_repeats(documents, digest_filter(twice, bits), bits).distinct(), "chunks")
    discard(twice)
    place = F.struct("doc_id", "version", "start")
    first = chunks.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    later = chunks.join(first, "digest").filter(place != F.col("first"))
    side = ["doc_id", "version", F.col("first.doc_id").alias("first_doc"), F.col("first.version").alias("first_version"), (F.col("first.start") - F.col("start")).alias("shift")]
    runs = later.groupBy(*side).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    runs = runs.select("doc_id", "version", "first_doc", "first_version", "shift", F.explode(_joined_runs(F.col("spans"), 1)).alias("x"))
    runs = stash(runs.select("doc_id", "version", "x.start", "x.stop", "first_doc", "first_version", "shift"), "runs")
    whole = extended(runs, documents).filter(F.col("stop") - F.col("start") >= min_bytes)  # each a copy of one earlier place; spans of several say nothing together
    spans = whole.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    return spans.select("doc_id", "version", _joined_runs(F.col("spans"), 1).alias("spans"))


def dedup_substrings(documents: DataFrame, min_bytes: int = MIN_BYTES, bits: int = FILTER_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, removed_chars, spans): every row's text without later repeated passages.

    A passage is repeated where it holds a chunk and its bytes occur earlier, in order of (id, position), in
    another text or further up in the same one, and it has ``min_bytes`` there in one piece. ``spans`` are the cut code points, ends
    exclusive. Null texts stay null; empty texts and rows of a null id stay as they are.
    Rows of equal id and text count as one document. Other columns are not read.
    """
    rows = small_batches(documents).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = rows.filter("doc_id is not null and text is not null").withColumn("version", F.xxhash64("text"))
    found = stash(repeated_spans(base, min_bytes, bits), "spans").select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version"), F.col("spans").alias("_spans"))
    hit, rest = split_by_ids(rows, "doc_id", found, "_doc")
    joined = hit.join(found, (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_version")), "left").select("doc_id", "text", "_spans")
    kind = "array<struct<start:long,stop:long>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed, places = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("_spans"), strict=True):
                data, at, parts, cuts, chars = (text.as_py() or "").encode(), 0, [], [], 0
                for span in spans.as_py() or []:
                    parts.append(data[at : span["start"]])
                    chars += len(data[at : span["start"]].decode())
                    n = len(data[span["start"] : span["stop"]].decode())
                    cuts.append({"start": chars, "stop": chars + n})
                    chars, at = chars + n, span["stop"]
                parts.append(data[at:])
                texts.append(None if not text.is_valid else b"".join(parts).decode())
                removed.append(sum(c["stop"] - c["start"] for c in cuts))
                places.append(cuts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(removed, pa.int64()), pa.array(places, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                names=["doc_id", "text", "removed_chars", "spans"],
            )

    done = joined.mapInArrow(released(cut), f"doc_id long, text string, removed_chars long, spans {kind}")
    return done.unionByName(rest.select("doc_id", "text", F.lit(0).cast("long").alias("removed_chars"), F.expr(f"cast(array() as {kind})").alias("spans")))
