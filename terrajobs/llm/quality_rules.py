"""Quality rules as a ledger: every rule is evaluated once and leaves a bit.

``ledger`` stores each document's measurements and one long of failure bits. Policies are
versioned sets of rules applied to those bits later, without reading a text again, and
``ablations`` tells from the bits alone what each rule of a policy adds to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrajobs.llm import bytescan as B
from terrajobs.llm.common import small_batches

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_bangs")

# Rule -> (bit, failing condition over the measurements).
RULES = {
    "few_words": (0, "n_words < 20"),
    "repeats": (1, "100 * n_repeat_words > 30 * n_words"),
    "symbols": (2, "100 * n_symbols > 15 * n_words"),
    "upper": (3, "2 * n_upper > word_chars"),
    "bangs": (4, "100 * n_bangs > 40 * n_words"),
    "digits": (5, "100 * n_digits > 50 * word_chars"),
    "word_length": (6, "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)"),
    "dup_lines": (7, "n_lines > 3 and 2 * n_dup_lines > n_lines"),
}
# Version -> rules, any of which rejects.
POLICIES = {
    "v0": ("few_words", "repeats"),
    "v1": ("few_words", "repeats", "symbols", "upper", "bangs", "digits", "word_length", "dup_lines"),
}


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES[r][0] for r in rules)


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _duplicates(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has an equal one in its row, has an earlier equal one in its row) for each value."""
    key = value ^ B.mix(row.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, some = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    some[order[1:]] |= same
    some[order[:-1]] |= same
    return some, later


def _measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n = len(offsets) - 1
    start, end, first = B.words(data, offsets)
    solid = ~B.SPACE[data]
    n_words = np.diff(first)
    chars = _per_row(solid & ((data & 0xC0) != 0x80), offsets)
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    symbols = _per_row(table[data], offsets)
    upper = _per_row((data >= 65) & (data <= 90), offsets)
    digits = _per_row((data >= 48) & (data <= 57), offsets)
    bangs = _per_row(data == 33, offsets)

    breaks = np.flatnonzero(data == 10)
    row_of = lambda at: np.searchsorted(offsets, at, side="right") - 1
    lines = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    lines = lines[lines < len(data)]
    lines = lines[data[lines] != 10]
    stops = np.unique(np.concatenate([offsets[1:], breaks]))
    ends = stops[np.searchsorted(stops, lines, side="right")] if len(lines) else lines
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(solid, out=total[1:])
    full = total[ends] > total[lines]
    lines, ends = lines[full], ends[full]
    at = row_of(lines)
    _, later = _duplicates(at, B.span_hashes(data, lines, ends))
    n_lines, dup = np.bincount(at, minlength=n), np.bincount(at[later], minlength=n)

    word = B.span_hashes(data, start, end)
    repeat = np.zeros(n, np.int64)
    if len(word) >= WINDOW:
        count = len(word) - WINDOW + 1
        h = np.zeros(count, np.uint64)
        for k in range(WINDOW):
            h = h * np.uint64(0xD6E8FEB86659FD93) + word[k : k + count]
        row = np.repeat(np.arange(n), n_words)
        inside = row[:count] == row[WINDOW - 1 :]
        spots = np.flatnonzero(inside)
        some, _ = _duplicates(row[spots], B.mix(h[spots]))
        marks = np.zeros(len(word) + WINDOW, np.int64)
        marks[spots[some] + WINDOW] = 1
        sums = np.cumsum(marks)
        covered = sums[WINDOW:] - sums[:-WINDOW] > 0
        repeat = np.bincount(row[covered], minlength=n)
    return [n_words, chars, symbols, dup, repeat, n_lines, upper, digits, bangs]


def ledger(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the measurements, failed long): a bit of ``failed`` per failing rule.

    A null or empty text has no words and measures 0. One row per input row; columns other
    than the two named are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_measure(data, offsets) for _, _, data, offsets in B.slices(batch.column("text"))]
            columns = [np.concatenate([p[k] for p in parts]) if parts else np.empty(0) for k in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in columns)], names=["doc_id", *MEASURES])

    measured = small_batches(documents).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    )
    bits = None
    for bit, condition in RULES.values():
        one = F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long")
        bits = one if bits is None else bits.bitwiseOR(one)
    return measured.withColumn("failed", bits)


def apply_policy(book: DataFrame, version: str = "v1") -> DataFrame:
    """The ledger with ``kept``: no rule of the policy's version failed."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablations(book: DataFrame, version: str = "v1") -> DataFrame:
    """(version, rule, n_failed, n_only): documents a rule rejects, and those it alone
    rejects, which leaving the rule out would bring back. Read from the bits alone."""
    rules = POLICIES[version]
    counts = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask(rules))).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r][0]).cast("long").alias("bit")) for r in rules]))
    return (
        counts.select("bits", "n", each.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only"),
        )
        .select(F.lit(version).alias("version"), "rule", "n_failed", "n_only")
    )


def verdicts(documents: DataFrame, version: str = "v1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest form: base measurements, base_failed, kept and the failure bits."""
    book = apply_policy(ledger(documents, id_col, text_col), version)
    base = F.col("failed").bitwiseAND(F.lit(mask(POLICIES["v0"]))) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "failed")
