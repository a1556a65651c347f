"""Jaccard join of documents by a blocked sparse product of the document by n-gram matrix.

Entry (x, y) of the product of that matrix with its transpose is the overlap of documents x
and y. The columns, the n-grams, are dealt into blocks by their hashes, and the product is
summed block by block. Two sizes bound how many n-grams two linked documents can differ in;
the number of blocks is chosen by size so that it exceeds that bound, so linked documents
have at least one block with equal entries. Only such blocks are multiplied: a row of a block
is named by a hash of its entries, rows of one name meet in a join, and each meeting adds an
equal block to the pair's count. Pairs are discarded without a look at their other blocks

* when the sizes alone forbid the overlap,
* when the parities of their n-grams in 512 columns differ in more places than the sizes
  allow documents to differ in, and
* when more of their blocks differ than the sizes allow.

None of these can lose a link. What is left is multiplied in full: overlaps are counted on the
whole sets, in groups of bounded size.

Only components are asked for, so pairs inside one are not multiplied. Blocks with many
members are first multiplied by one member alone, the least, then by a central one; links
found join components, and members of different components meet after that only. Documents
of equal sets are one row of the matrix from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrajobs.llm import bytescan as B
from terrajobs.llm.common import released, small_batches
from terrajobs.llm.near_dedup import _measured, _row_shingles, _with_components, confirm
from terrajobs.operators.components import edge_components
from terrajobs.storage import discard, stash

N = 3
PERCENT = 90
PARITY = 512
FEW = 8  # pairs a member, multiplied at once
DRAWN = 4  # members that a central one is chosen by
_WORDS = [f"w{i}" for i in range(PARITY // 64)]
_U = np.uint64


@cache
def levels(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least size, most differences, blocks) of each class of sizes.

    A document links only with ones of its class and of the next larger and smaller. A pair's
    blocks are those of its smaller document's class. There are a few blocks more than
    differences, so that almost every document has enough blocks that are not empty.
    """
    least = [1]
    while least[-1] < 1 << 40:
        least.append(100 * least[-1] // percent + 1)
    most = [(100 - percent) * (b - 1) // percent for b in least[1:]]
    return np.array(least[:-1]), np.array(most), np.array([d + 2 + d // 256 for d in most])


def block_names(values: np.ndarray, row: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, rows, filled) of the blocks of each row's n-grams in its own class of sizes and
    in the next smaller one; ``filled`` counts each row's blocks in its own class that are not
    empty. Rows too small to differ in anything have no blocks. Empty blocks are named only
    for rows with too few others, which meet only rows of that kind through them."""
    least, most, blocks = levels(percent)
    own = np.searchsorted(least, size, side="right") - 1
    names, rows, filled = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.zeros(len(size), np.int64)
    for below in (0, 1):
        level = np.maximum(own - below, 0)
        used = (own >= below) & (most[level] > 0)
        if below:
            used &= percent * size <= 100 * (least[level + 1] - 1)  # some size of that class can be its partner's
        count = np.where(used, blocks[level], 0)
        base = np.concatenate([[0], np.cumsum(count)])
        kept = used[row]
        at = base[:-1][row[kept]] + (B.mix(values[kept] ^ _U(0x5851F42D4C957F2D)) % count[row[kept]].astype(_U)).astype(np.int64)
        total = np.zeros(base[-1], _U)
        np.add.at(total, at, B.mix(values[kept]))
        full = np.bincount(at, minlength=base[-1]) > 0
        of = np.repeat(np.arange(len(size)), count)
        n_full = np.bincount(of[full], minlength=len(size))
        named = full | (n_full <= most[level])[of]
        place = np.arange(base[-1]) - base[:-1][of]
        salt = B.mix((level[of[named]].astype(_U) << _U(40)) + place[named].astype(_U))
        names.append(B.mix(total[named] ^ salt).view(np.int64))
        rows.append(of[named])
        filled = filled if below else n_full
    return np.concatenate(names), np.concatenate(rows), filled


def parities(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """For each row, a bit per hashed column: whether it holds an odd number of n-grams."""
    odd = np.bincount(row * PARITY + (values >> _U(55)).astype(np.int64), minlength=n * PARITY) & 1
    return np.packbits(odd.reshape(n, PARITY).astype(bool), axis=1).view(np.int64)


def features(documents: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, n_shingles, digest of the set, blocks that are not empty, names of blocks, parities) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for values, first in _row_shingles(batch, n):
                m = len(first) - 1
                sets = [np.unique(values[first[r] : first[r + 1]]) for r in range(m)]
                size = np.array([len(s) for s in sets])
                row, values = np.repeat(np.arange(m), size), np.concatenate(sets)
                names, rows, filled = block_names(values, row, size, percent)
                names = names[np.argsort(rows, kind="stable")]
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=m))]).astype(np.int32)
                signs = parities(values, row, m)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, m), batch.column("version").slice(at, m), pa.array(size), pa.array(digest, pa.binary()), pa.array(filled), pa.ListArray.from_arrays(pa.array(ends), pa.array(names)), *(pa.array(np.ascontiguousarray(signs[:, k])) for k in range(len(_WORDS)))],
                    names=["doc_id", "version", "n_shingles", "digest", "filled", "blocks", *_WORDS],
                )
                at += m

    text = F.col(text_col).cast("string")
    rows = small_batches(documents).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, version long, n_shingles long, digest binary, filled long, blocks array<long>, " + ", ".join(f"{w} long" for w in _WORDS))


def _may_link(x: str, y: str, percent: int) -> str:
    """Whether sizes and parities of two rows allow a link; never false for a linked pair."""
    apart = " + ".join(f"bit_count({x}{w} ^ {y}{w})" for w in _WORDS)
    sizes = f"{percent} * greatest({x}n, {y}n) <= 100 * least({x}n, {y}n)"
    return f"{sizes} and {100 + percent} * ({apart}) <= {100 - percent} * ({x}n + {y}n)"


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components that may link. A pair's equal blocks are summed
    over the blocks it meets in; it goes if more differ than its sizes allow."""
    member = ["doc", "n", "filled", "comp", *_WORDS]
    x = rows.filter("comp <> major").select("node", *(F.col(c).alias(f"x_{c}") for c in member))
    y = rows.select("node", "major", *(F.col(c).alias(f"y_{c}") for c in member))
    met = x.join(y, "node").filter(f"x_comp <> y_comp and (y_comp = major or x_doc < y_doc) and {_may_link('x_', 'y_', percent)}")
    ends = met.selectExpr("least(x_doc, y_doc) as a", "greatest(x_doc, y_doc) as b", "if(x_n < y_n, x_filled, y_filled) as filled", "x_n + y_n as both")
    counted = ends.groupBy("a", "b", "both").agg(F.count("*").alias("equal"), F.min("filled").alias("filled"))
    return counted.filter(f"filled - equal <= {100 - percent} * both div {100 + percent}").select("a", "b")


def _with_centre(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): each member with its block's central one, the nearest to a few drawn by hash."""
    drawn = rows.groupBy("node").agg(*(F.min_by(F.struct(*_WORDS), F.struct(F.xxhash64("doc", F.lit(i)), "doc")).alias(f"p{i}") for i in range(DRAWN)))
    away = F.expr(" + ".join(f"bit_count({w} ^ p{i}.{w})" for i in range(DRAWN) for w in _WORDS))
    centre = rows.join(drawn, "node").groupBy("node").agg(F.min_by(F.struct("doc", "n", "comp", *_WORDS), F.struct(away.alias("away"), "doc")).alias("p"))
    met = rows.join(centre, "node").filter(f"comp <> p.comp and {_may_link('', 'p.', percent)}")
    return met.select(F.least("p.doc", "doc").alias("a"), F.greatest("p.doc", "doc").alias("b")).distinct()


def ngram_components(documents: DataFrame, n: int = N, percent: int = PERCENT, few: int = FEW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) for each document.

    Words are lower-cased (A-Z only) runs without ASCII white space; a document's set holds
    its distinct ``n``-word shingles, or its whole word sequence if it has fewer words. Two
    documents link when 100 * intersection >= percent * union (percent over 50), and
    ``component_id`` is the smallest id reachable by links. No link is missed, whatever the
    sizes. Null, empty and blank texts have no set and are linked with nothing. Documents of
    equal sets form a class (``class_id``, its smallest id) that takes part as one. A null id
    has neither. Repeated rows give repeated results; if rows of one id differ, the one
    whose set has the smallest digest stands for the id in links with others. Texts are taken
    whole. An empty table gives an empty result. Extra columns are not read.
    """
    feats = stash(features(documents, n, percent, id_col, text_col), "features")
    known = feats.filter("digest is not null and doc_id is not null")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").alias("doc"), "version")).alias("r"))
    heads = classes.groupBy("r.doc").agg(F.min(F.struct("digest", F.col("r.version").alias("version"))).alias("h")).select("doc", "h.version", "h.digest")
    heads = stash(heads, "heads")
    members = stash(feats.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "class_id"), "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id")), "members")
    named = heads.select("doc", F.col("version").alias("_version"), F.col("digest").alias("_digest"))
    rows = known.withColumnsRenamed({"doc_id": "doc", "n_shingles": "n"}).join(named, "doc").filter("version = _version and digest = _digest").dropDuplicates(["doc"])
    rows = stash(rows.select("doc", "n", "version", "filled", "blocks", *_WORDS), "rows")
    discard(feats, heads)
    sizes = rows.select("doc", "n", "version")
    signs = rows.select("doc", "n", "filled", *_WORDS)
    text = F.col(text_col).cast("string")
    texts = documents.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))

    found: list[DataFrame] = []
    comps = None

    def multiply(pairs: DataFrame) -> None:
        """Count the overlaps of pairs on their whole sets and join the components of links."""
        nonlocal comps
        pairs = stash(pairs.select("a", "b"), "pairs")
        if pairs.limit(1).count():
            found.append(confirm(pairs, sizes, texts, n, percent))
            whole = found[0]
            for part in found[1:]:
                whole = whole.unionByName(part)
            old, comps = comps, edge_components(whole, "a", "b")
            discard(old)
        discard(pairs)

    entries = rows.select(F.explode("blocks").alias("node"), "doc")
    shared = entries.groupBy("node").agg(F.count("*").alias("c"), F.min("doc").alias("first")).filter("c > 1")
    met = stash(entries.join(shared.select("node", "first"), "node"), "met")
    ends = lambda k, c: signs.select(F.col("doc").alias(c), *(F.col(w).alias(f"{k}_{w}") for w in ["n", *_WORDS]))
    first = met.filter("doc <> first").select("first", "doc").distinct().join(ends("x", "first"), "first").join(ends("y", "doc"), "doc")
    multiply(first.filter(_may_link("x_", "y_", percent)).selectExpr("first as a", "doc as b"))

    def still_open(level: DataFrame) -> DataFrame:
        """Rows of blocks whose members are in several components."""
        return _measured(_with_components(level, comps))

    bare = met.select("node", "doc").withColumn("comp", F.col("doc"))
    parts = _with_components(bare, comps).groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("node")
    level = stash(met.select("node", "doc").join(parts, "node", "left_semi").join(signs, "doc").withColumn("comp", F.col("doc")), "level")
    discard(met)
    rest = stash(still_open(level), "open")
    multiply(_with_centre(rest.filter(F.col("cross") > few * F.col("size")), percent))
    old, rest = rest, stash(still_open(level), "open")
    multiply(_across(rest, percent))
    discard(old, rest, level)
    if comps is None:
        out = members.withColumn("component_id", F.coalesce("class_id", "doc_id"))
    else:
        out = members.join(comps, F.col("class_id") == F.col("id"), "left").withColumn("component_id", F.coalesce("component", "class_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", "class_id")
