"""Near-duplicate documents: similarity join over word shingles by chosen paths.

Documents are nodes of random trees. At the root of each tree, and below it in every node
that is still large, a document moves to the child named by its minwise shingle under the
node's own hash function, so similar documents tend to take the same path. Small nodes are
compared exhaustively. Several independent trees bring recall to the target: below the root
a document moves to two children, so a pair of similarity s >= 0.5 that shares a root node
stays together in one tree with probability (2 * s - 1) / s^2 or more however deep the tree
is. Ten trees miss a pair at 0.8 about 1e-7 of the time in the first level and 1e-6 at any
depth. Minima are taken over the full shingle sets, never over sketches.

A level has three steps. Nodes with few pairs between different components are compared at
once, and in every other node all members are compared with one central member. The links
found are joined into components. In nodes that still have several, each member's shingles
that no other member of such a node has are counted; they bound its similarity to anything
there, exactly, and members that cannot reach the threshold leave; the others get longer
signatures. Then nodes of middle size
are compared exhaustively, and larger ones go one level deeper.
Nodes still large at the deepest level are compared exhaustively as well, so no pair that
shares a path is left out.

Exhaustive comparison is a join on the node whose condition holds the sizes and 256-bit
(later 2048-bit) minwise signatures, with a margin of four standard deviations (1 in 20,000 pairs exactly at
the threshold falls below it); only likely pairs leave the join. They are confirmed on the
full shingle sets: sets of documents with common partners meet in groups of bounded size,
and a spanning set of links is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrajobs.llm import bytescan as B
from terrajobs.llm.common import narrowed, released, small_batches
from terrajobs.operators.components import edge_components
from terrajobs.storage import discard, stash

BITS = 256
LONG_BITS = 2048  # of documents in nodes that stay open
TREES = 10
DEPTH = 8
BRANCHES = 2
FEW = 12  # pairs a member, compared at once
SMALL_NODE = 4096  # pairs a member, compared once its components are known: dearer levels below are for larger nodes
PIVOTS = 4
BLOCK = 1 << 19  # shingles of the sets that meet in one task


def _words(bits: int = BITS) -> list[str]:
    return [f"w{i}" for i in range(bits // 64)]


def _member(bits: int) -> list[str]:
    return ["doc", "n", "s", "comp", *_words(bits)]


def _row_sets(batch: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    for values, at in _row_shingles(batch, n):
        for r in range(len(at) - 1):
            yield np.unique(values[at[r] : at[r + 1]])


def _row_shingles(batch: pa.RecordBatch, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, _, data, offsets in B.slices(batch.column("text")):
        data = B.LOWER[data]
        start, end, first = B.words(data, offsets)
        yield B.shingles(B.span_hashes(data, start, end), first, n)


def _tree_seeds(trees: int) -> np.ndarray:
    return B.mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def minwise_nodes(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The node that each seed's hash function names: its minwise shingle over the full set.
    Shingles are well mixed already, so an odd multiplier orders them at random."""
    low = np.array([(values * seed).min() for seed in seeds], np.uint64)
    return B.mix(low ^ B.mix(seeds)).view(np.int64)


def child_nodes(values: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The distinct children of ``nodes``, ``BRANCHES`` of each, that a set moves to."""
    salt = np.arange(1, BRANCHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    seeds = B.mix(nodes.view(np.uint64)[:, None] ^ salt[None, :]).ravel() | np.uint64(1)
    return np.unique(minwise_nodes(values, seeds))


def _minima(values: np.ndarray, at: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The least product with each seed over the non-empty rows that start at ``at``."""
    return np.stack([np.minimum.reduceat(values * seed, at) for seed in seeds], axis=1)


def _signatures(values: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """A row of 64-bit words per row: one bit of the minwise shingle under each of ``bits`` orders."""
    out, full = np.zeros((len(at) - 1, bits // 64), np.int64), np.flatnonzero(np.diff(at))
    if len(full):
        seeds = B.mix(np.arange(1, bits + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
        out[full] = np.packbits((B.mix(_minima(values, at[full], seeds)) >> np.uint64(63)).astype(bool), axis=1).view(np.int64)
    return out


def shingle_features(documents: DataFrame, n: int = 4, trees: int = TREES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, n_shingles, digest of the set, root nodes, signature) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _tree_seeds(trees)
        for batch in batches:
            size, digest, nodes, signs = [], [], [], []
            for values, at in _row_shingles(batch, n):
                full = np.flatnonzero(np.diff(at))
                for r in range(len(at) - 1):
                    s = np.unique(values[at[r] : at[r + 1]])
                    size.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                node = np.zeros((len(at) - 1, trees), np.int64)
                if len(full):
                    node[full] = B.mix(_minima(values, at[full], seeds) ^ B.mix(seeds)).view(np.int64)
                nodes.append(node)
                signs.append(_signatures(values, at, BITS))
            nodes = np.concatenate(nodes) if nodes else np.zeros((0, trees), np.int64)
            signs = np.concatenate(signs) if signs else np.zeros((0, BITS // 64), np.int64)
            roots = pa.ListArray.from_arrays(pa.array(np.arange(0, nodes.size + 1, trees, dtype=np.int32)), pa.array(nodes.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("version"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), roots, *(pa.array(np.ascontiguousarray(signs[:, k])) for k in range(BITS // 64))],
                names=["doc_id", "version", "n_shingles", "digest", "nodes", *_words()],
            )

    text = F.col(text_col).cast("string")
    rows = small_batches(documents).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, version long, n_shingles long, digest binary, nodes array<long>, " + ", ".join(f"{w} long" for w in _words()))


def _with_components(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return rows
    return rows.join(comps, F.col("doc") == F.col("id"), "left").withColumn("comp", F.coalesce("component", "doc")).drop("id", "component")


def _measured(level: DataFrame, alone: bool = False) -> DataFrame:
    """Rows of nodes with their node's size, largest component and number of pairs between
    components; nodes of one component are left out. ``alone``: each row has its own."""
    if alone:
        nodes = level.groupBy("node").agg(F.count("*").alias("size"), F.count("*").alias("squares"), F.min("comp").alias("major"), F.min("n").alias("least_n"))
    else:
        parts = level.groupBy("node", "comp").agg(F.count("*").alias("c"), F.min("n").alias("least_n"))
        nodes = parts.groupBy("node").agg(F.sum("c").alias("size"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.max_by("comp", F.struct("c", "comp")).alias("major"), F.min("least_n").alias("least_n"))
    nodes = nodes.selectExpr("node", "size", "(size * size - squares) div 2 as cross", "major", "least_n").filter("cross > 0")
    return level.join(nodes, "node")


def _alike(x: str, y: str, bits: int) -> str:
    """How many bits of two members' signatures agree."""
    return f"({bits} - " + " - ".join(f"bit_count({x}{w} ^ {y}{w})" for w in _words(bits)) + ")"


def _least_alike(percent: int, bits: int) -> int:
    p = (1 + percent / 100) / 2
    return int(bits * p - 4 * (bits * p * (1 - p)) ** 0.5)


def _likely(x: str, y: str, percent: int, bits: int) -> str:
    """Whether members of these sizes, shared parts and signatures may be similar."""
    sizes = f"{percent} * greatest({x}n, {y}n) <= 100 * least({x}n, {y}n)"
    parts = f"{100 + percent} * least({x}s, {y}s) >= {percent} * ({x}n + {y}n)"
    return f"{x}comp <> {y}comp and {sizes} and {parts} and {_alike(x, y, bits)} >= {_least_alike(percent, bits)}"


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _pairs_across(rows: DataFrame, percent: int, bits: int, once: bool = False) -> DataFrame:
    """Likely pairs of a node's members of different components: its members outside the
    largest component against all. ``once``: a pair that meets in several of these nodes is
    taken in the least of them, so large groups of similar documents do not repeat their
    pairs in every tree."""
    member, first = _member(bits), "true"
    if once:
        held = rows.groupBy("doc").agg(*(F.first(c).alias(c) for c in member if c != "doc"), F.collect_list(F.struct("node", "major")).alias("at"))
        rows = held.select(*member, F.col("at.node").alias("nodes"), F.explode("at").alias("here")).select("here.*", "nodes", *member)
        member, first = [*member, "nodes"], "array_min(array_intersect(x_nodes, y_nodes)) = node"
    a = rows.filter("comp <> major").select("node", *(F.col(c).alias(f"x_{c}") for c in member))
    b = rows.select("node", "major", *(F.col(c).alias(f"y_{c}") for c in member))
    likely = f"(y_comp = major or x_doc < y_doc) and {_likely('x_', 'y_', percent, bits)} and {first}"
    return a.join(b, "node").filter(likely).select(_ordered("x_doc", "y_doc"))


def _pairs_with_centre(rows: DataFrame, percent: int, bits: int) -> DataFrame:
    """Each member with its node's central one: the most alike to a few members drawn by hash."""
    member = F.struct(*_member(bits))
    drawn = rows.groupBy("node").agg(*(F.min_by(F.struct(*_words(bits)), F.struct(F.xxhash64("doc", F.lit(i)), "doc")).alias(f"p{i}") for i in range(PIVOTS)))
    likeness = F.expr(" + ".join(_alike("", f"p{i}.", bits) for i in range(PIVOTS)))
    centre = rows.join(drawn, "node").groupBy("node").agg(F.max_by(member, F.struct(likeness, -F.col("doc"))).alias("p"))
    met = rows.join(centre, "node").filter(_likely("", "p.", percent, bits))
    return met.select(_ordered("p.doc", "doc"))


def _texts(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """Texts of the rows (doc, version, ...) of ``ids``; wide rows of others are dropped before the shuffle."""
    return narrowed(documents, "doc", ids, "doc").join(ids, ["doc", "version"])


def shared_parts(ids: DataFrame, documents: DataFrame, n: int) -> DataFrame:
    """(doc, alone): how many shingles of each document (doc, version) no other one of ``ids`` has."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, values in zip(batch.column("doc").to_pylist(), _row_sets(batch, n), strict=True):
                if len(values):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), doc)), pa.array(values.view(np.int64))], names=["doc", "shingle"])

    own = _texts(ids, documents).select("doc", "text").mapInArrow(released(sets), "doc long, shingle long")
    single = own.groupBy("shingle").agg(F.min("doc").alias("doc"), F.max("doc").alias("last")).filter("doc = last")
    return single.groupBy("doc").agg(F.count("*").alias("alone"))


def long_signatures(ids: DataFrame, documents: DataFrame, n: int, bits: int = LONG_BITS) -> DataFrame:
    """(doc, signature) of the documents (doc, version) of ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = np.concatenate([_signatures(values, at, bits) for values, at in _row_shingles(batch, n)] or [np.zeros((0, bits // 64), np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(np.ascontiguousarray(signs[:, k])) for k in range(bits // 64))], names=["doc", *_words(bits)])

    return _texts(ids, documents).select("doc", "text").mapInArrow(released(run), "doc long, " + ", ".join(f"{w} long" for w in _words(bits))).dropDuplicates(["doc"])


def confirm(pairs: DataFrame, sizes: DataFrame, documents: DataFrame, n: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join the same documents as all pairs with 100 * intersection >=
    percent * union of their full sets do.

    ``sizes`` has (doc, n, version). Pairs meet at the smallest id among their ends and
    the partners of these, so stars and cliques of pairs need each set once. Homes share tasks' groups of about
    ``block`` shingles; a larger home is split into blocks, with a group for each pair of
    blocks. A pair whose ends are joined already is passed over.
    """
    sides = pairs.union(pairs.select("b", "a")).toDF("doc", "other")
    near = stash(sides.groupBy("doc").agg(F.least("doc", F.min("other")).alias("home")).join(sizes, "doc"), "near")
    home = F.least("ha", "hb")
    homed = pairs.join(near.selectExpr("doc as a", "home as ha", "n as na", "version as va"), "a").join(near.selectExpr("doc as b", "home as hb", "n as nb", "version as vb"), "b")
    homed = stash(homed.select("a", "b", "va", "vb", home.alias("home"), "na", "nb"), "homed")
    ends = homed.selectExpr("home", "a as doc", "na as n").union(homed.select("home", "b", "nb")).distinct()
    weights = stash(ends.groupBy("home").agg(F.sum("n").alias("weight")), "weights")
    total = weights.agg(F.sum("weight")).first()[0] or 0
    parts = F.ceil(F.col("weight") / block).cast("long")
    own_part = [F.when(parts > 1, F.pmod(F.xxhash64(c), parts)).otherwise(F.lit(-1)) for c in ("a", "b")]
    bucket = F.when(parts > 1, F.col("home")).otherwise(F.pmod(F.xxhash64("home"), F.lit(max(1, total // block))))
    keyed = homed.join(weights, "home").select(F.xxhash64(bucket, F.least(*own_part), F.greatest(*own_part)).alias("key"), "a", "b", "va", "vb")
    keyed = stash(keyed, "keyed")
    ends = keyed.selectExpr("key", "a as doc", "va as version").union(keyed.select("key", "b", "vb"))
    needed = ends.groupBy("doc", "version").agg(F.collect_set("key").alias("keys"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, keys, own in zip(batch.column("doc").to_pylist(), batch.column("keys").to_pylist(), _row_sets(batch, n), strict=True):
                whole = own.tobytes()
                for key in keys:
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([doc]), pa.array([whole], pa.binary())], names=["key", "doc", "whole"])

    def span(met: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        whole = {d: np.frombuffer(w, np.uint64) for d, w in zip(own["doc"].tolist(), own["whole"], strict=True)}
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := up.get(x, x)) != x:
                up[x] = up.get(p, p)
                x = p
            return x

        found = []
        for a, b in zip(met["a"].tolist(), met["b"].tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                p, q = whole[a], whole[b]
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    up[rb] = ra
                    found.append((a, b))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    given = _texts(needed, documents).select("doc", "keys", "text").mapInArrow(released(sets), "key long, doc long, whole binary")
    links = stash(keyed.groupBy("key").cogroup(given.groupBy("key")).applyInPandas(span, "a long, b long"), "links")
    discard(near, homed, weights, keyed)
    return links


def _children(rows: DataFrame, comps: DataFrame | None, sizes: DataFrame, documents: DataFrame, n: int) -> DataFrame:
    """Each row's next nodes, from the full shingle sets of the documents still in open nodes."""
    member = _member(LONG_BITS)
    same = [c for c in member if c != "doc"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            child, count = [], np.zeros(batch.num_rows, np.int64)
            for i, (nodes, own) in enumerate(zip(batch.column("nodes"), _row_sets(batch, n), strict=True)):
                if len(own):
                    child.append(child_nodes(own, np.array(nodes.as_py(), np.int64)))
                    count[i] = len(child[-1])
            if child:
                at = pa.array(np.repeat(np.arange(batch.num_rows), count))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(child)), *(batch.column(c).take(at) for c in member)], names=["node", *member])

    held = rows.groupBy("doc").agg(*(F.first(c).alias(c) for c in same), F.collect_set("node").alias("nodes"))
    held = _with_components(held, comps).join(sizes.select("doc", "version"), "doc")
    return _texts(held, documents).select("text", "nodes", *member).mapInArrow(released(step), "node long, " + ", ".join(f"{c} long" for c in member)).distinct()


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _joined(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """``comps`` (id, component) after ``links`` (a, b): only links between different components
    are followed, so the components of a level are not worked out again on the next."""
    if comps is None:
        return edge_components(links, "a", "b")
    part = lambda c: comps.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    across = links.join(part("a"), "a", "left").join(part("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b")
    new = edge_components(across, "a", "b")
    whole = comps.select("id", "component").unionByName(new.join(comps.select("id"), "id", "left_anti").select("id", F.col("id").alias("component")))
    moved = new.select(F.col("id").alias("old"), F.col("component").alias("new"))
    out = stash(whole.join(moved, F.col("component") == F.col("old"), "left").select("id", F.coalesce("new", "component").alias("component")), "components")
    discard(new)
    return out


def near_duplicates(
    documents: DataFrame, n: int = 5, percent: int = 80, trees: int = TREES, depth: int = DEPTH, few: int = FEW, small: int = SMALL_NODE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class_id) for each document.

    Words are lower-cased (A-Z only) runs without ASCII white space; a document's set holds
    its distinct ``n``-word shingles, or its whole word sequence if it has fewer words.
    Documents with 100 * intersection >= percent * union are linked, and ``component_id`` is
    the smallest id reachable. Null, empty and blank texts have no set and are linked with
    nothing. Documents of equal sets form a class first (``class_id``, its smallest id), so
    a class of any size takes part as one. A null id is never linked and is kept. Repeated
    rows give repeated results; if rows of one id differ, the one whose set has the smallest
    digest stands for the id in links with others. Texts of any length are taken whole. An
    empty table gives an empty result. Extra columns are not read.
    """
    feats = stash(shingle_features(documents, n, trees, id_col, text_col), "features")
    known = feats.filter("digest is not null and doc_id is not null")
    taken = ["n", "version", "nodes", *_words()]
    named = known.select("digest", F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "version", "nodes", *_words())
    classes = named.groupBy("digest").agg(F.min_by(F.struct("doc", *taken), F.struct("doc", "version")).alias("r")).select("digest", "r.*")
    reps = stash(classes.groupBy("doc").agg(F.min_by(F.struct(*taken), "digest").alias("r")).select("doc", "r.*"), "reps")
    class_ids = known.groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    members = stash(feats.select("doc_id", "n_shingles", "digest").join(class_ids, "digest", "left").select("doc_id", "n_shingles", "class_id"), "members")
    discard(feats)
    sizes = reps.select("doc", "n", "version")
    text = F.col(text_col).cast("string")
    texts = documents.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))

    tested: list[DataFrame] = []
    comps, bounds = None, None

    def join_up(pairs: DataFrame) -> bool:
        """Confirm pairs and bring the components up to date."""
        nonlocal comps
        pairs = pairs.distinct()
        if tested:
            pairs = pairs.join(_union(tested), ["a", "b"], "left_anti")
        likely = stash(pairs, "likely")
        if likely.isEmpty():
            return False
        tested.append(likely)
        links = confirm(likely, sizes, texts, n, percent)
        if links.isEmpty():
            return False
        old, comps = comps, _joined(comps, links)
        discard(old, links)
        return True

    bits = BITS
    level = reps.select(F.explode(F.array_distinct("nodes")).alias("node"), "doc", "n", F.col("n").alias("s"), F.col("doc").alias("comp"), *_words())
    for k in range(depth):
        rows = stash(_measured(level, alone=k == 0), "level")
        wide = rows.filter(F.col("cross") > few * F.col("size"))
        join_up(_pairs_across(rows.filter(F.col("cross") <= few * F.col("size")), percent, bits, once=True).unionByName(_pairs_with_centre(wide, percent, bits)))
        named = stash(_with_components(wide.select("node", *_member(bits)), comps), "named")  # measuring reads it twice
        open_ = stash(_measured(named), "open")
        discard(rows, named)
        if open_.isEmpty():
            discard(open_)
            break
        if bounds is None:
            ids = stash(sizes.join(open_.select("doc"), "doc", "left_semi").select("doc", "version"), "ids")
            bounds = stash(long_signatures(ids, texts, n).join(shared_parts(ids, texts, n), "doc", "left"), "bounds")
            held = open_.drop(*_words(bits)).join(bounds, "doc").withColumn("s", F.col("n") - F.coalesce("alone", F.lit(0)))
            bits = LONG_BITS
            held = held.filter(f"{100 + percent} * s >= {percent} * (n + least_n) and s * 100 >= n * {percent}").select("node", *_member(bits))
            old, open_ = open_, stash(_measured(held), "held")
            discard(old)
        last = k == depth - 1
        large = F.col("cross") > small * F.col("size")
        join_up(_pairs_across(open_ if last else open_.filter(~large), percent, bits, once=True))
        rest = open_.filter(large).select("node", *_member(bits))
        if last or rest.isEmpty():
            discard(open_)
            break
        old, level = level, stash(_children(rest, comps, sizes, texts, n), "children")
        discard(open_, old)
    discard(*tested)
    if comps is None:
        out = members.withColumn("component_id", F.coalesce("class_id", "doc_id"))
    else:
        out = members.join(comps, F.col("class_id") == F.col("id"), "left").withColumn("component_id", F.coalesce("component", "class_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id")
