"""Secrets in texts, judged by how widely each candidate is owned across the corpus.

Three base kinds are always reported. Wider candidates (vendor prefixes, signed web tokens,
long mixed runs of high entropy) are too noisy to report alone: documentation examples and
fixtures look the same. Each candidate's digest is therefore counted over the distinct
repositories and owners it occurs in. One that few owners have looks live and adds a span;
one that many owners share is an example and adds none.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrajobs.llm.common import small_batches
from terrajobs.storage import stash

# The three base patterns.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, so the length can stand in the pattern
WIDER = re.compile(
    r"gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abpr]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
    r"|[A-Za-z0-9+/_=-]{24,}"
)
KINDS = ("assign", "access", "hex", "live")
ENTROPY = 3.6


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place, end, secret) of the base kinds."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def _random_looking(value: str) -> bool:
    if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
        return False
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) >= ENTROPY


def wider_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Further candidates that overlap no base span."""
    out = []
    for m in WIDER.finditer(text):
        if _random_looking(m[0]) and all(m.end() <= s or m.start() >= e for s, _, e, _ in taken):
            out.append((m.start(), 3, m.end(), m[0]))
    return out


def joined(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


_SPAN = "struct<start:long,kind:int,stop:long,digest:string>"


def candidates(documents: DataFrame, repo_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its base spans, wider candidates and their digests."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64()), ("digest", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, base, wider, sha = [], [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                found = base_spans(text)
                struct = lambda spans: [{"start": s, "kind": k, "stop": e, "digest": hashlib.blake2b(v.encode(), digest_size=16).hexdigest()} for s, k, e, v in spans]
                rows.append(row)
                row += 1
                base.append(struct(found))
                wider.append(struct(wider_spans(text, found)))
                sha.append(hashlib.sha256(joined(found).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), batch.column("doc_id"), batch.column("repo"), pa.array(base, kind), pa.array(wider, kind), pa.array(sha)],
                names=["row", "doc_id", "repo", "base", "wider", "base_sha256"],
            )

    return small_batches(documents).select(F.col(id_col).cast("long").alias("doc_id"), F.col(repo_col).cast("string").alias("repo"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"row long, doc_id long, repo string, base array<{_SPAN}>, wider array<{_SPAN}>, base_sha256 string"
    )


def ownership(found: DataFrame) -> DataFrame:
    """(digest, n_repos, n_owners): in how many distinct repositories and owners a secret is.

    The owner is what stands before the first slash of the repository. Rows are reduced to
    distinct (digest, repository) before they are counted, so a secret copied into most of
    the corpus costs one row per repository and task. A null repository counts as none.
    """
    uses = found.select("repo", F.explode(F.concat("base", "wider")).alias("c")).select(F.col("c.digest").alias("digest"), "repo").distinct()
    return uses.withColumn("owner", F.split("repo", "/")[0]).groupBy("digest").agg(F.count("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))


def scan(documents: DataFrame, repo_col: str = "source", max_owners: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied), a row per row.

    Positions are code points, ends exclusive; a null text counts as empty. ``spans`` holds
    the base spans and the wider candidates owned by at most ``max_owners`` owners (kind
    ``live``). ``n_live`` and ``n_copied`` count all of a document's candidates by whether
    their owners are at most, or more than, ``max_owners``. Repeated rows stay repeated;
    other columns are not read.
    """
    found = stash(candidates(documents, repo_col, id_col, text_col), "secrets")
    owners = ownership(found)
    uses = found.select("row", F.explode(F.concat("base", "wider")).alias("c")).join(owners.withColumnRenamed("digest", "d"), F.col("c.digest") == F.col("d"))
    live = F.col("n_owners") <= max_owners
    verdict = uses.groupBy("row").agg(
        F.count_if(live).alias("n_live"),
        F.count_if(~live).alias("n_copied"),
        F.collect_list(F.when(live & (F.col("c.kind") == 3), F.col("c"))).alias("added"),
    )
    label = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.expr(f"cast(array() as array<{_SPAN}>)"))))
    text = F.array_join(F.transform(spans, lambda c: F.concat_ws(":", label[c["kind"]], c["start"].cast("string"), c["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda c: c["kind"] == k)).cast("long")
    return found.join(verdict, "row", "left").select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        "base_sha256",
        text.alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )
