"""The corpus pipeline on a small table with odd rows: each stage against its operator, and what goes."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrajobs.llm import decontaminate, line_dedup, near_dedup
from terrajobs.storage import stash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot int, _doc string"


def prose(rng, stem, n):
    return " ".join("".join(rng.choice(stem) for _ in range(5)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(17)
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, prose(rng, "abc" if i % 2 else "xyz", 60), "one" if i % 2 else "two") for i in range(200)]
    base, leaked, shared = prose(rng, "abc", 120), prose(rng, "xyz", 40), [prose(rng, "abc", 20) for _ in range(4)]
    rows += [(300, base, "one"), (301, base, "one"), (302, base + " abcab", "one"), (303, prose(rng, "xyz", 30) + " " + leaked + " " + prose(rng, "xyz", 30), "two")]
    rows += [(310, "\n".join(shared), "one"), (311, prose(rng, "abc", 30) + "\n" + "\n".join(shared) + "\n" + prose(rng, "abc", 30), "one"), (312, "\n".join(shared), "one")]
    rows += [(400, None, "one"), (401, "", None), (402, "12 34 !!", "two"), (403, " \n", None), (404, prose(rng, "abc", 5000), "one"), (None, prose(rng, "xyz", 70), "two"), (5, rows[5][1], "one")]
    data = [(i, t, lang, f"o{k % 3}/r", None if t is None else len(t), k, "x") for k, (i, t, lang) in enumerate(rows)]
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, leaked), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder):
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        given, docs = docs, stash(stage(spark, docs, folder), name)
        out[name] = (given, docs)
    return out


def ids(df):
    return sorted((r[0] for r in df.select("doc_id").collect()), key=lambda i: (i is None, i or 0))


def test_stages_and_columns(spark, folder, stages):
    import corpus_pipeline

    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontaminate", "packing"]
    for name in list(stages)[:-1]:
        assert stages[name][1].columns == corpus_pipeline.COLUMNS
    whole = corpus_pipeline.run(spark, folder)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, whole.select(key).collect())) == sorted(map(str, stages["packing"][1].select(key).collect()))


def test_language_stage(stages):
    given, kept = stages["language_id"]
    gone = [i for i in ids(given) if i not in ids(kept)]
    assert gone == [400, 401, 402, 403] and kept.count() == given.count() - 4


def test_line_stage(stages):
    given, kept = stages["line_dedup"]
    alone = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(given).collect() if r.n_lines == 0 or r.n_removed < r.n_lines}
    assert {(r.doc_id, r.text) for r in kept.collect()} == alone
    assert 312 not in ids(kept) and 310 in ids(kept)
    (later,) = [r for r in kept.collect() if r.doc_id == 311]
    assert later.text.count("\n") < 5 and later.n_chars == len(later.text)


def test_near_duplicate_stage(stages):
    given, kept = stages["near_dedup"]
    dropped = {r.doc_id for r in near_dedup.near_duplicates(given).collect() if not r.kept}
    assert ids(kept) == [i for i in ids(given) if i not in dropped]
    assert len({300, 301, 302} & set(ids(kept))) == 1 and None in ids(kept) and 404 in ids(kept)


def test_decontamination_stage(spark, folder, stages):
    given, kept = stages["decontaminate"]
    assert [i for i in ids(given) if i not in ids(kept)] == [303]
    assert ids(decontaminate.clean(given, spark.read.parquet(f"{folder}/benchmark.parquet"))) == ids(kept)


def test_packing_stage(stages):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    plain = tokenizers.Tokenizer.from_file(str(public.path("word_bpe_49k.json")))
    given, packed = stages["packing"]
    want = []
    for r in given.collect():
        tokens = np.array([*plain.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        want += [(r.doc_id, k, at, len(tokens[at : at + 4096]), zlib.crc32(tokens[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(tokens), 4096))]
    got = [tuple(r)[:5] for r in packed.select("doc_id", "piece", "start", "length", "ids_crc32").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.filter("n <> end or n > 4096").count() == 0
