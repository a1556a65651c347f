"""The n-gram join against all pairs, on sets at and around the threshold."""

import random
import re

import numpy as np
import pytest

from terrajobs.llm import bytescan, ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n long, comp string, version int"


def shingles(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def plain(rows, n=3, percent=90):
    """{(doc_id, number of shingles, component)} over all pairs of distinct sets."""
    sets = [(d, shingles(t, n)) for d, t, *_ in rows]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, p) in enumerate(sets):
        for b, q in sets[:i]:
            if p and q and None not in (a, b) and 100 * len(p & q) >= percent * len(p | q):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sorted(((d, len(s), root(d)) for d, s in sets), key=str)


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"x{rng.randrange(10**6)}"
        elif kind == 1:
            words.insert(at, f"y{rng.randrange(10**6)}")
        else:
            del words[at]
    return words


def corpus():
    rng = random.Random(21)
    prose = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    texts = [None, "", " \n\t ", "one", "ONE", "a b", "a b c", "a b c d", "Ω b\vc", "stop " * 50]
    for size in (8, 11, 12, 20, 21, 22, 40, 90, 200, 700):
        base = prose(size)
        texts.append(" ".join(base))
        texts += [" ".join(edited(rng, base, max(1, round(size * share)))) for share in (0.005, 0.01, 0.017, 0.02, 0.03, 0.04, 0.06)]
        texts += [" ".join(base[: size - cut]) for cut in (1, size // 30, size // 11, size // 10, size // 9, size // 8)]
    chain = prose(120)
    for _ in range(30):  # each links to the one before only
        chain = edited(rng, chain, 2)
        texts.append(" ".join(chain))
    star = prose(160)
    texts += [" ".join(edited(rng, star, 2)) for _ in range(60)] + [" ".join(star)] * 5  # copies link through the original
    passage = prose(60)
    texts += [" ".join(prose(12) + passage + prose(9)) for _ in range(40)]  # share most of their words, and do not link
    rows = [(i, t, 3, "x", 1) for i, t in enumerate(texts)]
    return [*rows, *rows[20:40], *((1000 + i, t, 3, None, 1) for i, t in enumerate(texts[::5])), (-7, texts[30], None, "", 0), (None, texts[30], 1, "", 0)]


@pytest.mark.parametrize("few", [0, 8])
def test_components(spark, few):
    rows = corpus()
    got = ngram_join.ngram_components(spark.createDataFrame(rows, SCHEMA).repartition(5), few=few)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "class_id"]
    got = got.collect()
    by_id = [r for r in rows if r[0] is not None]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None), key=str) == plain(by_id)
    assert [(r.component_id, r.class_id) for r in got if r.doc_id is None] == [(None, None)]
    assert all(r.class_id is None for r in got if r.n_shingles == 0)


def test_components_at_other_thresholds(spark):
    rows = [r for r in corpus() if r[0] is not None and r[0] < 160]
    df = spark.createDataFrame(rows, SCHEMA)
    for n, percent in ((1, 80), (5, 95)):
        got = ngram_join.ngram_components(df, n, percent).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain(rows, n, percent)
    assert ngram_join.ngram_components(df.limit(0)).count() == 0


def test_bounds_lose_no_link():
    """Pairs as different as their sizes allow share a block, and pass both bounds."""
    rng = np.random.default_rng(1)
    fresh = lambda k: bytescan.mix(rng.integers(0, 2**60, k).astype(np.uint64))
    for percent in (80, 90, 97):
        for _ in range(300):
            s = int(rng.choice([5, 9, 10, 19, 20, 30, 60, 100, 333, 1000, 3000]))
            t = int(rng.integers(-(-percent * s // 100), 100 * s // percent + 1))
            common = -(-percent * (s + t) // (100 + percent))
            if common > min(s, t) or common == s == t:
                continue
            x = fresh(s)
            y = np.concatenate([rng.choice(x, common, replace=False), fresh(t - common)])
            row, size = np.repeat([0, 1], [s, t]), np.array([s, t])
            names, rows, filled = ngram_join.block_names(np.concatenate([x, y]), row, size, percent)
            equal = len(set(names[rows == 0].tolist()) & set(names[rows == 1].tolist()))
            assert equal > 0
            assert filled[0 if s < t else 1] - equal <= (100 - percent) * (s + t) // (100 + percent)
            odd = np.unpackbits(ngram_join.parities(np.concatenate([x, y]), row, 2).view(np.uint8), axis=1)
            assert (100 + percent) * int((odd[0] != odd[1]).sum()) <= (100 - percent) * (s + t)


@pytest.mark.parametrize("name", ["op11_ngram_join", "op1_near_dedup"])
def test_sql(spark, sf_dir, name):
    import duckdb

    from terrajobs.llm import queries

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf_dir).select(want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
