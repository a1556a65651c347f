"""Periodic runs against a search of every period at every place."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrajobs.llm import bytescan, periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, runs int, n_words string"


def plain_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch, length = words[i : j + q], j + q - i
            if length >= max(6, 4 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def fast_runs(texts):
    words = [[zlib.crc32(w.encode()) for w in t] for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    keys = bytescan.mix(np.array([x for w in words for x in w], np.uint64) ^ bytescan.mix(row.astype(np.uint64)))
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    out = [[] for _ in texts]
    for start, length, period in periodic.find_runs(keys, row).tolist():
        out[row[start]].append((start - int(first[row[start]]), length, period))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=5), st.integers(1, 9), st.text("abc", max_size=4)), max_size=5))
def test_runs_of_small_alphabets(parts):
    words = "".join(p * k + t for p, k, t in parts)
    assert fast_runs([words, "", words[::-1]]) == [plain_runs(words), [], plain_runs(words[::-1])]


def test_runs_at_every_size():
    rng = random.Random(2)
    texts = ["a" * 1000, "ab" * 300 + "a", "a" * 5, "a" * 6, "abcd" * 4, "abcd" * 4 + "a", ("a" * 9 + "b") * 8, "aab" * 40 + "aac" * 40]
    for _ in range(120):
        unit = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 40))]
        texts.append("".join([rng.choice("abc") for _ in range(rng.randrange(20))] + unit * rng.randrange(2, 9) + unit[: rng.randrange(len(unit))] + [rng.choice("abc") for _ in range(30)]))
    assert fast_runs(texts) == [plain_runs(t) for t in texts]


def documents():
    rng = random.Random(8)
    words = lambda n: [rng.choice(["so", "it", "Ünd", "x y", "go", "\U0001f600"]) for _ in range(n)]
    texts = [None, "", " \t\n", "one", "no " * 6, "no " * 5, "a b " * 4, "a\vb\f" * 400]
    for i in range(60):
        unit = " ".join(words(rng.randrange(1, 30)))
        texts.append(" \n".join([" ".join(words(rng.randrange(12))), *[unit] * rng.randrange(1, 8), " ".join(words(9))]))
    texts.append(" ".join(" ".join(words(50)) for _ in range(30)) + " la" * 100_000)
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(i + 1000, t, 1, "x") for i, t in enumerate(texts[:-1])]
    return [*rows, *rows[:20], (None, "no " * 9, 1, "x"), (-5, "yes " * 9, None, None)]


def plain_digest(doc, text):
    words = WORD.findall(text or "")
    n, h = len(words), 1 if doc is None else zlib.crc32(str(doc).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words) if n < 5000 else fast_runs([words])[0]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ends = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return len(runs), *ends, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_digests(spark):
    rows = documents()
    got = periodic.digests(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(((d, *plain_digest(d, t)) for d, t, *_ in rows), key=key)


def test_operator(spark):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in periodic.periodic_runs(df).collect()}
    assert [tuple(x) for x in got[4].runs] == [(0, 6, 1)] and got[4].collapsed == "no" and got[5].runs == []
    assert got[0].n_words == got[1].n_words == got[2].n_words == 0 and got[0].collapsed == ""
    for d, t, *_ in rows:
        assert got[d].n_words == len(WORD.findall(t or ""))
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(3, np.uint64), np.zeros(3, np.int64), exponent=3)
