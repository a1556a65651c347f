"""The corpus operators against brute force, on small tables with odd rows."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrajobs.llm import bytescan, chat_format, decontaminate, language_id, line_dedup, near_dedup, packing, quality_model, quality_rules, secret_scan, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot int, _doc string"


def prose(rng, n, stem="a"):
    return " ".join("".join(rng.choice("etaoinshr" + stem) for _ in range(rng.randrange(2, 9))) for _ in range(n))


def corpus():
    rng = random.Random(11)
    texts = [None, "", " \n\t ", "one", "one two three", "É è́ ßtraße x", "a " * 40, "Ω\n\nΩ\nΩ"]
    base = [prose(rng, 60) for _ in range(12)]
    for b in base:
        words = b.split()
        texts.append(b)
        for changes in (1, 1, 4):
            w = list(words)
            for _ in range(changes):
                w[rng.randrange(len(w))] = prose(rng, 1, "z")
            texts.append(" ".join(w))
    texts += [base[0].upper(), base[0].replace(" ", "\n"), base[1]] + [base[2]] * 30
    lines = [prose(rng, 6) for _ in range(8)]
    texts += ["\n".join(lines), "\n".join([prose(rng, 5), *lines[2:6], prose(rng, 5)]), "\n".join(lines[:2] * 4)]
    texts.append(prose(rng, 30000))
    return [(i, t, "en", f"o{i % 3}/r{i % 5}", None if t is None else len(t), i, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_span_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"abc xyz abc", np.uint8)
    h = bytescan.span_hashes(data, np.array([0, 4, 8]), np.array([3, 7, 11]))
    assert h[0] == h[2] != h[1]


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(docs, n):
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    sets = {}
    for i, t, *_ in corpus():
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, n=n).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_large_nodes_and_deep_trees(spark):
    rng = random.Random(2)
    base = prose(rng, 80).split()
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(80)] = f"z{i}"
        rows.append((i, " ".join(w) + " " + " ".join(base[:20])))
    rows += [(1000 + i, prose(rng, 60, "q") + " " + " ".join(base[:12])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df, n=4, few=1, small=1, depth=3).collect()
    assert all(r.component_id == (0 if r.doc_id < 1000 else r.doc_id) for r in got)


def test_pairs_in_nodes_open_to_the_last_level(spark):
    rng = random.Random(5)
    common, pool = [f"c{i}" for i in range(160)], [f"p{i}" for i in range(400)]
    rows = []
    for i in range(60):
        whole = common + rng.sample(pool, 40)
        rows += [(2 * i, " ".join(whole)), (2 * i + 1, " ".join(rng.sample(whole, 160)))]  # a part of 0.8
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, n=1, few=0, small=0).collect()}
    assert got == {i: i - i % 2 for i in got} and len(got) == 120


def test_documents_of_stock_clauses(spark):
    rng = random.Random(3)
    clauses = [prose(rng, 60).split() for _ in range(30)]
    rows = [(i, " ".join(w for c in sorted(rng.sample(range(30), 20)) for w in clauses[c])) for i in range(400)]
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in (t.split() for _, t in rows)]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                links += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, n=4, small=100).collect()}
    assert links and got == {i: find(i) for i in got}


def test_nodes_of_hundreds_are_compared_at_their_level(spark, monkeypatch):
    """Alike texts under the threshold are compared at once; levels below cost more than these pairs."""
    rng = random.Random(5)
    clauses = [prose(rng, 12).split() for _ in range(30)]
    rows = [(i, " ".join(w for c in sorted(rng.sample(range(30), 24)) for w in clauses[c])) for i in range(340)]
    rows += [(1000 + i, t + " end") for i, t in rows[:5]]

    def below(*_):
        raise AssertionError("went a level deeper")

    monkeypatch.setattr(near_dedup, "_children", below)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, n=4).collect()}
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, w in ((i, t.split()) for i, t in rows)}
    up = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and up[i] != up[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((up[i], up[j]))
                up = {k: low if v == high else v for k, v in up.items()}
    assert got == up and len(set(up.values())) > 200


def test_odd_rows_of_near_duplicates(spark, none):
    text = "a b c d e f g h"
    rows = [(1, text), (1, text), (2, text), (None, text), (3, "x y z u v w"), (3, "other words in this one here"), (4, "x y z u v w"), (5, None), (None, None)]
    got = [(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, 1, True), (3, 3, True), (3, 3, True), (4, 3, False), (5, 5, True), (None, None, True)], key=str)
    assert near_dedup.near_duplicates(none).count() == 0


def test_minima_come_from_full_sets():
    rng = np.random.default_rng(7)
    missed = 0
    for _ in range(60):
        whole = np.unique(rng.integers(0, 2**63, 2000).astype(np.uint64))
        part = np.sort(rng.choice(whole, len(whole) * 4 // 5, replace=False))
        seeds = near_dedup._tree_seeds(near_dedup.TREES)
        a, b = near_dedup.minwise_nodes(whole, seeds), near_dedup.minwise_nodes(part, seeds)
        for _ in range(near_dedup.DEPTH - 1):
            both = np.intersect1d(a, b)
            a, b = (near_dedup.child_nodes(x, both) for x in (whole, part))
        missed += not len(np.intersect1d(a, b))
    assert missed == 0


def test_secrets(spark):
    rng = random.Random(4)
    key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    live = "ghp_" + "Ab3dEf6hIj9kLm2nOp5q"
    shared = "ghp_" + "Zz9yXx8wVv7uTt6sRr5q"
    texts = [None, "", f"é token = \"{key}\" {live}", "passwd: short PASSWORD=token=abcdefghijkl", "AKIA1234567890ABCD xAKIA12", f"{shared} KKey"] + [f"see {shared}"] * 4
    df = spark.createDataFrame([(i, t, f"own{i}/r") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secret_scan.scan(df).collect()}
    assign = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t in enumerate(texts):
        t = t or ""
        spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(t) if len(m[1]) >= 12]
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert got[i].base_sha256 == hashlib.sha256(",".join(s for *_, s in sorted(spans)).encode()).hexdigest()
    at = texts[2].index("ghp_")
    assert f"live:{at}:{at + len(live)}" in got[2].spans.split(",")
    assert (got[2].n_live, got[2].n_copied, got[2].n_assign, got[2].n_access, got[2].n_hex) == (3, 0, 1, 0, 1)
    assert (got[4].n_access, got[3].n_assign, got[3].n_access) == (1, 1, 0)
    assert "live" not in got[5].spans and got[5].n_copied == 1


def test_language_model(spark, none):
    rng = random.Random(1)
    rows = []
    for i in range(240):
        stem = "abc" if i % 2 else "xyz"
        text = " ".join("".join(rng.choice(stem) for _ in range(5)) for _ in range(60))
        rows.append((i, text, "one" if i % 2 else "two"))
    rows += [(1000, None, "one"), (1001, "12 34 !!", "two"), (1002, "", None), (1003, "é", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert len(got) == len(rows)
    for i, _, lang in rows[:240]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].lang_pred == lang and 0 <= got[i].score <= 1
    assert all(got[i].lang_pred == "und" for i in (1000, 1001, 1002)) and got[1003].lang_pred in ("one", "two")
    assert language_id.identify(none).count() == 0


def brute_lines(rows, run):
    seen, out = set(), {}
    solid = {i: [(k, x.strip(" \t\x0b\f\r")) for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\x0b\f\r")] for i, t in rows}
    for i in sorted(solid):
        gone = set()
        for size in range(1, run + 1):
            for k in range(len(solid[i]) - size + 1):
                part = solid[i][k : k + size]
                gram = tuple(x for _, x in part)
                n = [len(WORD.findall(x)) for x in gram]
                if size < run and not (sum(n) >= 50 > max(sum(n[1:]), sum(n[:-1]))):
                    continue
                if gram in seen:
                    gone.update(n for n, _ in part)
                seen.add(gram)
        out[i] = gone
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in out[i]) for i, t in rows}


def test_components_grow_by_new_links(spark):
    """Links that come level by level join the same documents as all of them at once."""
    rng, comps, up = random.Random(1), None, {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for _ in range(3):
        links = [(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(15)) if a != b]
        comps = near_dedup._joined(comps, spark.createDataFrame(links, "a long, b long"))
        for a, b in links:
            a, b = sorted((root(a), root(b)))
            up[b] = a
        assert {r.id: r.component for r in comps.collect()} == {x: root(x) for x in up}


def test_line_runs(spark, docs, none):
    rows = [(r[0], r[1]) for r in corpus()]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert {i: r.text for i, r in got.items()} == brute_lines(rows, line_dedup.RUN)
    assert got[0].slot == 0 and got[0]["_doc"] == "x"
    assert line_dedup.dedup_lines(none).count() == 0
    rng = random.Random(5)
    halves = [prose(rng, 30) for _ in range(12)] + [prose(rng, 52) for _ in range(6)]
    rows = [(i, "\n".join(rng.choice([*halves, prose(rng, 4)]) for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == brute_lines(rows, line_dedup.RUN)
    dotted = docs.select("doc_id", "text", F.lit(1).alias("a.b"))
    assert {r["a.b"] for r in line_dedup.dedup_lines(dotted.unionByName(dotted)).collect()} == {1}


def test_bodies_and_words_of_lines(spark):
    """White space goes at a line's very ends only, also next to what Java takes for the end of a line."""
    rng = random.Random(13)
    lines = ["".join(rng.choice(["a", "é", " ", "  ", "\t", "\x0b", "\f", "\r", "\x85", "\u2028"]) for _ in range(rng.randrange(12))) for _ in range(300)] + ["x \x85", "x\x85 ", "a b", "", " "]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "k long, text string").withColumn("body", line_dedup._body(F.col("text")))
    for r in df.withColumn("w", line_dedup._words(F.col("body"))).filter("body <> ''").union(df.filter("body = ''").withColumn("w", F.lit(0))).collect():
        assert r.body == lines[r.k].strip(" \t\x0b\f\r") and r.w == len(WORD.findall(r.body))
    rows = [(k, f"{prose(random.Random(k), 5)}\n{e}one line \x85\ntwo lines\nthree lines") for k, e in enumerate(["", " ", ""])]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame([*rows, (9, rows[0][1].replace(" \x85", "\x85"))], "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 3, 2: 3, 9: 0}


def test_quality_measures(docs, none):
    got = {r.doc_id: r for r in quality_rules.verdicts(docs).collect()}
    for i, t, *_ in corpus():
        t = t or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        count = Counter(grams)
        cover = {p for k, g in enumerate(grams) if count[g] > 1 for p in range(k, k + 8)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), dup, len(cover))
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
        assert not (r.kept and r.base_failed)
    book = quality_rules.ledger(docs)
    rules = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablations(book).collect()}
    bits = [r.failed for r in book.collect()]
    assert rules["few_words"] == (sum(b & 1 for b in bits), sum(b == 1 for b in bits))
    assert quality_rules.verdicts(none).count() == 0


def test_co_training(spark, none):
    rng = random.Random(6)
    rows = [(i, prose(rng, 50) if i % 3 else " ".join(["$$$ %%% WORD!!"] * 20), "en", f"s{i % 4}", 100, 0, "") for i in range(300)]
    df = spark.createDataFrame(rows + [(900, None, None, None, None, None, None)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 200)], "doc_id long, quality int, toxic int")
    model = quality_model.fit(df, labels)
    got = {r.doc_id: r for r in quality_model.score(df, model).collect()}
    assert len(got) == 301 and model.log
    assert np.mean([got[i].kept == bool(i % 3) for i in range(200, 300)]) > 0.95
    assert quality_model.fit(none, labels) is None and quality_model.score(none, None).count() == 0


def test_spaced_seeds(spark, none):
    rng = random.Random(8)
    items = [prose(rng, 30, "k") for _ in range(6)] + ["", None, "two words"]
    rows = []
    for i, item in enumerate(items[:6]):
        words = item.split()
        part = words[4:26]
        part[9] = "changed"
        rows += [(10 * i, prose(rng, 40) + " " + " ".join(part).upper() + " " + prose(rng, 20)), (10 * i + 1, " ".join(words[:7]) + " " + prose(rng, 60))]
    rows += [(500, None), (501, ""), (502, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert {i for i, r in got.items() if not r.kept} == {10 * i for i in range(6)}
    assert all(got[10 * i].item_ids == [i] for i in range(6))
    assert decontaminate.decontaminate(none, bench).count() == 0
    long = prose(rng, 300, "k")
    copied = spark.createDataFrame([(1, "x y z " + long + " end"), (2, long.split()[0])], "doc_id long, text string")
    one = spark.createDataFrame([(7, "a b c d " + long)], "item_id long, text string")
    assert {r.doc_id: r.longest for r in decontaminate.decontaminate(copied.unionByName(copied), one).collect()} == {1: 300, 2: 0}
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(rows)


@pytest.mark.parametrize("portion", [1, 300, 5000, 1 << 20])
def test_pieces_across_portions(docs, portion, monkeypatch):
    """Every document has its own token ids, wherever the texts of a batch are cut into portions."""
    import public_tokenizers
    import tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    plain = tokenizers.Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "TEXT_BYTES", portion)
    want = {}
    for r in docs.collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[r.doc_id, k] = (at, len(part), zlib.crc32(part.tobytes()))
    got = packing.pieces(docs, path).collect()
    assert len(got) == len(want)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want


def test_packing(docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    plain = tokenizers.Tokenizer.from_file(str(path))
    rows = packing.pack(docs, str(path), items_each=40).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in corpus():
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want = [(k, 4096 * k, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(np.split(ids, range(4096, len(ids), 4096)))]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in sorted(by[i], key=lambda r: r.piece)] == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    sizes = np.array([r.length for r in rows])
    assert packing.lower_bound(sizes) <= len(bins) <= packing.best_fit(sizes)[0].max() + 2
    assert all(r.bins >= r.bound >= 1 for r in rows)
    assert packing.pack(none, str(path)).count() == 0


def test_word_ids_match_the_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    path = str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    plain, words = tokenizers.Tokenizer.from_file(path), packing.WordIds(path)
    rng = random.Random(3)
    odd = list("aB'sZ9.,<|>*é́ßΣ日 \n\t  \x85\x1c-_") + ["<|endoftext|>", "don't", "İ", "ſ"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(40))) for _ in range(400)]
    assert words([t.encode() for t in texts]) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_known_words_are_not_looked_up_again(monkeypatch):
    """Words met before come from the table, whatever shares their slots; long ones and those in a taken slot one by one."""
    tokenizers = pytest.importorskip("tokenizers")
    path = str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    plain, rng = tokenizers.Tokenizer.from_file(path), random.Random(4)
    texts = [prose(rng, 300) + " a a\0 a\0\0 \0 " + "x" * 17 + " " + "é" * 8 + " <|endoftext|>" for _ in range(3)] + ["", " "]
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    data = [t.encode() for t in texts]
    words = packing.WordIds(path)
    assert words(data) == want
    asked = []
    monkeypatch.setattr(packing.WordIds, "_ids", lambda self, new, f=packing.WordIds._ids: asked.append(len(new)) or f(self, new))
    assert words(data) == want and sum(asked) < 20
    monkeypatch.setattr(packing, "SLOT_BITS", 4)
    monkeypatch.setattr(packing, "STORE", 500)
    words = packing.WordIds(path)
    assert [words(data) for _ in range(3)] == [want] * 3


def test_marks_at_ends_of_words_share_entries():
    """A word is held once, whatever marks follow it; marks that join a word's end stay with it."""
    tokenizers = pytest.importorskip("tokenizers")
    path = str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    plain, words = tokenizers.Tokenizer.from_file(path), packing.WordIds(path)
    ids = lambda t: np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    texts = ["alpha, né. 7!", "né, alpha! 7.", "alpha né 7 , . !"]
    assert words([t.encode() for t in texts]) == [ids(t) for t in texts]
    assert np.count_nonzero(words.length) == 6
    odd = ["İ!!!!! a\u0307... ’” é’. ×, a!!!!!!!!!", "...", "(a,", "a\u0301,", "é", "<|endoftext|>. <|endoftext|,"]
    assert words([t.encode() for t in odd]) == [ids(t) for t in odd]


def test_bounds_hold():
    rng = random.Random(9)
    for _ in range(30):
        sizes = np.array([rng.randrange(1, 4097) for _ in range(rng.randrange(1, 60))])
        bins, offsets = packing.best_fit(sizes)
        assert packing.lower_bound(sizes) <= bins.max() + 1
        for b in range(bins.max() + 1):
            own = np.argsort(offsets[bins == b])
            assert (offsets[bins == b][own] == np.cumsum(sizes[bins == b][own]) - sizes[bins == b][own]).all() and sizes[bins == b].sum() <= 4096
    assert packing.lower_bound(np.array([2049, 2049, 2049])) == 3


def test_chat_round_trip(spark):
    rng = random.Random(7)
    odd = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "a", "\n", "<", "/s>", "é"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "[INST]"]), None if rng.random() < 0.1 else "".join(rng.choice(odd) for _ in range(rng.randrange(8)))) for c in range(60) for t in range(rng.randrange(1, 5))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    for c in got:
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        r = got[c]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest() and r.n_turns == len(turns)
        said = "".join(b for a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert "".join(chat_format.unescape(r.formatted[s.start : s.stop]) for s in r.loss_spans) == said and r.formatted_chars == len(r.formatted)


def test_repeated_passages(spark, none):
    rng = random.Random(12)
    passage = prose(rng, 70)
    rows = [(i, prose(rng, 40 + i) + " " + passage + " é" + prose(rng, 30)) for i in range(20)]
    rows += [(100 + i, prose(rng, 80)) for i in range(20)] + [(300, None), (301, ""), (302, "short"), (None, passage)]
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), bits=16).collect()}
    texts = dict(rows)
    for i, r in got.items():
        if r.text is not None:
            kept, at = [], 0
            for s in r.spans:
                kept.append(texts[i][at : s.start])
                at = s.stop
            assert r.text == "".join(kept) + texts[i][at:]
    assert got[0].removed_chars == 0 and all(got[100 + i].removed_chars == 0 for i in range(20))
    assert all(0.6 * len(passage) <= got[i].removed_chars <= len(passage) + 20 for i in range(1, 20))
    assert got[None].text == passage and substring_dedup.dedup_substrings(none).count() == 0


def test_passages_are_cut_to_their_ends(spark):
    rng = random.Random(3)
    passages = [prose(rng, 51) for _ in range(40)] + [" ".join("Ωé€" + prose(rng, 1) for _ in range(51))]
    passages.append("na" * 1500 + prose(rng, 60) + "na" * 1500)
    rows = [(100 * k + i, f"{prose(rng, 30)}|{i}{p}{i}|{prose(rng, 30)}") for i, p in enumerate(passages) for k in (0, 1)]
    rows = [(d, t.replace("|", "Δ" if d < 100 else "Θ")) for d, t in rows]
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), bits=16).collect()}
    whole = 0
    for i, p in enumerate(passages):
        assert i >= 41 or got[i].removed_chars == 0
        whole += max((s.stop - s.start for s in got[100 + i].spans), default=0) >= len(p)
    assert whole >= len(passages) - 1


def test_wide_contexts_stay_in_spark(spark):
    """Only the bytes around the first difference go to Python, and what they say is right for the whole."""
    rng, width, rows = random.Random(21), 4096, []
    for n in [0, 1, 63, 64, 65, 71, 72, 127, 128, 129, 200, 640, 1999, 4095, 4096] * 4:
        same = "".join(rng.choice("aé€😀") for _ in range(n)).encode()[: n if n == width else None][:width]
        same = same.decode(errors="ignore").encode() if n < width else b"a" * width
        ends = [rng.choice(["", "x", "éy", "è", "€z"]).encode() for _ in range(2)]
        p, q = ((e + same)[-width:].decode(errors="ignore").encode() for e in ends)
        x, y = ((same + e)[:width].decode(errors="ignore").encode() for e in ends)
        rows.append((len(rows), p, q, x, y))
    names = ["later_before", "first_before", "later_after", "first_after"]
    both = spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} binary" for c in names))
    near = substring_dedup._near_change(both, width)
    common = lambda df, *skip: {r.k: (r.e.before, r.e.after, r.e.more) for r in df.select("k", substring_dedup._common(*names, *skip, F.lit(width)).alias("e")).collect()}
    assert common(near, "skip_before", "skip_after") == common(both, F.lit(0), F.lit(0))
    assert max(len(r[c]) for r in near.collect() for c in names) <= substring_dedup.PART + 16


def test_pieces_of_different_sources_stay(spark):
    """Two repeated pieces under the least length, side by side, are no repeated passage."""
    rng = random.Random(31)
    letters = lambda n: "".join(rng.choice(string.ascii_lowercase) for _ in range(n))
    sources = [letters(700) for _ in range(8)]
    rows = list(enumerate(sources))
    for k in range(60):
        a, b = rng.sample(sources, 2)
        i, j = rng.randrange(590), rng.randrange(590)
        rows.append((100 + k, letters(40) + a[i : i + 110] + b[j : j + 110] + letters(40)))
    rows.append((900, letters(60) + sources[0][100:600] + letters(60)))
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), bits=16).collect()}
    seen = ""
    for i, t in rows:
        for s in got[i].spans:
            assert s.stop - s.start >= 128 and t[s.start : s.stop] in seen
        seen += "|" + t
    assert got[900].removed_chars >= 500
