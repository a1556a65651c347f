"""Searches, sums and walks over structures, against plain Python."""

import math
import random

from pyspark.sql import functions as F

from terrajobs.operators import districts, forest, joins, nearest, ordering, summaries


def test_nearest_of_any_spread(spark):
    rng = random.Random(3)
    spots = [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(150)]
    spots += [(1e6 + rng.random(), -1e6 + rng.random()) for _ in range(40)] + [(5.0, 5.0)] * 30 + [(rng.randrange(4), rng.randrange(4)) for _ in range(60)]
    rows = [(i, i % 2, i % 7 if i % 11 else None, float(x), float(y)) for i, (x, y) in enumerate(spots)]
    odd = [(900, None, 1, 0.0, 0.0), (901, 0, 1, None, 0.0), (902, 0, 1, float("nan"), 0.0), (903, 0, 1, float("inf"), 0.0), (904, 5, 1, 0.0, 0.0)]
    right = spark.createDataFrame(rows + odd, "id long, part int, owner long, x double, y double")
    left = right.filter("id % 3 = 0 or id > 899").withColumn("key", F.col("id"))
    by = lambda a, b: math.sqrt((b[3] - a[3]) ** 2 + (b[4] - a[4]) ** 2)
    for most in (None, 2.0):
        want = {}
        for a in rows[::3]:
            near = [(by(a, b), b[2] is not None, b[2], a[0], b[0]) for b in rows if a[1] == b[1] and (a[2] is None or b[2] is None or a[2] != b[2])]
            near = [n for n in near if most is None or n[0] <= most]
            if near:
                best = min(near, key=lambda n: (n[0], n[1], n[2] or 0, n[4]))
                want[a[0]] = (best[4], best[2], best[0])
        got = nearest.nearest(left, right, most).collect()
        assert {r.key: (r.match, r.owner, r.dist) for r in got} == want and len(got) == len(want)
    assert nearest.nearest(left, right.limit(0)).count() == nearest.nearest(left.limit(0), right).count() == 0


def test_leftovers_take_the_nearest(spark):
    rows = [(i, 1 + (i > 3), float(x), 0.0) for i, x in enumerate([0, 10, 50, 400, 0])]
    df = spark.createDataFrame(rows, "id long, stateid long, x double, y double")
    near = lambda a, b, **k: {(r.id, r.match, r.dist) for r in joins.nearest_within_passes(df.filter(a), df.filter(b), [20.0, 60.0], **k).collect()}
    assert near("id in (0, 3, 4)", "id in (1, 2)") == {(0, 1, 10.0)}
    assert near("id in (0, 3)", "id in (1, 2, 4)") == {(0, 4, 0.0)}  # one state on the left: any state counts
    assert near("id = 1", "id in (0, 2)", same_state=False) == {(1, 0, 10.0)}


def test_changes_run_downstream(spark):
    rng = random.Random(9)
    rows = [(i, None if i % 50 == 0 else i - rng.randrange(1, min(4, i % 50) + 1), rng.randrange(20)) for i in range(400)]
    rows += [(1000, 1001, 1), (1001, 1000, 1), (1002, 1000, 1), (1003, 7777, 1)]
    tree = spark.createDataFrame(rows, "id long, parentid long, v long")
    down = forest.Downstream(tree)
    changes = spark.createDataFrame([(r[0], rng.randrange(-5, 6), 1) for r in rows[::7]] + [(5, 2, 0), (5, 3, 0), (9999, 1, 1)], "id long, a long, b long")
    got = {r.id: (r.a, r.b) for r in down.push(changes, ["a", "b"]).collect()}
    whole = tree.join(changes.groupBy("id").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "id", "left").fillna(0, ["a", "b"])
    want = {r.id: r.total for r in forest.subtree_sum(whole, "a").collect()}
    count = {r.id: r.total for r in forest.subtree_sum(whole, "b").collect()}
    for i in want:
        assert got.get(i, (0, 0)) == ((want[i], count[i]) if want[i] is not None else (0, 0))
    assert down.push(changes.limit(0), ["a", "b"]).count() == 0
    alone = spark.createDataFrame([(1, None, 4)], "id long, parentid long, v long")
    assert [tuple(r) for r in forest.Downstream(alone).push(alone.select("id", "v"), ["v"]).collect()] == [(1, 4)]


def test_running_sums_of_a_large_key(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), rng.randrange(50), i, rng.choice([1, 5, None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, o long, id long, v long").repartition(6)
    want, sums = {}, {}
    for k, o, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        sums[k] = sums.get(k, 0) + (v or 0)
        want[i] = sums[k]
    got = ordering.running_sum(df, ["k"], ["o", "id"], "v").collect()
    assert {r.id: r.running for r in got} == want and got[0].asDict().keys() == {"k", "o", "id", "v", "running"}


def test_cuts_of_one_large_root(spark):
    df = spark.range(2000).selectExpr("1L as rootid", "id as blockid", "3 as population", "double(id * 7 % 2000) as score", "1000D as target")
    taken = sorted(r.score for r in summaries.population_cut(df).collect())
    assert taken == [float(k) for k in range(333)]
    back = districts.trim_overfull(df.selectExpr("rootid as districtid", "blockid", "population", "score"), 1500)
    assert sorted(2000 - r.blockid * 7 % 2000 for r in back.collect()) == list(range(1, 1500))


def test_first_node_downstream(spark):
    rows = [(1, None, 90, True), (2, 1, 80, True), (3, 2, 40, False), (4, 3, 30, True), (5, 4, 10, True), (6, 1, 5, True)]
    tree = spark.createDataFrame(rows, "id long, parentid long, branchpopulation long, boundary boolean")
    starts = spark.createDataFrame([(5, 10), (4, 60), (6, 500), (1, 0)], "id long, need long")
    found = lambda **k: {r.id: r.found for r in forest.next_downstream(tree, starts, 20, **k).collect()}
    assert found() == {5: 4, 4: 2, 6: 1, 1: 1}
    assert found(boundary_only=True) == {5: 4, 4: 4, 6: 1, 1: 1}
    assert found(own=True)[1] == 1 and found(own=True)[5] == 4


def test_stranded_blocks_follow_their_path(spark):
    """A strip of blocks 1-5 between districts 7 (west) and 8 (east): water runs east through
    watersheds 10 and 11 and leaves the strip there, so all of it would join district 8."""
    strip = [(b, 100, 10 if b < 4 else 11, float(b), 0.0) for b in range(1, 6)]
    stranded = spark.createDataFrame(strip, "blockid long, groupid long, wsid long, x double, y double")
    assigned = spark.createDataFrame([(0, 10, 7, 0.0, 0.0), (6, 11, 8, 6.0, 0.0), (7, 12, 8, 7.0, 0.0)], "blockid long, wsid long, districtid long, x double, y double")
    tree = spark.createDataFrame([(10, 99, 1.0, 0.0), (99, 11, 3.0, 0.0), (11, 12, 5.0, 0.0), (12, None, 7.0, 0.0)], "id long, parentid long, x double, y double")
    pairs = [(b, b + 1) for b in range(7)]
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src long, dst long")
    blocks = stranded.select("blockid", "wsid").unionByName(assigned.select("blockid", "wsid"))
    wish = districts.preferred_districts(stranded, edges, assigned, tree, blocks)
    assert {(r.groupid, r.wsid, r.prefers) for r in wish.collect()} == {(100, 10, 8), (100, 11, 8)}
    got = {r.blockid: r.districtid for r in districts.snap_stranded(stranded, edges, assigned, tree, blocks).collect()}
    assert got == {1: 7, 2: 7, 3: 8, 4: 8, 5: 8}  # block 3 borders both; 1 and 2 never border district 8
    plain = {r.blockid: r.districtid for r in districts.snap_stranded(stranded, edges, assigned).collect()}
    assert plain == {1: 7, 2: 7, 3: 7, 4: 8, 5: 8}


def test_sweep_along_a_boundary(spark):
    """Districts are whole and connected where roots lie on the boundary and land gets stranded."""
    n = 8
    blocks = [(y * n + x, x // 4 + 10 * (y // 4), 1, 1 + (x * y) % 5, float(x), float(y)) for x in range(n) for y in range(n) if (x, y) not in ((3, 3), (3, 4))]
    known = {b[0] for b in blocks}
    pairs = [(b, b + 1) for b in known if b % n < n - 1 and b + 1 in known] + [(b, b + n) for b in known if b + n in known]
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src long, dst long")
    df = spark.createDataFrame(blocks, "blockid long, wsid long, stateid long, population long, x double, y double")
    tree = spark.createDataFrame([(0, None, 0.0, 0.0, True), (1, 0, 4.0, 0.0, True), (10, 0, 0.0, 4.0, True), (11, 10, 4.0, 4.0, True)], "id long, parentid long, x double, y double, boundary boolean")
    got = {r.blockid: r.districtid for r in districts.district_sweep(df, edges, tree, 45).collect()}
    assert set(got) == known and None not in got.values() and len(set(got.values())) > 2
    whole = spark.createDataFrame([(b[0], got[b[0]], b[3]) for b in blocks], "blockid long, districtid long, population long")
    assert districts.keep_largest_part(whole, edges).filter("districtid is null").count() == 0
