"""Hand-made inputs, and properties of the jobs that SQL does not express."""

import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrajobs.functions import polygons
from terrajobs.functions import rings as R
from terrajobs.functions import scalars as S
from terrajobs.operators import districts, filters, forest, joins, ordering, shapes, summaries
from terrajobs.operators.components import component_labels, edge_components


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_tile_clamps(spark):
    assert tuple(one(spark, S.mercator_tile(F.lit(3), F.lit(0.0), F.lit(90.0), 4326))) == (4, 0)
    assert tuple(one(spark, S.mercator_tile(F.lit(3), F.lit(1e9), F.lit(-1e9)))) == (7, 7)
    assert tuple(one(spark, S.mercator_tile(F.lit(None).cast("int"), F.lit(None).cast("double"), F.lit(None).cast("double")))) == (0, 0)


def test_morton_code_of_odd_values(spark):
    assert one(spark, S.morton_code(F.lit(-5), F.lit(None).cast("int"))) == 0
    assert one(spark, S.morton_code(F.lit(1), F.lit(0))) == 2
    assert one(spark, S.morton_code(F.lit(3), F.lit(5))) == 0b011011


def test_zero_vectors(spark):
    zero = F.lit(0.0)
    assert one(spark, S.angle_delta(zero, zero, F.lit(1.0), F.lit(1.0))) is None
    assert one(spark, S.along_distance(F.lit(3.0), F.lit(4.0), zero, zero, zero, zero)) == 5.0
    assert one(spark, S.strict_int(F.lit("007"))) is None


def test_multipolygon_parts(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    outer, hole = ring((0, 0), (0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ring((1, 1), (2, 1), (2, 2), (1, 2), (1, 1))
    df = spark.createDataFrame([(1, [[outer, hole]])], "id long, polygons array<array<array<struct<x:double,y:double>>>>")
    got = filters.polygon_parts(df).select(F.size("ring").alias("n"), R.signed_area(F.col("ring")).alias("a")).collect()
    assert [(r.n, r.a) for r in got] == [(5, -16.0)]


def test_adjacency_needs_a_length(spark):
    def sides(w, x, y, h=1):
        return [(w, 1, float(x), float(y), float(x), float(y + h)), (w, 1, float(x), float(y + h), float(x + 1), float(y + h)), (w, 1, float(x + 1), float(y + h), float(x + 1), float(y)), (w, 1, float(x + 1), float(y), float(x), float(y))]

    rows = sides(1, 0, 0, 2) + sides(2, 1, 0) + sides(3, 1, 1) + sides(4, 2, 2)
    df = spark.createDataFrame(rows, "wsid long, stateid long, x0 double, y0 double, x1 double, y1 double")
    got = {(r.id0, r.id1) for r in joins.line_adjacency(df).collect()}
    assert got == {(1, 2), (2, 1), (1, 3), (3, 1), (2, 3), (3, 2)}  # half a side counts, a corner does not


def test_runs_wrap_around(spark):
    square = [(1, 7, 1, 5, 0.0, 0.0, 0.0, 1.0), (2, 7, 2, 6, 0.0, 1.0, 1.0, 1.0), (3, 7, 3, 6, 1.0, 1.0, 1.0, 0.0), (4, 7, 4, 5, 1.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(square, "id long, wsid long, ordinal int, neighbor long, x0 double, y0 double, x1 double, y1 double")
    got = {(r.wsid1, r.first, r.last, r.length) for r in shapes.neighbor_runs(df).collect()}
    assert got == {(5, 4, 1, 2.0), (6, 2, 3, 2.0)}


def test_dead_ends_chain(spark):
    polys = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "id long, area double")
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 2)], "src long, dst long")
    assert {(r.id, r["into"]) for r in forest.absorb_dead_ends(polys, edges).collect()} == {(1, 3), (2, 3)}


def test_roots_and_cycles(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None), (5, 6), (6, 5)], "id long, parentid long")
    assert {(r.id, r.root, r.depth) for r in forest.forest_roots(nodes).collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 4, 0), (5, None, None), (6, None, None)}
    assert {r.id for r in forest.find_cycles(nodes).collect()} == {5, 6}


def test_reroot_reverses_a_path(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (9, None)], "id long, parentid long")
    at = spark.createDataFrame([(4, 9)], "node long, new_parent long")
    assert {(r.id, r.parentid) for r in forest.reroot(nodes, at).collect()} == {(1, 2), (2, 3), (3, 4), (4, 9), (9, None)}


def test_branch_of_exactly_the_size(spark):
    rows = [(1, None, False, 40), (2, 1, False, 10), (3, 1, False, 25), (4, 3, False, 12)]
    tree = spark.createDataFrame(rows, "id long, parentid long, closed boolean, branchpopulation long")
    assert {r.id for r in forest.branch_roots(tree, 10).collect()} == {4}
    assert {r.id for r in forest.branch_roots(tree, 12).collect()} == {3}  # a child equal to the size is not entered


def test_equally_far_block_is_taken(spark):
    rows = [(1, 1, 8, 1.0, 10.0), (1, 2, 4, 2.0, 10.0), (1, 3, 1, 3.0, 10.0)]
    got = summaries.population_cut(spark.createDataFrame(rows, "rootid long, blockid long, population long, score double, target double"))
    assert sorted(r.blockid for r in got.collect()) == [1, 2]


def test_dense_ids_have_no_gap(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 as k").repartition(5)
    rows = ordering.with_dense_id(df, ["k"]).collect()
    assert sorted((r.k, r.id) for r in rows) == [(k, k + 1) for k in range(1000)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "src long, dst long")
    nodes = spark.createDataFrame([], "id long, parentid long, v long")
    assert edge_components(none).count() == 0
    assert forest.forest_roots(nodes).count() == 0
    assert forest.subtree_sum(nodes, "v").count() == 0


def test_components_and_sums_of_random_graphs(spark):
    rng = random.Random(5)
    parent = {i: (rng.randrange(max(0, i - 4), i) if i % 37 else None) for i in range(1, 300)}
    parent[0] = None
    value = {i: rng.randrange(9) for i in parent}
    rows = spark.createDataFrame([(i, p, value[i]) for i, p in parent.items()], "id long, parentid long, v long")
    want = dict(value)
    for i in sorted(parent, reverse=True):
        if parent[i] is not None:
            want[parent[i]] += want[i]
    assert {r.id: r.total for r in forest.subtree_sum(rows, "v").collect()} == want
    root = {}
    for i in range(300):
        root[i] = i if parent[i] is None else root[parent[i]]
    least = defaultdict(lambda: 10**9)
    for i, r in root.items():
        least[r] = min(least[r], i)
    edges = rows.filter("parentid is not null").select(F.col("id").alias("src"), F.col("parentid").alias("dst"))
    assert {r.id: r.component for r in component_labels(rows, edges).collect()} == {i: least[root[i]] for i in range(300)}


def test_merged_basins_are_one_tree(spark):
    rng = random.Random(3)
    rows = [(b * 10 + k, b * 10 + k - 1 if k else None, float(rng.randrange(9))) for b in range(6) for k in range(5)]
    tree = spark.createDataFrame(rows, "id long, parentid long, exitdist double")
    pairs = [(b * 10 + rng.randrange(5), (b + 1) * 10 + rng.randrange(5)) for b in range(5) for _ in range(2)]
    links = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "wsid0 long, wsid1 long")
    got = forest.merge_basins(tree, links).collect()
    assert sum(r.parentid is None for r in got) == 1 and len({r.rootbasinid for r in got}) == 1
    assert {r.basinid for r in got} == {b * 10 for b in range(6)}
    allowed = {frozenset(p) for p in pairs} | {frozenset((i, p)) for i, p, _ in rows if p is not None}
    assert all(frozenset((r.id, r.parentid)) in allowed for r in got if r.parentid is not None)


def test_sweep_gives_contiguous_districts(spark):
    n = 6
    blocks = [(y * n + x, x // 3, 1, 10, float(x), float(y)) for x in range(n) for y in range(n)]
    edges = [(y * n + x, y * n + x + 1) for x in range(n - 1) for y in range(n)] + [(y * n + x, y * n + n + x) for x in range(n) for y in range(n - 1)]
    edges += [(b, a) for a, b in edges]
    got = districts.district_sweep(
        spark.createDataFrame(blocks, "blockid long, wsid long, stateid long, population long, x double, y double"),
        spark.createDataFrame(edges, "src long, dst long"),
        spark.createDataFrame([(0, None, 0.0, 0.0), (1, 0, 3.0, 0.0)], "id long, parentid long, x double, y double"),
        120,
    ).collect()
    own = {r.blockid: r.districtid for r in got}
    assert len(own) == 36 and None not in own.values()
    for d in set(own.values()):
        members = {b for b, o in own.items() if o == d}
        seen, todo = set(), [min(members)]
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += [q for p, q in edges if p == b and q in members]
        assert seen == members


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 8), st.integers(0, 8), st.integers(1, 6), st.integers(1, 6))
def test_clipped_rectangles(x, y, w, h):
    box = lambda a, b, c, d: np.array([(a, b), (a, d), (c, d), (c, b)], float)
    got = polygons.common_area(box(x, y, x + w, y + h), box(3, 3, 7, 7))
    want = max(0, min(x + w, 7) - max(x, 3)) * max(0, min(y + h, 7) - max(y, 3))
    assert abs(got - want) < 1e-9


L_SHAPE = [(0, 0), (0, 4), (1, 4), (1, 1), (4, 1), (4, 0), (0, 0)]


def polygon(spark, rows):
    data = [(i, [(float(x), float(y)) for x, y in ring], float(min(x for x, _ in ring)), float(min(y for _, y in ring)), float(max(x for x, _ in ring)), float(max(y for _, y in ring))) for i, ring in rows]
    return spark.createDataFrame(data, "id long, ring array<struct<x:double,y:double>>, minx double, miny double, maxx double, maxy double")


def test_polygons_that_are_not_convex(spark):
    from terrajobs.operators import joins, shapes

    square = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)]
    notch = [(2, 2), (2, 3), (3, 3), (3, 2), (2, 2)]
    arm = [(2, 0), (2, 1), (3, 1), (3, 0), (2, 0)]
    both = [(0.5, 0.5), (0.5, 2), (2, 2), (2, 0.5), (0.5, 0.5)]
    inner = polygon(spark, [(1, square), (2, notch), (3, arm), (4, both), (5, L_SHAPE)])
    for ring in (L_SHAPE, L_SHAPE[::-1], L_SHAPE[3:-1] + L_SHAPE[:4]):
        outer = polygon(spark, [(9, ring)])
        area = {r.id0: round(r.area, 9) for r in shapes.overlap_area(inner, outer, 4.0).collect()}
        assert area == {1: 7.0, 3: 1.0, 4: 1.25, 5: 7.0}
        assert {r.id0 for r in joins.contained_pairs(inner, outer, 4.0).collect()} == {3, 5}


def test_exit_points_follow_the_linked_parent(spark):
    from terrajobs.operators.forest import exit_points

    # 1: root on the rim; 2: crosses into 1; 3: touches 2, its parent; 4: touches only 3, linked to 1;
    # 5: touches its parent 3 and, like it, 2, into which its river crosses; 6: root inside; 7: hangs on 6
    ws = spark.createDataFrame([(1, None, True), (2, 1, False), (3, 2, False), (4, 1, False), (5, 3, False), (6, None, False), (7, 6, False)], "id long, parentid long, boundary boolean")
    cross = spark.createDataFrame([(2, 1, 1.0, 1.0, 558), (2, 1, 9.0, 1.0, 460), (5, 2, 7.0, 4.0, 460)], "id long, parent long, x double, y double, class int")
    faces = [(1, 0, 0.0, 0.0), (1, 2, 1.0, 1.5), (2, 1, 1.0, 1.5), (2, 1, 9.0, 1.5), (2, 3, 2.0, 3.0), (2, 5, 7.0, 4.0), (3, 2, 2.0, 3.0), (3, 2, 6.0, 3.0)]
    faces += [(3, 4, 3.0, 6.0), (4, 3, 3.0, 6.0), (3, 5, 6.0, 5.0), (5, 3, 6.0, 5.0), (5, 3, 1.0, 5.0), (5, 2, 7.0, 4.0), (6, 7, 20.0, 20.0), (7, 6, 20.0, 20.0)]
    faces = spark.createDataFrame([(*r, 1.0) for r in faces], "id long, neighbor long, x double, y double, length double")
    got = {r.id: (r.parent, r.x, r.y, r.step) for r in exit_points(ws, cross, faces).collect()}
    assert got == {1: (None, 0.0, 0.0, 2), 2: (1, 1.0, 1.5, 1), 3: (2, 2.0, 3.0, 5), 4: (None, 3.0, 6.0, 4), 5: (3, 6.0, 5.0, 3)}


def test_cycles_have_no_sums(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 5), (5, 6), (6, 5), (7, 99)]
    nodes = spark.createDataFrame(rows, "id long, parentid long").selectExpr("id", "parentid", "10 * id as v")
    assert {r.id: r.total for r in forest.subtree_sum(nodes, "v").collect()} == {1: 60, 2: 50, 3: 30, 4: None, 5: None, 6: None, 7: 70}
    assert {r.id: (r.root, r.most) for r in forest.path_max(nodes, "v").collect()} == {1: (1, 10), 2: (1, 20), 3: (1, 30), 7: (7, 70)}


def test_links_are_ranked_together_by_ranges(spark):
    links = spark.range(200).selectExpr("id as wsid0", "id + 1 as wsid1", "double(id * 37 % 50) as descent", "double(id % 3) as boundary_descent", "1.0D as island_area", "double(id % 4) as length")
    got = {r.wsid0: r["rank"] for r in ordering.rank_basin_links(links).collect()}
    order = sorted(links.collect(), key=lambda r: (r.descent - r.boundary_descent, r.descent, r.island_area, -r.length, r.wsid0))
    assert got == {r.wsid0: k for k, r in enumerate(order, 1)}


def test_groups_far_apart_find_each_other(spark):
    rows = [(1, 1, 0, 0.0, 0.0), (2, 2, 0, 3e9, 4e9), (3, 3, 1, 5.0, 5.0), (4, 4, 0, None, 0.0), (5, 5, 0, float("nan"), 0.0)]
    got = joins.nearest_group(spark.createDataFrame(rows, "id long, groupid long, stateid long, x double, y double")).collect()
    assert {(r.groupid, r.other, r.dist) for r in got} == {(1, 2, 5e9), (2, 1, 5e9)}


def test_groups_without_an_id_or_a_state(spark):
    rows = [(1, 1, 0, 0.0, 0.0), (2, None, 0, 1.0, 0.0), (3, 3, 0, 5.0, 0.0), (4, 4, None, 2.0, 0.0), (5, None, None, 3.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, groupid long, stateid long, x double, y double")
    assert {(r.groupid, r.other, r.dist) for r in joins.nearest_group(df).collect()} == {(1, 3, 5.0), (3, 1, 5.0)}
    assert {(r.id0, r.id1) for r in forest.link_islands(df).collect()} == {(1, 3), (3, 1)}
    assert joins.nearest_group(df.limit(0)).count() == 0


def test_boxes_of_mixed_sizes(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        w, h = (rng.choice([0, 0.3, 1, 7, 60, 4000]) * rng.random() for _ in "wh")
        x, y = rng.uniform(-300, 300), rng.uniform(-300, 300)
        rows.append((i, x, y, x + w, y + h))
    rows += [(900, -1e7, -1e7, 1e7, 1e7), (901, 0.0, 0.0, 0.0, 0.0), (902, 4.0, 4.0, 8.0, 8.0), (903, 8.0, 8.0, 12.0, 16.0)]
    df = spark.createDataFrame(rows, "id long, minx double, miny double, maxx double, maxy double")
    for touching in (True, False):
        meets = (lambda a, b: a <= b) if touching else (lambda a, b: a < b)
        want = {(a[0], b[0]) for a in rows for b in rows if meets(a[1], b[3]) and meets(b[1], a[3]) and meets(a[2], b[4]) and meets(b[2], a[4])}
        got = [(r.id0, r.id1) for r in joins.bbox_join(df, df, 2.0, touching).collect()]
        assert len(got) == len(want) and set(got) == want
    cells = joins._in_cells(df, "0", spark.range(1).selectExpr("array(0, 3, 9) as _levels"), 2.0)
    assert cells.groupBy("id0").count().agg(F.max("count")).first()[0] <= 16
