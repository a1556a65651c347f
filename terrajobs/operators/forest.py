"""Flow forests by pointer doubling: deep chains take a logarithmic number of rounds.

A forest is (id, parentid); a null parent is a root. A parent that is no row counts as none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrajobs.functions.rings import closest_point_on_ring, contains_point, ring_centroid
from terrajobs.functions.scalars import planar_distance
from terrajobs.operators.components import component_labels
from terrajobs.operators.ordering import best_per
from terrajobs.storage import discard, stash


def jump_table(nodes: DataFrame, extra: dict[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """(id, at, steps, closed, extras): each node's ancestor after doubling until all stop.

    ``extra`` maps output names to numeric columns summed along the path (the node itself
    included, the root too). ``closed`` is false for nodes that never reach a root, which lie
    on or above a cycle; rounds end when nothing but those moves.
    """
    names = list(extra or {})
    wide = lambda k: F.col(extra[k]).cast("double" if dict(nodes.dtypes)[extra[k]] in ("double", "float") else "long").alias(k)
    known = nodes.select(F.col("id").alias("parentid"), F.lit(True).alias("_known")).distinct()
    up = F.when(F.col("_known"), F.col("parentid"))
    # sums cover the path from the node up to, but without, next; all of it once next is null
    table = stash(nodes.join(known, "parentid", "left").select("id", up.alias("next"), F.col("id").alias("at"), up.isNotNull().cast("long").alias("steps"), *[wide(k) for k in names]), "jump")
    rounds = table.count().bit_length() + 1 if limit is None else limit
    for _ in range(rounds):
        if not table.filter("next is not null").limit(1).count():
            break
        above = table.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), *[F.col(n).alias(f"_{n}") for n in names])
        gain = lambda c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
        new = stash(table.join(above, "next", "left").select("id", F.col("_next").alias("next"), F.coalesce("_at", "at").alias("at"), gain("steps"), *[gain(n) for n in names]), "jump")
        discard(table)
        table = new
    return table.select("id", "at", "steps", F.col("next").isNull().alias("closed"), *names)


def forest_roots(nodes: DataFrame) -> DataFrame:
    """(id, root, depth); nodes that never reach a root have null root and depth."""
    return jump_table(nodes).select("id", F.when(F.col("closed"), F.col("at")).alias("root"), F.when(F.col("closed"), F.col("steps")).alias("depth"))


def find_cycles(nodes: DataFrame) -> DataFrame:
    """(id) of nodes that never reach a root."""
    return jump_table(nodes).filter("not closed").select("id")


def path_sums(nodes: DataFrame, values: dict[str, str]) -> DataFrame:
    """(id, root, depth, sums over the path from the node to its root, both included)."""
    t = jump_table(nodes, values)
    return t.filter("closed").select("id", F.col("at").alias("root"), F.col("steps").alias("depth"), *values)


def path_max(nodes: DataFrame, value: str) -> DataFrame:
    """(id, root, most): the largest value on the path from the node to its root. Nodes that
    never reach a root have no row."""
    table = stash(nodes.select("id", F.col("parentid").alias("next"), F.col("id").alias("at"), F.col(value).alias("most")), "pathmax")
    for _ in range(table.count().bit_length() + 1):
        if not table.filter("next is not null").limit(1).count():
            break
        up = table.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("at").alias("_at"), F.col("most").alias("_most"))
        new = stash(table.join(up, "next", "left").select("id", F.col("_next").alias("next"), F.coalesce("_at", "at").alias("at"), F.greatest("most", "_most").alias("most")), "pathmax")
        discard(table)
        table = new
    return table.filter("next is null").select("id", F.col("at").alias("root"), "most")


def path_least(nodes: DataFrame, value: str) -> DataFrame:
    """(id, root, least): the least value on the path from the node to its root, nulls left out.
    Values may be structs. Nodes that never reach a root have no row."""
    known = nodes.select(F.col("id").alias("parentid"), F.lit(True).alias("_known")).distinct()
    table = stash(nodes.join(known, "parentid", "left").select("id", F.when(F.col("_known"), F.col("parentid")).alias("next"), F.col("id").alias("at"), F.col(value).alias("least")), "pathleast")
    for _ in range(table.count().bit_length() + 1):
        if not table.filter("next is not null").limit(1).count():
            break
        up = table.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("at").alias("_at"), F.col("least").alias("_least"))
        new = stash(table.join(up, "next", "left").select("id", F.col("_next").alias("next"), F.coalesce("_at", "at").alias("at"), F.least("least", "_least").alias("least")), "pathleast")
        discard(table)
        table = new
    return table.filter("next is null").select("id", F.col("at").alias("root"), "least")


def subtree_sum(nodes: DataFrame, value: str, name: str = "total") -> DataFrame:
    """(id, total): each node's value and those of all nodes above it.

    Round k adds to each node the sums of the nodes that jump to it in 2**k steps. Sums are
    aggregated before they meet, so a node with very many children is no burden. Nodes that
    never reach a root, which lie on or above a cycle, have a null total.
    """
    known = nodes.select(F.col("id").alias("parentid")).distinct()
    table = stash(nodes.join(known.withColumn("_known", F.lit(True)), "parentid", "left").select("id", F.when(F.col("_known"), F.col("parentid")).alias("jump"), F.col(value).alias("s")), "subtree")
    for _ in range(table.count().bit_length() + 1):
        if not table.filter("jump is not null").limit(1).count():
            break
        gain = table.filter("jump is not null").groupBy(F.col("jump").alias("id")).agg(F.sum("s").alias("g"))
        nxt = table.select(F.col("id").alias("jump"), F.col("jump").alias("j2"))
        new = stash(table.join(gain, "id", "left").join(nxt, "jump", "left").select("id", F.col("j2").alias("jump"), (F.col("s") + F.coalesce("g", F.lit(0))).alias("s")), "subtree")
        discard(table)
        table = new
    return table.select("id", F.when(F.col("jump").isNull(), F.col("s")).alias(name))


def ancestors(nodes: DataFrame) -> list[DataFrame]:
    """Tables (id, up) of each node's ancestor in 1, 2, 4 … steps, the last one empty. Nodes on
    or above a cycle are followed as far as a path of all nodes could reach."""
    known = nodes.select(F.col("id").alias("parentid")).distinct()
    jumps = [stash(nodes.join(known, "parentid", "left_semi").select("id", F.col("parentid").alias("up")), "jump")]
    most = jumps[0].count()
    while most and 1 << (len(jumps) - 1) <= most:
        last = jumps[-1]
        jumps.append(stash(last.join(last.select(F.col("id").alias("up"), F.col("up").alias("up2")), "up").select("id", F.col("up2").alias("up")), "jump"))
        if not jumps[-1].limit(1).count():
            break
    return jumps


class Downstream:
    """Sums over branches kept up to date: what changes at some nodes is added to all nodes
    below them, with work that grows with those nodes and not with the forest.

    Each node's ancestors in 1, 2, 4 … steps are tabulated once. A change starts as steps of a
    power of two that cover its path; from the longest steps to the single ones each is
    split into two of half its length, and changes of one node and length are added up.
    """

    def __init__(self, nodes: DataFrame) -> None:
        places = forest_roots(nodes).filter("depth is not null").select("id", F.col("depth").alias("rest"))
        self.places, self.jumps = stash(places, "places"), ancestors(nodes)

    def push(self, changes: DataFrame, values: list[str]) -> DataFrame:
        """(id, values): what the changes (id, values) add to each node at or below theirs.
        Changes of nodes outside the forest, or on a cycle, are left out."""
        sums = [F.sum(v).alias(v) for v in values]
        walk = changes.groupBy("id").agg(*sums).join(self.places, "id").withColumn("rest", F.col("rest") + 1)  # nodes still to cover
        steps = None
        for k in range(len(self.jumps), -1, -1):
            here = walk.filter(F.col("rest") >= 1 << k)
            if k < len(self.jumps):  # a step of twice this length is one of this, and one further on
                again = steps.join(self.jumps[k], "id").select(F.col("up").alias("id"), *values) if steps is not None else None
                now = here.select("id", *values) if steps is None else here.select("id", *values).unionByName(steps).unionByName(again)
            else:
                now = here.select("id", *values)
            steps = stash(now.groupBy("id").agg(*sums), "steps")
            if k:
                jump = self.jumps[k] if k < len(self.jumps) else None
                moved = here.select("id", F.col("rest") - (1 << k), *values).toDF("id", "rest", *values)
                if jump is not None:
                    moved = moved.join(jump, "id").select(F.col("up").alias("id"), "rest", *values)
                walk = stash(walk.filter(F.col("rest") < 1 << k).unionByName(moved.filter("rest > 0").select(*walk.columns)), "walk")
        return steps


def reroot(nodes: DataFrame, at: DataFrame) -> DataFrame:
    """Hang trees anew: for each (node, new_parent) of ``at``, one a tree at most, the node
    goes under the new parent and the pointers from it to its old root are reversed."""
    path = stash(at.select(F.col("node").alias("id"), F.col("new_parent").alias("under")), "path")
    # path nodes: those whose subtree holds the node; found upwards by doubling over ancestors
    marks = nodes.join(path.select("id", F.lit(1).alias("_m")), "id", "left").select("id", "parentid", F.coalesce("_m", F.lit(0)).alias("m"))
    on = subtree_sum(marks, "m", "m").filter("m > 0").select("id")
    steps = nodes.join(on, "id", "left_semi").filter("parentid is not null").select(F.col("parentid").alias("id"), F.col("id").alias("_turned"))
    rows = nodes.join(steps, "id", "left").join(path, "id", "left")
    return rows.withColumn("parentid", F.coalesce("under", "_turned", "parentid")).select(*nodes.columns)


def branch_roots(tree: DataFrame, size: float) -> DataFrame:
    """Roots of branches that can hold one district: (id, last).

    Takes (id, parentid, closed, branchpopulation). A node counts if its branch holds at
    least ``size`` and no open child more than ``size``; a tree's root counts as the last
    district if it holds less than 1.5 times ``size``, and nothing above it then. Nodes are
    reached from the root through open children holding more than ``size`` only, so results
    of one tree never lie above one another.
    """
    children = tree.filter("not closed and parentid is not null").groupBy(F.col("parentid").alias("id")).agg(F.max("branchpopulation").alias("most"))
    rows = tree.join(children, "id", "left").withColumn("last", F.expr(f"parentid is null and branchpopulation < 1.5 * {size}"))
    hits = rows.filter(f"not closed and (branchpopulation >= {size} or last) and (last or coalesce(most, 0) <= {size})").select("id", "parentid", "last", "branchpopulation")
    # reached: the node is a root, or every node from it downwards but the root holds more than size and is open
    shut = stash(tree.select("id", "parentid", F.expr(f"cast(parentid is not null and (closed or branchpopulation <= {size}) as int)").alias("bad")), "shut")
    roots = stash(rows.filter("parentid is null").select("id", "last"), "lastroots")
    reach = path_sums(shut, {"bad": "bad"}).join(roots.select(F.col("id").alias("root"), F.col("last").alias("_stop")), "root").filter("bad = 0 and (depth = 0 or not _stop)").select("id")
    return hits.join(reach, "id", "left_semi").select("id", "last")


def boundary_paths(tree: DataFrame) -> DataFrame:
    """(id, parentid): the forest without links into nodes off the boundary."""
    rim = tree.filter("boundary").select(F.col("id").alias("parentid"), F.lit(True).alias("_rim"))
    return tree.select("id", "parentid").join(rim, "parentid", "left").select("id", F.when(F.col("_rim"), F.col("parentid")).alias("parentid"))


def next_downstream(tree: DataFrame, starts: DataFrame, size: float, boundary_only: bool = False, own: bool = False, jumps: list[DataFrame] | None = None) -> DataFrame:
    """(id, found): from each start (id, need), the first node downstream, itself not
    counted, whose branch holds need + size; else the root. With ``own`` the start counts.

    With ``boundary_only`` the walk ends at the last node before one off the boundary.
    Branches only grow downstream, so ancestors in falling powers of two are tried; ``jumps``
    are those tables (``ancestors``) where they are known already.
    """
    held = stash(tree.select(F.col("id").alias("up"), F.col("branchpopulation").alias("b")), "held")
    walk = starts.select("id", F.col("id").alias("at"), (F.col("need") + size).alias("most"))
    if jumps is None:
        jumps = ancestors(boundary_paths(tree) if boundary_only else tree.select("id", "parentid"))
    for jump in reversed(jumps):
        ahead = jump.join(held, "up").select(F.col("id").alias("at"), "up", "b")
        walk = stash(walk.join(ahead, "at", "left").select("id", F.when(F.col("b") < F.col("most"), F.col("up")).otherwise(F.col("at")).alias("at"), "most"), "walk")
    last = walk.join(jumps[0].withColumnRenamed("id", "at"), "at", "left").select("id", F.coalesce("up", "at").alias("found"), "most")
    if own:
        last = last.join(held.withColumnRenamed("up", "id"), "id", "left").withColumn("found", F.when(F.col("b") >= F.col("most"), F.col("id")).otherwise(F.col("found")))
    return last.select("id", "found")


def close_branches(tree: DataFrame, open_count: str = "openblocks") -> DataFrame:
    """(id, closed): the branch holds no open block."""
    return subtree_sum(tree, open_count, "n").select("id", (F.col("n") == 0).alias("closed"))


def river_lines(tree: DataFrame) -> DataFrame:
    """(id, kind, x0, y0, x1, y1): child exit to parent exit, and a leaf's centre to its exit.

    Takes (id, parentid, x, y, cx, cy)."""
    up = tree.select(F.col("id").alias("parentid"), F.col("x").alias("px"), F.col("y").alias("py"))
    flow = tree.join(up, "parentid").selectExpr("id", "'flow' as kind", "x as x0", "y as y0", "px as x1", "py as y1")
    leaves = tree.join(tree.filter("parentid is not null").select(F.col("parentid").alias("id")).distinct(), "id", "left_anti").selectExpr("id", "'leaf' as kind", "cx as x0", "cy as y0", "x as x1", "y as y1")
    return flow.unionByName(leaves)


def link_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, x0, y0, x1, y1) between the centres of linked nodes (id, cx, cy), once each."""
    end = lambda k, c: nodes.select(F.col("id").alias(c), F.col("cx").alias(f"x{k}"), F.col("cy").alias(f"y{k}"))
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().join(end(0, "src"), "src").join(end(1, "dst"), "dst").select("src", "dst", "x0", "y0", "x1", "y1")


def basin_crossings(tree: DataFrame, ws: DataFrame) -> DataFrame:
    """(id, parentid): links of the tree whose ends were in different basins."""
    old = lambda c, n: ws.select(F.col("id").alias(c), F.col("basinid").alias(n))
    return tree.select("id", "parentid").join(old("id", "b0"), "id").join(old("parentid", "b1"), "parentid").filter("b0 <> b1").select("id", "parentid")


def flow_reversals(tree: DataFrame, source: DataFrame) -> DataFrame:
    """(id, parentid): links of the tree that run against a link of the source."""
    back = source.select(F.col("parentid").alias("id"), F.col("id").alias("parentid"))
    return tree.select("id", "parentid").join(back, ["id", "parentid"], "left_semi")


def absorb_dead_ends(polys: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, into): polygons with one neighbour left, smaller than it, merge into it, round
    after round; chains are resolved to the last one. Takes polys (id, area), edges (src, dst)."""
    area, live, merged = polys.select("id", "area"), stash(edges.select("src", "dst").filter("src <> dst").distinct(), "live"), None
    while True:
        only = live.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.min("dst").alias("into")).filter("n = 1")
        sized = only.join(area, "id").join(area.select(F.col("id").alias("into"), F.col("area").alias("a1")), "into").filter("area < a1 or (area = a1 and id > into)")
        new = stash(sized.select("id", "into"), "absorbed")
        if not new.limit(1).count():
            break
        merged = new if merged is None else merged.unionByName(new)
        gone = new.select("id")
        live = stash(live.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti"), "live")
    if merged is None:
        return polys.select("id", F.col("id").alias("into")).limit(0)
    chain = stash(merged, "chain")
    nodes = chain.select("id", F.col("into").alias("parentid")).unionByName(chain.select(F.col("into").alias("id")).distinct().join(chain, "id", "left_anti").select("id", F.lit(None).cast("long").alias("parentid")))
    return forest_roots(nodes).filter("id <> root").select("id", F.col("root").alias("into"))


def link_islands(members: DataFrame) -> DataFrame:
    """(id0, id1, both ways): links that join each state's groups into one.

    Takes (id, groupid, stateid, x, y). In every round each group links to its nearest other
    one, and linked groups become one.
    """
    from terrajobs.operators.joins import nearest_group

    rest, out = stash(members.filter("groupid is not null").select("id", "groupid", "stateid", "x", "y"), "members"), None
    while True:
        new = nearest_group(rest, either_way=True)  # one order of links for all, so none closes a circle
        new = stash(new, "links")
        if not new.limit(1).count():
            break
        both = new.select("id0", "id1").union(new.select("id1", "id0"))
        out = both if out is None else out.union(both)
        labels = component_labels(rest.select(F.col("groupid").alias("id")), new, "id", "groupid", "other")
        rest = stash(rest.join(labels.select(F.col("id").alias("groupid"), "component"), "groupid").select("id", F.col("component").alias("groupid"), "stateid", "x", "y"), "members")
    return out.distinct() if out is not None else members.select(F.col("id").alias("id0"), F.col("id").alias("id1")).limit(0)


# --- descents and basin links ----------------------------------------------------------


def preferred_flow_type(crossings: DataFrame, order: tuple[int, ...] = (558, 460, 420, 334)) -> DataFrame:
    """(id, class, parent): the first class in the order that leads to exactly one parent
    above 0. Takes (id, class, parent)."""
    one = crossings.filter("parent > 0").groupBy("id", "class").agg(F.count_distinct("parent").alias("n"), F.min("parent").alias("parent")).filter("n = 1")
    rank = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("class").cast("int"))
    return one.withColumn("_r", rank).filter("_r > 0").groupBy("id").agg(F.min_by(F.struct("class", "parent"), "_r").alias("b")).select("id", "b.class", "b.parent")


def descent_distances(tree: DataFrame, links: DataFrame) -> DataFrame:
    """(wsid0, wsid1, descent, boundary_descent) for neighbours in different basins.

    Takes tree (id, parentid, exitdist: to the parent's exit, boundary) and links (wsid0,
    wsid1, outside). The distance runs from the neighbour's edge to the watershed's exit,
    then along exits to the root; the second sum counts boundary watersheds only, and its
    outside part only if both sides are on the boundary. A parent that is no neighbour
    has distance 0, and so has a root.
    """
    t = stash(tree.select("id", "parentid", F.coalesce("exitdist", F.lit(0.0)).alias("d"), F.when(F.col("boundary"), F.coalesce("exitdist", F.lit(0.0))).otherwise(0.0).alias("bd"), "boundary"), "descent")
    sums = stash(path_sums(t, {"sd": "d", "sb": "bd"}).join(t.select("id", "boundary"), "id"), "sums")
    own = sums.select(F.col("id").alias("wsid0"), F.col("root").alias("r0"), "sd", "sb", F.col("boundary").alias("b0"))
    far = sums.select(F.col("id").alias("wsid1"), F.col("root").alias("r1"), F.col("boundary").alias("b1"))
    rows = links.join(own, "wsid0").join(far, "wsid1").filter("r0 <> r1")
    return rows.select("wsid0", "wsid1", F.col("r0").alias("basin0"), F.col("r1").alias("basin1"), (F.col("outside") + F.col("sd")).alias("descent"), (F.when(F.col("b0") & F.col("b1"), F.col("outside")).otherwise(0.0) + F.col("sb")).alias("boundary_descent"))


def best_basin_links(scores: DataFrame) -> DataFrame:
    """The cheapest watershed pair of each ordered pair of basins."""
    inland = scores.withColumn("_inland", F.col("descent") - F.col("boundary_descent"))
    return best_per(inland, ["basin0", "basin1"], ["_inland", "descent", "island_area", "-length", "wsid0", "wsid1"]).drop("_inland")


def merge_basins(tree: DataFrame, links: DataFrame) -> DataFrame:
    """(id, parentid, basinid, rootbasinid): the basins of each component as one tree.

    Takes tree (id, parentid, exitdist) and links (wsid0, wsid1, both ways). A link hangs
    basin0 under wsid1 by reversing the path from wsid0 to its root, and costs the longest
    exit distance on it. In each round every tree picks its cheapest link out, ties by ids;
    of two trees that pick each other the one of larger root id moves, so no cycle can form
    among trees ordered by cost and ids. Path costs are computed anew each round.
    """
    tree = stash(tree.select("id", "parentid", F.coalesce("exitdist", F.lit(0.0)).alias("exitdist")), "tree")
    original = forest_roots(tree).select("id", F.col("root").alias("basinid"))
    now = tree
    while True:
        cost = stash(path_max(now, "exitdist"), "cost")
        side = lambda k: cost.select(F.col("id").alias(f"wsid{k}"), F.col("root").alias(f"r{k}"), F.col("most").alias(f"m{k}"))
        open_ = links.select("wsid0", "wsid1").join(side(0), "wsid0").join(side(1), "wsid1").filter("r0 <> r1")
        # one weight per undirected link makes the picks acyclic but for mutual ones
        weight = F.struct(F.least("m0", "m1").alias("w"), F.least("wsid0", "wsid1").alias("a"), F.greatest("wsid0", "wsid1").alias("b"))
        pick = stash(open_.withColumn("w", weight).groupBy("r0").agg(F.min(F.struct("w", "wsid0", "wsid1", "r1")).alias("p")).select("r0", "p.wsid0", "p.wsid1", "p.r1", "p.w"), "pick")
        if not pick.limit(1).count():
            break
        mutual = pick.select(F.col("r1").alias("r0"), F.col("r0").alias("r1"), "w")
        moves = pick.join(mutual.withColumn("_m", F.lit(True)), ["r0", "r1", "w"], "left").filter("_m is null or r0 > r1")
        now = stash(reroot(now, moves.select(F.col("wsid0").alias("node"), F.col("wsid1").alias("new_parent"))), "tree")
    final = forest_roots(now).select("id", F.col("root").alias("rootbasinid"))
    return now.select("id", "parentid").join(original, "id").join(final, "id")


def exit_points(ws: DataFrame, crossings: DataFrame, interfaces: DataFrame, rings: DataFrame | None = None, lakes: DataFrame | None = None) -> DataFrame:
    """(id, parent, x, y, step): where each watershed's water leaves.

    Takes ws (id, parentid: the source's link, boundary), crossings (id, parent, x, y: of
    rivers with shared edges, parent 0 outside, optionally class, the flow type), and
    interfaces (id, neighbor, x, y, length): points of shared edges, neighbour 0 outside. A
    point of an exit is always one of its interface. With ``rings`` (id, ring), a root inside, a
    closed basin, gets its exit first (step 0): the mean of its ``lakes`` (id, x, y), or its own
    centre without any, moved to the nearest point of its polygon. Then, in order:

    1. the interface point nearest to the mean of the crossings into the linked parent, of
       its preferred flow type if classes are given (``preferred_flow_type``);
    2. for roots on the boundary, the outer point nearest to the mean of the outer crossings,
       or of the outer interfaces where there are none;
    3. for children that touch their parent, the nearest crossing into a neighbour common to
       both, and the parent's interface point nearest to it;
    4. for children inside that do not touch their parent, no parent, and their own point
       nearest to one of the parent's;
    5. and on, round by round: the linked parent's interface point nearest to its exit, once
       it has one.

    Distances equal to six places go to the longer interface, then to the smaller point.
    Without ``rings`` a root inside, and what hangs on one, gets no row without a crossing of
    its own.
    """
    linked = ws.filter("parentid is not null").select("id", F.col("parentid").alias("parent"))
    faces = interfaces.select("id", F.col("neighbor").alias("parent"), "x", "y", "length")
    order = ["dist", "-length", "x", "y"]
    into = crossings.join(linked, ["id", "parent"])
    if "class" in crossings.columns:
        into = into.join(preferred_flow_type(into.select("id", "class", "parent")), ["id", "class", "parent"], "left_semi")

    def nearest(targets: DataFrame, step: int) -> DataFrame:
        """The point of each (id, parent)'s interface nearest to its target (tx, ty)."""
        near = best_per(faces.join(targets, ["id", "parent"]).withColumn("dist", F.round(planar_distance("x", "y", "tx", "ty"), 6)), ["id"], order)
        return near.select("id", "parent", "x", "y", F.lit(step).alias("step"))

    def mean(points: DataFrame) -> DataFrame:
        return points.groupBy("id", "parent").agg(F.avg("x").alias("tx"), F.avg("y").alias("ty"))

    done = nearest(mean(into), 1)
    rim = faces.filter("parent = 0").join(ws.filter("parentid is null and boundary").select("id"), "id", "left_semi")
    leaving = mean(crossings.filter("parent = 0").select("id", "parent", "x", "y").join(rim.select("id"), "id", "left_semi"))
    out = nearest(leaving.unionByName(mean(rim).join(leaving, "id", "left_anti")), 2).withColumn("parent", F.lit(None).cast("long"))
    done = done.unionByName(out)
    if rings is not None:
        seas = (lakes if lakes is not None else rings.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).limit(0)).groupBy("id").agg(F.avg("x").alias("lx"), F.avg("y").alias("ly"))
        closed = ws.filter("parentid is null and not boundary").select("id").join(rings.select("id", "ring"), "id").join(seas, "id", "left")
        aimed = closed.withColumn("c", ring_centroid(F.col("ring"))).select("id", "ring", F.coalesce("lx", "c.x").alias("tx"), F.coalesce("ly", "c.y").alias("ty"))
        edge = aimed.withColumn("in", contains_point(F.col("ring"), F.col("tx"), F.col("ty"))).withColumn("e", closest_point_on_ring("tx", "ty", F.col("ring")))
        none = F.lit(None).cast("long")
        done = done.unionByName(edge.select("id", none.alias("parent"), F.when(F.col("in"), F.col("tx")).otherwise(F.col("e.x")).alias("x"), F.when(F.col("in"), F.col("ty")).otherwise(F.col("e.y")).alias("y"), F.lit(0).alias("step")))
    done = stash(done, "exits")

    open_ = linked.join(done, "id", "left_anti")
    touching = open_.join(faces.select("id", "parent"), ["id", "parent"], "left_semi")
    met = faces.filter("parent <> 0").select("id", F.col("parent").alias("via")).distinct()
    common = touching.join(met, "id").join(met.select(F.col("id").alias("parent"), "via"), ["parent", "via"], "left_semi")
    seen = common.join(crossings.select("id", F.col("parent").alias("via"), F.col("x").alias("tx"), F.col("y").alias("ty")), ["id", "via"])
    third = nearest(seen.select("id", "parent", "tx", "ty"), 3)
    apart = open_.join(ws.filter("not boundary").select("id"), "id", "left_semi").join(touching, ["id", "parent"], "left_anti")
    theirs = faces.select(F.col("id").alias("parent"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    pairs = apart.join(faces.drop("parent"), "id").join(theirs, "parent").withColumn("dist", F.round(planar_distance("x", "y", "tx", "ty"), 6))
    fourth = best_per(pairs, ["id"], order).select("id", F.lit(None).cast("long").alias("parent"), "x", "y", F.lit(4).alias("step"))
    done = stash(done.unionByName(third).unionByName(fourth), "exits")

    step = 5
    while True:
        exits = done.select(F.col("id").alias("parent"), F.col("x").alias("tx"), F.col("y").alias("ty"))
        new = stash(nearest(touching.join(done, "id", "left_anti").join(exits, "parent"), step), "front")
        if not new.limit(1).count():
            return done
        done, step = stash(done.unionByName(new), "exits"), step + 1
