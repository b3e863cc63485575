"""Iterative graph operators: components, dependency levels, reduction, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.joins import lookup_join, number_rows
from folioscope.staging import Stage, stage


def connected_components(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Components of an undirected graph: (node, component), component being its least node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each round moves every
    edge towards the least neighbour, until the edges form stars, which they always come to.
    Minimums are aggregated before they are joined back, and hot nodes are salted. Both steps
    of a round are written to the two folders of one stage in turn.
    """
    table = Stage(edges.sparkSession, "components")
    a, b = F.col(source), F.col(target)
    pairs = table.write(
        edges.where(a != b)
        .select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent"))
        .distinct()
    )
    while not _is_star_forest(pairs):
        pairs = table.write(_small_star(table.write(_large_star(pairs))))
    roots = pairs.select(F.col("parent").alias("node"), F.col("parent").alias("component"))
    members = pairs.select(F.col("child").alias("node"), F.col("parent").alias("component"))
    return members.unionByName(roots.distinct())


def _large_star(pairs: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the node's least neighbour."""
    ends = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("child").alias("node"), F.col("parent").alias("other")),
                F.struct(F.col("parent").alias("node"), F.col("child").alias("other")),
            )
        ).alias("e")
    ).select("e.*")
    least = ends.groupBy("node").agg(F.min("other").alias("m"))
    lookup = least.select(F.col("node").alias("parent"), F.least("node", "m").alias("m"))
    return lookup_join(pairs, lookup, "parent", "inner", staged=True).select("child", F.col("m").alias("parent"))


def _small_star(pairs: DataFrame) -> DataFrame:
    """Connect every smaller neighbour of a node, and the node, to the least of them."""
    least = pairs.groupBy("child").agg(F.min("parent").alias("m"))
    moved = (
        lookup_join(pairs, least, "child", "inner", staged=True)
        .where(F.col("parent") != F.col("m"))
        .select(F.col("parent").alias("child"), F.col("m").alias("parent"))
    )
    return moved.unionByName(least.select("child", F.col("m").alias("parent"))).distinct()


def _is_star_forest(pairs: DataFrame) -> bool:
    """Every child has one parent, and no parent is a child."""
    roles = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("child").alias("node"), F.lit(1).alias("as_child")),
                F.struct(F.col("parent").alias("node"), F.lit(0).alias("as_child")),
            )
        ).alias("r")
    ).select("r.*")
    bad = (
        roles.groupBy("node")
        .agg(F.sum("as_child").alias("parents"), F.min("as_child").alias("lowest"))
        .where((F.col("parents") > 1) | ((F.col("parents") > 0) & (F.col("lowest") == 0)))
    )
    return bad.isEmpty()


class UnresolvedTasksError(ValueError):
    """Tasks that wait for each other or for a task that does not exist."""

    def __init__(self, blocked: DataFrame):
        self.blocked = blocked
        shown = [f"{r['id']} -> {r['dep']}" for r in blocked.orderBy("id", "dep").take(20)]
        super().__init__(f"circular dependency or missing tasks, among them: {shown}")


def missing_dependencies(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Dependencies on tasks that do not exist."""
    known = tasks.select(F.col("id").alias("dep")).distinct()
    return deps.join(known, "dep", "left_anti").select("id", "dep")


def ready_tasks(tasks: DataFrame, deps: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks not yet done all of whose dependencies are done."""
    finished = done.select(F.col("id").alias("dep"), F.lit(True).alias("done"))
    status = (
        lookup_join(deps.select("id", "dep"), finished, "dep", "left")
        .groupBy("id")
        .agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("all_done"))
    )
    return (
        tasks.join(done.select("id"), "id", "left_anti")
        .join(status, "id", "left")
        .where(F.coalesce("all_done", F.lit(True)))
        .select(*tasks.columns)
    )


def _chains(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root, hops, floor): tasks of one dependency each, followed down to a task of none or several.

    Pointer doubling: a chain of n tasks takes log2(n) rounds. Raises if a chain is a circle. Edges may
    have ``hops`` and tasks a ``floor``; the level of a task is that of its root and the hops, but its
    floor at least.
    """
    table = Stage(tasks.sparkSession, "chains")
    if "hops" not in edges.columns:
        edges = edges.withColumn("hops", F.lit(1))
    if "floor" not in tasks.columns:
        tasks = tasks.withColumn("floor", F.lit(0))
    single = edges.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("up"), F.max("hops").alias("hops"))
    single = single.where("n = 1").select("id", "up", "hops")
    known = table.write(tasks.join(single, "id", "left").select("id", "up", F.coalesce("hops", F.lit(0)).alias("hops"), "floor"))
    length, total = 1, known.count()
    while True:
        ahead = known.where(F.col("up").isNotNull()).select(
            F.col("id").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("more"), F.col("floor").alias("floor2")
        ).hint("merge")
        if known.join(ahead.select("up").hint("merge"), "up", "left_semi").isEmpty():
            return known.select("id", F.coalesce("up", "id").alias("root"), "hops", "floor")
        if length > total:
            raise UnresolvedTasksError(edges)
        length *= 2
        moved = lookup_join(known, ahead, "up", "left", staged=True)
        known = table.write(
            moved.select(
                "id",
                F.coalesce("up2", "up").alias("up"),
                (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
                F.greatest("floor", F.col("hops") + F.col("floor2")).alias("floor"),
            )
        )


def dependency_levels(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Execution level per task, from 0; raises on a cycle or a missing task.

    Each round folds chains of tasks that wait for one task each by pointer doubling, merges what
    then are several ways to the same task, and places tasks that wait for none; a dependency that
    is placed becomes a floor under the level, so that its task may be in a chain of the next round.
    Long ladders so take few rounds; at most there are as many as tasks of several dependencies on
    the longest path. Levels of folded tasks follow from their roots, last fold first.
    """
    spark = tasks.sparkSession
    tasks = stage(tasks.select("id").distinct(), "tasks")
    edges = stage(deps.select("id", "dep").join(tasks, "id", "left_semi").distinct(), "deps")
    lost = edges.join(tasks.select(F.col("id").alias("dep")), "dep", "left_anti").select("id", "dep")
    if not lost.isEmpty():
        raise UnresolvedTasksError(lost)
    task_table, edge_table, level_table = (Stage(spark, n) for n in ("open-tasks", "open-deps", "levels"))
    waiting = edge_table.write(edges.withColumn("hops", F.lit(1)))
    open_tasks = task_table.write(tasks.withColumn("floor", F.lit(0)))
    left, folds, levels = open_tasks.count(), [], None
    while left:
        chains = stage(_chains(open_tasks, waiting), "chains")
        roots = chains.where("id = root").select("id", "floor")
        below = chains.select(F.col("id").alias("dep"), "root", F.col("hops").alias("more"), F.col("floor").alias("least"))
        ways = stage(
            lookup_join(waiting.join(roots.select("id"), "id", "left_semi"), below, "dep", "inner")
            .groupBy("id", "root")
            .agg(F.max(F.col("hops") + F.col("more")).alias("hops"), F.max(F.col("hops") + F.col("least")).alias("least")),
            "ways",
        )
        fresh = stage(roots.join(ways.select("id"), "id", "left_anti").select("id", F.col("floor").alias("level")), "placed")
        folded = chains.where("id <> root")
        levels = level_table.write(fresh if levels is None else levels.unionByName(fresh))
        if not folded.isEmpty():
            folds.append(folded)
        placed = fresh.select(F.col("id").alias("root"), F.col("level").alias("placed"))
        joined = stage(lookup_join(ways, placed, "root", "left", staged=True), "placing")
        floors = joined.groupBy("id").agg(F.max(F.greatest("least", F.col("placed") + F.col("hops"))).alias("called"))
        open_tasks = task_table.write(roots.join(floors, "id").select("id", F.greatest("floor", "called").alias("floor")))
        waiting = edge_table.write(joined.where("placed IS NULL").select("id", F.col("root").alias("dep"), "hops"))
        before, left = left, open_tasks.count()
        if left == before:
            raise UnresolvedTasksError(waiting)
    for folded in reversed(folds):
        above = lookup_join(folded, levels.select(F.col("id").alias("root"), "level"), "root", "inner", staged=True)
        levels = level_table.write(
            levels.unionByName(above.select("id", F.greatest("floor", F.col("level") + F.col("hops")).alias("level")))
        )
    return tasks.withColumn("level", F.lit(0)).limit(0) if levels is None else levels.select("id", F.col("level").cast("int").alias("level"))


def order_in_level(tasks: DataFrame, levels: DataFrame) -> DataFrame:
    """Position inside a level: priority from high to low, then id.

    A level may hold a third of all tasks, so positions come from one range-partitioned
    ordering over (level, priority, id) minus the position where the level starts, which is
    looked up by level, of which a long chain may have as many as there are tasks.
    """
    joined = tasks.join(levels, "id").withColumn("_down", -F.col("priority"))
    numbered = stage(number_rows(joined, ["level", "_down", "id"], "_at"), "numbered")
    starts = numbered.groupBy("level").agg(F.min("_at").alias("_start"))
    return lookup_join(numbered, starts, "level", "inner", staged=True).select(
        "level", (F.col("_at") - F.col("_start") + 1).alias("position"), "id", "priority"
    )


def reduce_transitive(edges: DataFrame) -> DataFrame:
    """Drop u -> w when some v has u -> v and v -> w, judged on the edges as given.

    The triples are triangles. Each undirected pair is led from its end of lower degree to the
    end of higher degree, which bounds every fan-out by the square root of the edge count even
    around a module that everybody imports.
    """
    base = stage(edges.where(F.col("source") != F.col("target")).distinct(), "edges")
    ends = base.select(F.explode(F.array("source", "target")).alias("node"))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    ranked = lookup_join(
        base,
        degree.select(F.col("node").alias("source"), F.col("degree").alias("ds")),
        "source",
        "inner",
        staged=True,
    )
    ranked = lookup_join(
        ranked,
        degree.select(F.col("node").alias("target"), F.col("degree").alias("dt")),
        "target",
        "inner",
    )
    s = F.struct(F.col("ds").alias("d"), F.col("source").alias("n"))
    t = F.struct(F.col("dt").alias("d"), F.col("target").alias("n"))
    low = F.when(s < t, s).otherwise(t)
    high = F.when(s < t, t).otherwise(s)
    # One row per undirected pair, with the directions in which it occurs.
    pairs = stage(
        ranked.select(low.alias("low"), high.alias("high"), (s < t).alias("up"))
        .groupBy("low", "high")
        .agg(F.bool_or("up").alias("up"), F.bool_or(~F.col("up")).alias("down")),
        "pairs",
    )
    xy = pairs.select(
        F.col("low").alias("x"), F.col("high").alias("y"), F.struct("up", "down").alias("xy")
    )
    xz = pairs.select(
        F.col("low").alias("x"), F.col("high").alias("z"), F.struct("up", "down").alias("xz")
    )
    yz = pairs.select(
        F.col("low").alias("y"), F.col("high").alias("z"), F.struct("up", "down").alias("yz")
    )
    corners = xy.join(xz, "x").where(F.col("y") < F.col("z")).join(yz, ["y", "z"])
    x, y, z = (F.col(c)["n"] for c in "xyz")
    xy_up, xy_down = F.col("xy")["up"], F.col("xy")["down"]
    xz_up, xz_down = F.col("xz")["up"], F.col("xz")["down"]
    yz_up, yz_down = F.col("yz")["up"], F.col("yz")["down"]

    def closing(u, w, direct, first, second):
        hit = direct & first & second
        return F.when(hit, F.struct(u.alias("source"), w.alias("target")))

    implied = (
        corners.select(
            F.explode(
                F.array_compact(
                    F.array(
                        closing(x, z, xz_up, xy_up, yz_up),
                        closing(z, x, xz_down, yz_down, xy_down),
                        closing(x, y, xy_up, xz_up, yz_down),
                        closing(y, x, xy_down, yz_up, xz_down),
                        closing(y, z, yz_up, xy_down, xz_up),
                        closing(z, y, yz_down, xz_down, xy_up),
                    )
                )
            ).alias("e")
        )
        .select("e.*")
        .distinct()
    )
    return base.join(implied, ["source", "target"], "left_anti")


def _spread(edges: DataFrame, least: DataFrame, named: Column) -> DataFrame:
    """Give every node the least ``label`` of the nodes from which it can be reached, its own included.

    ``named`` is the label that a node starts with.

    Each round takes labels over one edge, and then the label of the node that a label names, which
    lies on the way and often knows a lesser one; so far fewer rounds than edges of a path are needed.
    """
    table = Stage(edges.sparkSession, "labels")
    known = table.write(least)
    while True:
        come = (
            lookup_join(edges, known.select(F.col("node").alias("source"), "label"), "source", "inner", staged=True)
            .groupBy(F.col("target").alias("node"))
            .agg(F.min("label").alias("come"))
        )
        stepped = stage(known.join(come, "node", "left").select("node", F.least("label", "come").alias("label"), F.col("label").alias("before")), "stepped")
        ahead = stepped.select(named.alias("label"), F.col("label").alias("further"))
        moved = lookup_join(stepped, ahead, "label", "left", staged=True).select(
            "node", F.least("label", "further").alias("label"), "before"
        )
        known = table.write(moved)
        if known.where(F.col("label") < F.col("before")).isEmpty():
            return known.select("node", "label")


def _reaching(edges: DataFrame, goals: DataFrame) -> DataFrame:
    """(node): the goals and all nodes from which one of them can be reached."""
    spark = edges.sparkSession
    fresh_table, found_table = Stage(spark, "fresh"), Stage(spark, "reaching")
    found = fresh = found_table.write(goals.select("node").distinct())
    while True:
        # A node counts once, however many of its edges lead to what was found last.
        before = lookup_join(edges, fresh.select(F.col("node").alias("target"), F.lit(True).alias("hit")), "target", "inner", staged=True)
        fresh = fresh_table.write(before.select(F.col("source").alias("node")).distinct().join(found, "node", "left_anti"))
        if fresh.isEmpty():
            return found
        found = found_table.write(found.unionByName(fresh))


def _trimmed(left: DataFrame, table: Stage) -> tuple[DataFrame, int]:
    """The edges that stay when nodes without an edge in or out go, again and again, and their number."""
    rows = left.count()
    while rows:
        both = left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
        left = table.write(both.join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
        before, rows = rows, left.count()
        if rows == before:
            break
    return left, rows


def _circles(links: DataFrame) -> DataFrame:
    """(node, least): the nodes on circles of (node, up), one row a node, and the least node of their circle.

    Pointer doubling: a node to which no path leads, however long, is on no circle, nor is one whose
    path ends. So the nodes become fewer until circles are left, after log2 of the longest path; and
    the least node of a path is known when twice as long a path has no lesser one.
    """
    table = Stage(links.sparkSession, "circles")
    known = table.write(links.select("node", "up", F.col("node").alias("least"), F.lit(True).alias("fell")))
    rows = known.count()
    while rows:
        ahead = known.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("least").alias("further"))
        led_to = known.select(F.col("up").alias("node")).distinct()
        known = table.write(
            lookup_join(known, ahead, "up", "inner", staged=True).join(led_to, "node", "left_semi")
            .select("node", F.col("up2").alias("up"), F.least("least", "further").alias("least"), (F.col("further") < F.col("least")).alias("fell"))
        )
        now = known.agg(F.count(F.lit(1)).alias("n"), F.bool_or("fell").alias("fell")).first()
        before, rows = rows, now.n
        if rows == before and not now.fell:
            break
    return known.select("node", "least")


def _joined(left: DataFrame, into: DataFrame) -> DataFrame:
    """Edges between what nodes are ``into`` (node, into); a node without a row stays itself."""
    for end in ("source", "target"):
        moved = lookup_join(left, into.withColumnRenamed("node", end), end, "left", staged=end == "source")
        left = moved.withColumn(end, F.coalesce("into", end)).drop("into")
    return left.where("source <> target").select("source", "target").distinct()


def strong_components(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(node, component) of a directed graph: nodes that reach each other, named by the least of them.

    Nodes without an edge in or out are components of their own and are trimmed first, again and
    again. Each node left then follows the edge to its least successor; that makes circles, each of
    which becomes one node, its least. Where circles leave more than half of the edges, each node is
    labelled with the first node, by a hash, that reaches it; of the nodes of one label, those that
    reach the labelling node are its component, and edges between labels go, as no component has two.
    The hash keeps labels apart from the order of the graph: a label cuts a long path in the middle
    rather than at its start. Labels of hot nodes are looked up in salted joins.
    """
    spark = edges.sparkSession
    given = stage(edges.select(F.col(source).alias("source"), F.col(target).alias("target")).dropna().distinct(), "graph")
    table, settled_table = Stage(spark, "open-graph"), Stage(spark, "settled")
    ends = lambda df: df.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    left, rows = _trimmed(table.write(given.where("source <> target")), table)
    settled = settled_table.write(ends(given).limit(0).withColumn("component", F.col("node")))
    folds = []
    while rows:
        links = left.groupBy(F.col("source").alias("node")).agg(F.min("target").alias("up"))
        folds.append(stage(_circles(links).where("node <> least").select("node", F.col("least").alias("into")), "folded"))
        before = rows
        left, rows = _trimmed(table.write(_joined(left, folds[-1])), table)
        if rows * 2 <= before:
            continue
        named = F.struct(F.xxhash64("node").alias("h"), "node")
        labels = stage(_spread(left, ends(left).withColumn("label", named), named), "labelled")
        near = lookup_join(left, labels.select(F.col("node").alias("source"), F.col("label").alias("from")), "source", "inner", staged=True)
        alike = stage(
            lookup_join(near, labels.select(F.col("node").alias("target"), F.col("label").alias("to")), "target", "inner")
            .where(F.col("from") == F.col("to")).select("source", "target"),
            "alike",
        )
        done = stage(_reaching(alike, labels.where("node = label.node")).join(labels, "node"), "done")
        least = done.groupBy("label").agg(F.min("node").alias("component"))
        settled = settled_table.write(settled.unionByName(lookup_join(done, least, "label", "inner", staged=True).select("node", "component")))
        gone = done.select("node")
        left, rows = _trimmed(
            table.write(
                alike.join(gone.withColumnRenamed("node", "source"), "source", "left_anti")
                .join(gone.withColumnRenamed("node", "target"), "target", "left_anti").select("source", "target")
            ),
            table,
        )
    # What a node was joined into may have been joined into another later on, so the last fold comes first.
    for folded in reversed(folds):
        above = lookup_join(folded, settled.withColumnRenamed("node", "into"), "into", "left", staged=True)
        over = above.select(F.explode(F.array("node", "into")).alias("node"), F.coalesce("component", "into").alias("component"))
        settled = settled_table.write(settled.unionByName(over).distinct())
    alone = ends(given).join(settled.select("node"), "node", "left_anti")
    return settled.unionByName(alone.withColumn("component", F.col("node")))


def cycle_report(deps: DataFrame) -> DataFrame:
    """(id, component, size, role) of the tasks that can never run, from edges (id, dep).

    ``in cycle``: they wait for each other, or for themselves; ``behind``: they wait for a cycle.
    """
    edges = stage(deps.select("id", "dep").dropna().distinct(), "waits")
    parts = stage(strong_components(edges, "id", "dep"), "strong")
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    own = edges.where("id = dep").select(F.col("id").alias("node"), F.lit(True).alias("itself")).distinct()
    stuck = stage(
        lookup_join(parts, sizes, "component", "inner", staged=True).join(own, "node", "left")
        .where("size > 1 OR itself").select("node", "component", "size"),
        "stuck",
    )
    graph = edges.select(F.col("id").alias("source"), F.col("dep").alias("target"))
    behind = _reaching(graph, stuck).join(stuck.select("node"), "node", "left_anti")
    return stuck.select(F.col("node").alias("id"), "component", "size", F.lit("in cycle").alias("role")).unionByName(
        behind.select(F.col("node").alias("id"), F.lit("behind").alias("role")), allowMissingColumns=True
    )


def _paths_cover(edges: DataFrame) -> DataFrame:
    """(node, chain, place): disjoint paths that hold every node once.

    Each node offers itself to its least successor, and each successor takes its least offer; what
    is linked so are paths, numbered from their end by pointer doubling.
    """
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    offers = edges.groupBy("source").agg(F.min("target").alias("target"))
    linked = offers.groupBy("target").agg(F.min("source").alias("source"))
    chains = _chains(nodes.withColumnRenamed("node", "id"), linked.select(F.col("source").alias("id"), F.col("target").alias("dep")))
    # Steps to the end grow towards the start, so a place is the negative number of them.
    return chains.select(F.col("id").alias("node"), F.col("root").alias("chain"), (-F.col("hops")).cast("long").alias("place"))


def reduce_reachable(edges: DataFrame) -> DataFrame:
    """Drop u -> w of an acyclic graph when w is reached from u by any longer path.

    Nodes are covered by paths. Of every node and path the first place that it reaches is enough to
    know all it reaches there; these are passed on against the edges, only what has become less in a
    round. An edge goes if another successor of its source reaches its target. Raises on a cycle.
    The rows are nodes times the paths that they reach, which a graph of many roots and leaves makes
    many: the price of exactness over ``reduce_transitive``, which looks two edges far. Rounds join
    by sorting, as a table that each of them broadcast would go through the driver as often.
    """
    spark = edges.sparkSession
    base = stage(edges.select("source", "target").dropna().distinct(), "edges")
    stuck = strong_components(base).groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not stuck.isEmpty() or not base.where("source = target").isEmpty():
        raise UnresolvedTasksError(cycle_report(base.select(F.col("source").alias("id"), F.col("target").alias("dep"))).select("id", F.col("component").alias("dep")))
    places = stage(_paths_cover(base), "places")
    reach_table, fresh_table = Stage(spark, "reach"), Stage(spark, "fresh")
    goal = places.select(F.col("node").alias("target"), "chain", "place").hint("merge")
    reach = fresh = reach_table.write(
        lookup_join(base, goal, "target", "inner", staged=True).groupBy(F.col("source").alias("node"), "chain").agg(F.min("place").alias("place"))
    )
    while not fresh.isEmpty():
        passed = (
            fresh.select(F.col("node").alias("target"), "chain", "place").join(base.hint("merge"), "target")
            .groupBy(F.col("source").alias("node"), "chain").agg(F.min("place").alias("come"))
        )
        fresh = fresh_table.write(
            passed.join(reach.hint("merge"), ["node", "chain"], "left").where("place IS NULL OR come < place")
            .select("node", "chain", F.col("come").alias("place"))
        )
        reach = reach_table.write(reach.unionByName(fresh).groupBy("node", "chain").agg(F.min("place").alias("place")))
    # The first place that the successors of a node reach on a path, one edge or more beyond them.
    beyond = (
        base.join(reach.select(F.col("node").alias("target"), "chain", "place").hint("merge"), "target")
        .groupBy("source", "chain").agg(F.min("place").alias("beyond"))
    )
    judged = lookup_join(base, goal, "target", "inner", staged=True).join(beyond.hint("merge"), ["source", "chain"], "left")
    return judged.where("beyond IS NULL OR beyond > place").select("source", "target")


def without_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with no outgoing edge."""
    return nodes.join(edges.select(F.col("source").alias("name")).distinct(), "name", "left_anti")


def operation_tree(operations: DataFrame, root: str | None = None, max_rounds: int = 64) -> DataFrame:
    """(name, root, depth, parent) for a forest given as (name, parent).

    Pointer doubling: every round doubles the height that is known, so a tree of depth d takes
    log2(d) rounds, and only rows that are not yet at the top are joined. More rounds than any
    tree can need (``max_rounds``) mean a circle. A parent that is not an operation counts as
    none. With ``root``, only that operation and those below it, with ``tree_path`` from it on;
    paths of a whole forest would be as long as its depth for every row.
    """
    table = Stage(operations.sparkSession, "tree")
    known = operations.select(F.col("name").alias("parent"), F.lit(True).alias("known")).distinct()
    linked = lookup_join(operations.select("name", "parent"), known, "parent", "left")
    linked = stage(linked.select("name", F.when(F.col("known"), F.col("parent")).alias("parent")), "linked")
    parent = F.col("parent")
    # Rows that rounds write and shuffle are short: top is as far as is known, and the root once there.
    columns = {"top": F.coalesce(parent, F.col("name")), "there": parent.isNull(), "depth": F.when(parent.isNull(), 0).otherwise(1)}
    if root is not None:
        columns["below"] = F.coalesce((F.col("name") == root) | (parent == root), F.lit(False))
    tree = table.write(linked.select("name", *(c.alias(n) for n, c in columns.items())))
    for _ in range(max_rounds):
        rising = tree.where("NOT there")
        if rising.isEmpty():
            break
        above = tree.select(F.col("name").alias("top"), *(F.col(c).alias(f"{c}2") for c in columns))
        moved = {"top": F.col("top2"), "there": F.col("there2"), "depth": F.col("depth") + F.col("depth2")}
        if root is not None:
            moved["below"] = F.col("below") | F.col("below2")
        risen = lookup_join(rising, above, "top", "inner", staged=True).select("name", *(c.alias(n) for n, c in moved.items()))
        tree = table.write(tree.where("there").unionByName(risen))
    else:
        raise ValueError("operations refer to each other in a circle")
    out = tree if root is None else tree.where("below")
    out = out.join(linked, "name").select("name", F.col("top").alias("root"), "depth", "parent")
    return out if root is None else _with_paths(out, root)


def _with_paths(tree: DataFrame, root: str) -> DataFrame:
    """Add tree_path, the names from ``root`` down to each operation of its tree."""
    table = Stage(tree.sparkSession, "paths")
    up = F.when(F.col("name") != root, F.col("parent"))
    paths = table.write(
        tree.select("*", up.alias("up"), F.when(up.isNull(), F.array()).otherwise(F.array(up)).cast("array<string>").alias("above"))
    )
    while not paths.where(F.col("up").isNotNull()).isEmpty():
        ahead = paths.select(F.col("name").alias("up"), F.col("up").alias("up2"), F.col("above").alias("above2"))
        rising = lookup_join(paths.where(F.col("up").isNotNull()), ahead, "up", "inner", staged=True)
        moved = rising.select(
            "name", "root", "depth", "parent", F.col("up2").alias("up"), F.concat("above2", "above").alias("above")
        )
        paths = table.write(paths.where(F.col("up").isNull()).unionByName(moved))
    path = F.array_join(F.concat("above", F.array("name")), "/")
    return paths.select("name", "root", "depth", "parent", path.alias("tree_path"))
