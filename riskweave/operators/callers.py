"""Caller trees as flat rows, and what is read off them.

A tree is a table root, path (the edge ords from the root's caller down), id, parent_id, depth, recursive.  Sorting by path is
depth-first order.  Trees of many roots may stand in one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.metrics import to_fixed
from riskweave.functions.text import file_name
from riskweave.lineage import cut

CUT_EVERY = 5


def caller_tree(roots: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """roots(root) and edges(ord, caller, callee): the callers of each root, their callers, and so on down to max_depth.

    Direct callers are there even if max_depth is below 1.  A caller that is already on the way from the root, the root included,
    is a recursive leaf.  Equal edges give equal children.
    """
    step = edges.select("ord", "caller", F.col("callee").alias("_at"))
    level = roots.select("root", F.col("root").alias("id"), F.array().cast("array<bigint>").alias("path"), F.array("root").alias("_way"))
    levels, depth = [], 1
    while True:
        found = level.join(step, level.id == step._at).select(
            "root",
            F.array_append("path", F.col("ord").cast("bigint")).alias("path"),
            F.col("caller").alias("id"),
            F.col("id").alias("parent_id"),
            F.lit(depth).alias("depth"),
            F.array_contains("_way", F.col("caller")).alias("recursive"),
            "_way",
        )
        if depth % CUT_EVERY == 0:
            found = cut(found)
        levels.append(found.drop("_way"))
        depth += 1
        if depth > max_depth or (depth % CUT_EVERY == 1 and found.isEmpty()):
            break
        level = found.where("not recursive").select("root", "id", "path", F.array_append("_way", F.col("id")).alias("_way"))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def cyclic_core(edges: DataFrame, rounds: int) -> DataFrame:
    """id of the nodes that are left when those without callers or without callees are taken away, so often: all that are on cycles, and perhaps more."""
    left = cut(edges.select("caller", "callee").where("caller <> callee").distinct())
    size = left.count()
    for _ in range(rounds):
        if not size:
            break
        called, calling = left.select(F.col("callee").alias("caller")).distinct(), left.select(F.col("caller").alias("callee")).distinct()
        left = cut(left.join(called, "caller", "left_semi").join(calling, "callee", "left_semi"))
        before, size = size, left.count()
        if size == before:
            break
    # a self-call is a cycle too
    return left.select(F.col("caller").alias("id")).union(left.select("callee")).union(edges.where("caller = callee").select("caller")).distinct()


def compact_tree(roots: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """The nodes of the caller trees without their paths: root, id, depth, recursive, n, the number of nodes of caller_tree that are alike.

    What is below a node hangs on its id, on its depth, and on those nodes of the way to it that it could meet again, which are on cycles.  Nodes that
    agree in these have equal subtrees, and go on as one with their number (decimal, as there can be more than a long holds).  Without cycles
    there are at most as many rows as ids times levels, however many paths there are.
    """
    core = cut(cyclic_core(edges, max(max_depth, 1)).withColumn("_core", F.lit(True)))
    step = cut(edges.select("caller", F.col("callee").alias("id")).groupBy("caller", "id").agg(F.count("*").cast("decimal(38,0)").alias("_m")).join(core.withColumnRenamed("id", "caller"), "caller", "left"))
    way = F.array().cast("array<string>")
    level = roots.join(core.withColumnRenamed("id", "root"), "root", "left").select("root", F.col("root").alias("id"), F.when(F.col("_core"), F.array("root")).otherwise(way).alias("_way"), F.lit(1).cast("decimal(38,0)").alias("n"))
    levels, depth = [], 1
    while True:
        on = F.when(F.col("_core"), F.array_sort(F.array_union("_way", F.array("caller")))).otherwise(F.col("_way"))
        found = level.join(step, "id").select("root", F.col("caller").alias("id"), F.array_contains("_way", F.col("caller")).alias("recursive"), on.alias("_way"), (F.col("n") * F.col("_m")).cast("decimal(38,0)").alias("n"))
        found = cut(found.groupBy("root", "id", "recursive", "_way").agg(F.sum("n").cast("decimal(38,0)").alias("n")).withColumn("depth", F.lit(depth)))
        levels.append(found)
        depth += 1
        if depth > max_depth or found.isEmpty():
            break
        level = found.where("not recursive").select("root", "id", "_way", "n")
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.groupBy("root", "id", "depth", "recursive").agg(F.sum("n").cast("decimal(38,0)").alias("n"))


def level_sizes(compact: DataFrame) -> DataFrame:
    """root, depth, n: how many nodes stand in each row of a layout, the root at depth 0 included."""
    own = compact.select("root", F.lit(0).alias("depth"), F.lit(1).cast("decimal(38,0)").alias("n")).distinct()
    return compact.groupBy("root", "depth").agg(F.sum("n").cast("decimal(38,0)").alias("n")).unionByName(own)


def rooted_tree(roots: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """The variant that has the root at depth 0 and tests for recursion before depth: leaves at max_depth, nothing but the root for 0."""
    own = roots.select("root", F.array().cast("array<bigint>").alias("path"), F.col("root").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.lit(False).alias("recursive"))
    return own if max_depth < 1 else own.unionByName(caller_tree(roots, edges, max_depth))


def counted_nodes(tree: DataFrame) -> DataFrame:
    """The nodes that count as affected: walking depth first, a node whose id was met before is left out with all below it.

    An id's callers are thus those of its first place, even if that one stands at the depth limit.  A node counts if its parent does and no node
    before it with its id does.  As both are said of earlier nodes, only one choice of nodes fulfils it; it is found by taking all at first and
    choosing anew by joins, with parents and with the first place of each id, until nothing changes: about as often as trees are deep.
    """
    at = F.struct("path", "id")
    above = F.struct(F.slice("path", 1, F.size("path") - 1).alias("path"), F.col("parent_id").alias("id"))
    rows = cut(tree.select("root", "path", "id", "depth", above.alias("_above"), at.alias("_at"), F.lit(True).alias("_kept")))
    columns, changed = [c for c in rows.columns if c != "_kept"], True
    while changed:
        chosen = rows.where("_kept")
        first = chosen.groupBy("root", "id").agg(F.min("_at").alias("_first"))
        parents = chosen.select("root", F.col("_at").alias("_above"), F.lit(True).alias("_held")).distinct()
        met = rows.join(first, ["root", "id"], "left").join(parents, ["root", "_above"], "left")
        fits = (F.coalesce("_held", F.lit(False)) | (F.col("depth") == 1)) & ~F.coalesce(F.col("_first") < F.col("_at"), F.lit(False))
        rows = cut(met.select(*columns, fits.alias("_kept"), F.col("_kept").alias("_was")))
        changed = not rows.where("_kept <> _was").isEmpty()
    return rows.where("_kept").select("root", "path", "id", "depth")


def impact_summary(tree: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """root, direct_callers (with duplicates), total_affected and, given metrics(id, f), combined_f; roots without callers have no row."""
    direct = tree.groupBy("root").agg(F.count_if(F.col("depth") == 1).alias("direct_callers"))
    nodes = counted_nodes(tree)
    if metrics is not None:
        nodes = nodes.join(metrics.select("id", "f"), "id", "left")
    more = [F.sum(F.coalesce("f", F.lit(0.0))).alias("combined_f")] if metrics is not None else []
    return direct.join(nodes.groupBy("root").agg(F.count("*").alias("total_affected"), *more), "root")


def flattened(tree: DataFrame, metrics: DataFrame) -> DataFrame:
    """Items for a list: root, path, id, label (indented), description, by way of metrics(id, name, f)."""
    x = tree.join(metrics.select("id", "name", "f"), "id", "left")
    return x.select(
        "root", "path", "id",
        F.concat(F.repeat(F.lit("$(indent)"), F.greatest(F.col("depth") - 1, F.lit(0))), F.coalesce("name", "id")).alias("label"),
        F.concat(f_text(), F.lit(" (depth "), F.col("depth").cast("string"), F.lit(")"), recursion_tag()).alias("description"),
    )


def f_text() -> Column:
    return F.concat(F.lit("F="), F.coalesce(to_fixed(F.col("f"), 1), F.lit("?")))


def recursion_tag() -> Column:
    return F.when(F.col("recursive"), F.lit(" 🔄 RECURSIVE")).otherwise(F.lit(""))


def expanded(edges: DataFrame, symbol: str, ancestors: list[str], depth: int) -> DataFrame:
    """One level below a node: its callers in edge order, those among the ancestors or the node itself marked recursive."""
    way = [*ancestors, symbol]
    return edges.where(F.col("callee") == symbol).select("ord", F.col("caller").alias("id"), F.lit(depth + 1).alias("depth"), F.col("caller").isin(way).alias("recursive"))


#: Distances of the layout.
SPACING_X, SPACING_Y, PADDING, GROUP_PADDING = 220, 140, 100, 30


def layout_nodes(tree: DataFrame, metrics: DataFrame) -> DataFrame:
    """root, path, id, label, f, file, depth, recursive, x, y: each depth a centred row, in depth-first order; the root on top."""
    roots = tree.select("root").distinct()
    own = roots.select("root", F.array().cast("array<bigint>").alias("path"), F.col("root").alias("id"), F.lit(0).alias("depth"), F.lit(False).alias("recursive"))
    nodes = own.unionByName(tree.select("root", "path", "id", "depth", "recursive"))
    row = Window.partitionBy("root", "depth")
    placed = nodes.withColumn("_i", F.row_number().over(row.orderBy("path")) - 1).withColumn("_n", F.count("*").over(row))
    placed = placed.withColumn("_w", F.max("_n").over(Window.partitionBy("root")))
    x = PADDING + (F.col("_w") - 1) * (SPACING_X / 2) - (F.col("_n") - 1) * (SPACING_X / 2) + SPACING_X * F.col("_i")
    named = placed.join(metrics.select("id", "name", F.col("f").alias("_f"), "uri"), "id", "left")
    return named.select(
        "root", "path", "id", F.coalesce("name", "id").alias("label"), F.coalesce("_f", F.lit(0.0)).alias("f"), F.coalesce(file_name(F.col("uri")), F.lit("")).alias("file"),
        "depth", "recursive", x.cast("double").alias("x"), (PADDING + SPACING_Y * F.col("depth")).cast("double").alias("y"),
    )


def layout_edges(tree: DataFrame) -> DataFrame:
    return tree.select("root", "path", F.col("id").alias("from"), F.col("parent_id").alias("to"))


def layout_size(nodes: DataFrame) -> DataFrame:
    """root, width, height of layout_nodes, or of level_sizes."""
    rows = nodes if "n" in nodes.columns else nodes.groupBy("root", "depth").agg(F.count("*").alias("n"))
    return rows.groupBy("root").agg(
        (2 * PADDING + (F.max("n") - 1) * SPACING_X).cast("double").alias("width"), (2 * PADDING + F.max("depth") * SPACING_Y).cast("double").alias("height")
    )


def file_groups(nodes: DataFrame) -> DataFrame:
    """Boxes around the nodes of one file name, where there are two or more."""
    grouped = nodes.where("file <> ''").groupBy("root", "file").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("depth", "path", "id"))), lambda n: n["id"]).alias("node_ids"),
        *[g(c).alias(f"_{n}{c}") for c in "xy" for n, g in (("min", F.min), ("max", F.max))],
    )
    size = lambda c: F.col(f"_max{c}") - F.col(f"_min{c}") + 2 * GROUP_PADDING
    return grouped.where(F.size("node_ids") >= 2).select(
        "root", "file", "node_ids", (F.col("_minx") - GROUP_PADDING).alias("x"), (F.col("_miny") - GROUP_PADDING).alias("y"), size("x").alias("width"), size("y").alias("height")
    )


def edges_between(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Layout edges with the places of both ends; a node that stands in several places is taken at its first, depth first."""
    first = nodes.groupBy("root", "id").agg(F.min_by(F.struct("x", "y"), F.struct("depth", "path")).alias("p"))
    a = first.select("root", F.col("id").alias("from"), F.col("p.x").alias("x1"), F.col("p.y").alias("y1"))
    b = first.select("root", F.col("id").alias("to"), F.col("p.x").alias("x2"), F.col("p.y").alias("y2"))
    return edges.join(a, ["root", "from"]).join(b, ["root", "to"]).select("root", "path", "from", "to", "x1", "y1", "x2", "y2")
