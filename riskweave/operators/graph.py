"""Edges of a call graph, and the undamped rank of its nodes."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from riskweave.lineage import Scratch, cut


def edges_from_callees(rows: DataFrame) -> DataFrame:
    """rows(ord, caller, callees array): one edge for each callee but the caller itself; duplicates stay."""
    out = rows.select("ord", "caller", F.posexplode("callees").alias("pos", "callee")).where(F.col("caller") != F.col("callee"))
    return out.select("ord", "pos", "caller", "callee")


def without_self_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("caller") != F.col("callee"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """The first of equal edges, by ord."""
    return edges.groupBy("caller", "callee").agg(F.min("ord").alias("ord"))


def node_ids(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("caller").alias("id")).union(edges.select("callee")).distinct()


def out_degrees(edges: DataFrame) -> DataFrame:
    """Distinct callees of each caller."""
    return edges.groupBy("caller").agg(F.countDistinct("callee").alias("degree"))


def callers_of(edges: DataFrame) -> DataFrame:
    """callee, callers: the callers in edge order, duplicates kept."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "caller")))
    return edges.groupBy("callee").agg(F.transform(ordered, lambda x: x["caller"]).alias("callers"))


def incoming(edges: DataFrame) -> DataFrame:
    """callee, callers: distinct callers, in the order in which they first appear."""
    return callers_of(distinct_edges(edges))


def preferred(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The edges of a better source, such as a language server's, or those of the other where it has none or fails.  The better source is asked once:
    its edges are written and read again."""
    from pyspark.errors import PySparkException

    try:
        found = cut(primary)
        return fallback if found.isEmpty() else found
    except PySparkException:
        return fallback


def hierarchy_edges(calls: DataFrame, scope: str | None = None) -> DataFrame:
    """calls(ord, caller_uri, caller_line, caller_char, callee_uri, callee_line, callee_char), as a language server's call hierarchy tells them:
    edges between the places of names, without self-calls; callers outside the scope are left out, callees are not.  Only files and
    unsaved documents count."""
    from riskweave.functions.text import symbol_id
    from riskweave.sources.files import in_scope, readable_scheme

    end = lambda e: symbol_id(F.col(f"{e}_uri"), F.col(f"{e}_line"), F.col(f"{e}_char"))
    kept = calls.where(readable_scheme(F.col("caller_uri")) & readable_scheme(F.col("callee_uri")))
    kept = kept if scope is None else kept.where(in_scope(F.col("caller_uri"), scope))
    return without_self_edges(kept.select("ord", end("caller").alias("caller"), end("callee").alias("callee")))


def direct_callers(edges: DataFrame, symbol: str) -> DataFrame:
    return edges.where(F.col("callee") == symbol).select("ord", "caller")


#: Edges of a partition where all cores have four, else up to so many more; and partitions at most.  A step deals from each partition to each, so
#: partitions of a fixed small size make for as many blocks as the square of the edges, and sum little before the exchange.
EDGES_PER_PART, MOST_EDGES_PER_PART, MOST_PARTS = 200_000, 1_000_000, 20_000
#: Steps of the first plan; each later one has twice as many, up to `block`.  Few: most edges of a graph without cycles go with the first peel.
FIRST_STEPS = 2
#: Up to so many nodes (8 bytes each) that still move are broadcast.
FEW_NODES = 500_000
#: Up to so many edges plans are interpreted: compiling twenty steps takes longer than running them.
FEW_EDGES = 1_000_000


def rank(edges: DataFrame, max_iterations: int = 100, epsilon: float = 1e-6, block: int = 20) -> DataFrame:
    """edges(caller, callee): id, r for every node.

    Ranks start at 1 and become, all at once, 1 plus the sum over distinct callers of their rank over their distinct callees.  The
    first step after which no rank has moved by epsilon or more is the last.  Nothing damps the ranks, so they grow in
    cycles for as long as there are iterations.  Edges with a null end are none.

    A node carries its rank r and its last move d, 1 at first.  Its next move is the sum of its callers' moves over their callees, and its
    rank grows by it, so a caller that no longer moves has nothing to send.  A node's own rank comes back to it by a row (k, k, share 0) among the
    edges.  So a step is one join of the edges, bucketed by caller, and one sum by callee, which is the only exchange; steps are chained to one plan.
    Nodes are told by hashes of 64 bits, others where two ids share one.  Once a node doesn't move its rank is final, as its callers' are: after
    each plan these nodes are peeled off with their edges.  What is left in the end are cycles and what they reach.
    """
    if max_iterations < 0 or block < 1:
        raise ValueError("max_iterations must not be negative and block must be positive")
    spark = edges.sparkSession
    made = Scratch(spark)
    pairs = made.write(edges.select("caller", "callee").where("caller is not null and callee is not null"), "rank-pairs", MOST_EDGES_PER_PART)
    total = pairs.count()
    if not max_iterations or not total:
        return node_ids(pairs).select("id", F.lit(1.0).alias("r"))
    parts = partitions(total, spark.sparkContext.defaultParallelism)
    own = spark.newSession()  # for settings of its own
    # a task reads one file of the pairs or a few small ones, so that it can sort them in memory
    for setting, value in {"files.maxPartitionBytes": 8 << 20, "adaptive.enabled": False, "shuffle.partitions": parts, "codegen.wholeStage": total > FEW_EDGES, "autoBroadcastJoinThreshold": -1}.items():
        own.conf.set(f"spark.sql.{setting}", str(value).lower())
    pairs = own.read.schema(pairs.schema).parquet(made.paths["rank-pairs"])
    names, seed = _hashed_names(made, pairs)
    rows = pairs.select(node_hash("caller", seed).alias("k"), node_hash("callee", seed).alias("v"))
    rows = rows.unionByName(names.select("k", F.lit(None).cast("long").alias("v"))).sortWithinPartitions("k").repartition(parts, "k")  # equal callers side by side: they compress
    # repeated edges stand side by side, so that the one exchange and one sort serve for leaving them out and for counting callees
    before = F.lag("v").over(Window.partitionBy("k").orderBy("v"))
    rows = rows.withColumn("_before", before).where("v is null or _before is null or _before <> v")
    share = F.when(F.col("v").isNotNull(), 1 / F.count("v").over(Window.partitionBy("k"))).otherwise(0.0)
    given = made.bucketed(rows.select("k", F.coalesce("v", "k").alias("v"), share.alias("share")), "k", parts, "rank-edges-0", dealt=True)
    state, settled, done, size, moving, last = names.select("k", F.lit(1.0).alias("r"), F.lit(1.0).alias("d")), {}, 0, FIRST_STEPS, None, None
    while done < max_iterations:
        steps = min(size, block, max_iterations - done)
        before, name = state, f"rank-state-{done}"
        state, moved, left = _steps(made, given, before, steps, name)
        stop = next((k for k, m in enumerate(moved) if m < epsilon), None)
        if stop is not None and any(moved[stop + 1 :]):  # it went on a little: up to the step that settled
            state, _, _ = _steps(made, given, before, stop + 1, f"{name}-again")
        if last and last not in settled:
            made.drop(last)
        done, size, last = done + steps, 2 * size, name
        if stop is not None or not left:
            break
        if done < max_iterations and left != moving:  # peel
            rest, over = state.where("d > 0"), state.where("d = 0").select("k", "r")
            moves = F.broadcast(rest.select("k")) if left <= FEW_NODES else rest.select("k").hint("shuffle_hash")
            given = made.bucketed(given.join(moves, "k", "left_semi"), "k", parts, f"rank-edges-{done}", dealt=True)
            made.drop(*[x for x in list(made.tables) if x != f"rank-edges-{done}"])
            state, settled[name], moving = rest, over, left
    ranks = state.select("k", "r")
    for part in settled.values():
        ranks = ranks.unionByName(part)
    out = made.write(names.join(ranks, "k").select("id", "r"), "rank")
    made.drop_all(but="rank")
    return spark.read.schema(out.schema).parquet(made.paths["rank"])


def node_hash(id_: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_))


def _hashed_names(made: Scratch, pairs: DataFrame) -> tuple[DataFrame, int]:
    """(id, k) of all nodes, k being a hash that tells them apart, and its seed."""
    ids = made.write(node_ids(pairs), "rank-ids")
    for seed in itertools.count():
        names = ids.select("id", node_hash("id", seed).alias("k"))
        if names.groupBy("k").count().where("count > 1").isEmpty():
            return names, seed


def partitions(edges: int, cores: int) -> int:
    """How many partitions so many edges are dealt over."""
    return min(MOST_PARTS, max(min(math.ceil(edges / EDGES_PER_PART), 4 * cores), math.ceil(edges / MOST_EDGES_PER_PART)))


def stepped(given: DataFrame, state: DataFrame) -> DataFrame:
    """(k, r, d) one step on, along given(k, v, share): edges from nodes that don't move send nothing."""
    own = F.sum(F.when(F.col("share") == 0, F.col("r")))
    sent = given.join(state.hint("shuffle_hash"), "k").where("share = 0 or d > 0")
    sums = sent.groupBy(F.col("v").alias("k")).agg(own.alias("own"), F.sum(F.col("d") * F.col("share")).alias("d"))
    return sums.select("k", (F.col("own") + F.col("d")).alias("r"), "d")


def _steps(made: Scratch, given: DataFrame, state: DataFrame, steps: int, name: str) -> tuple[DataFrame, list[float], int]:
    """The state after so many steps, written; the largest move of each step; and how many nodes moved in the last."""
    seen = [Observation() for _ in range(steps)]
    watched = [F.max("d").alias("most"), F.count_if(F.col("d") > 0).alias("moved")]
    for x in seen:
        state = stepped(given, state).observe(x, *watched)
    state = made.write(state, name)
    return state, [x.get["most"] or 0.0 for x in seen], seen[-1].get["moved"]


def has_converged(before: DataFrame, after: DataFrame, epsilon: float = 1e-6) -> bool:
    """Whether no rank (id, r) differs by epsilon or more; true for empty tables."""
    gap = before.alias("a").join(after.alias("b"), "id", "full").agg(F.max(F.abs(F.coalesce("a.r", F.lit(0.0)) - F.coalesce("b.r", F.lit(0.0)))).alias("d")).first()["d"]
    return gap is None or gap < epsilon
