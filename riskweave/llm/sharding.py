"""Proportional stratified interleaving of documents into shards.

Rows are shuffled by a seeded hash and ranked within their source; sorting all rows by the fractional rank
(rank + 1/2) / rows of the source spreads each source evenly over the whole order, so that any contiguous cut holds the
mixture of the corpus.  The order is cut into shards whose row counts differ by one at most.

Both rankings are exact and have no hot group: a row's rank is the rows in earlier hash slices plus its place in its own
slice.  The slices of a source are as many as its rows ask for (slice_rows a slice), so that a source with a third of all rows
is dealt over many tasks; the interleaved order is sliced evenly in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SLICE_ROWS = 2_000


def _offsets(slices: DataFrame, keys: list[str], order: str, groups: int = 512) -> DataFrame:
    """slices has one row a slice with n rows; adds `before`, the rows of earlier slices with equal keys, in two levels."""
    two = slices.withColumn("_high", F.floor(F.col(order) / groups))
    high = two.groupBy(*keys, "_high").agg(F.sum("n").alias("_m"))
    over = Window.partitionBy(*keys).orderBy("_high").rowsBetween(Window.unboundedPreceding, -1)
    high = high.withColumn("_start", F.coalesce(F.sum("_m").over(over), F.lit(0))).drop("_m")
    inner = Window.partitionBy(*keys, "_high").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        two.withColumn("_in", F.coalesce(F.sum("n").over(inner), F.lit(0)))
        .join(high, [*keys, "_high"])
        .withColumn("before", F.col("_start") + F.col("_in"))
        .drop("_high", "_start", "_in")
    )


def interleave(rows: DataFrame, n_shards: int, seed: str = "0", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """rows(id, source): adds shard int (0 .. n_shards - 1) and slot long (gapless from 0 in each shard).

    A null source is a source of its own; null or repeated ids keep their rows (equal rows are interchangeable);
    an empty table gives an empty result; with fewer rows than shards some shards stay empty.  Other columns pass through.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    # 1. the seeded shuffle key: the first 60 bits of an MD5, as an integer
    rows = rows.select(F.struct(*rows.columns).alias("row"), "id", "source")  # whatever the other columns are called
    keyed = rows.withColumn("_src", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))).withColumn(
        "_key", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")
    )
    keyed = written(keyed, "shard-keyed")
    total = keyed.count()
    if not total:
        return rows.select("row.*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    per_source = keyed.groupBy("_src").agg(F.count("*").alias("_of")).withColumn("_slices", F.ceil(F.col("_of") / slice_rows))
    few = per_source.count() <= 10_000
    sources = F.broadcast(per_source) if few else per_source
    # 2. rank within the source
    dealt = keyed.join(sources, "_src").withColumn("_slice", F.floor(F.col("_key") / F.lit(float(1 << 60)) * F.col("_slices")).cast("long"))
    slices = written(dealt.groupBy("_src", "_slice").agg(F.count("*").alias("n")), "shard-slices")
    offsets = _offsets(slices, ["_src"], "_slice").select("_src", "_slice", "before")
    in_slice = Window.partitionBy("_src", "_slice").orderBy("_key", "id")
    ranked = (
        dealt.withColumn("_place", F.row_number().over(in_slice))
        .join(offsets, ["_src", "_slice"])
        .withColumn("_frac", (F.col("before") + F.col("_place") - 0.5) / F.col("_of"))
        .drop("before", "_place", "_slice", "_slices", "_of")
    )
    # 3. one order by fractional rank, sliced evenly
    pieces = max(1, -(-total // slice_rows))
    ranked = written(ranked.withColumn("_piece", F.least(F.floor(F.col("_frac") * pieces), F.lit(pieces - 1)).cast("long")), "shard-ranked")
    counts = ranked.groupBy("_piece").agg(F.count("*").alias("n")).withColumn("_all", F.lit(0))
    starts = _offsets(counts, ["_all"], "_piece").select("_piece", "before")
    in_piece = Window.partitionBy("_piece").orderBy("_frac", "_key", "_src", "id")
    placed = ranked.withColumn("_place", F.row_number().over(in_piece)).join(starts, "_piece").withColumn("_at", F.col("before") + F.col("_place") - 1)
    # 4. cut: shard s takes the places from ceil(s * total / n) on
    first = F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L")
    out = placed.withColumn("shard", F.expr(f"cast((_at * {n_shards}L) div {total}L as int)"))
    return out.withColumn("slot", (F.col("_at") - first).cast("long")).select("row.*", "shard", "slot")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", rows_per_file: int = 100_000) -> None:
    """The shards as Parquet folders shard=K below path, rows in slot order: the documents joined with their places."""
    (
        docs.join(placed.select(id_col, "shard", "slot"), id_col)
        .repartition("shard", F.floor(F.col("slot") / rows_per_file))
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
