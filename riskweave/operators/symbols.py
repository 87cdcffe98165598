"""Symbols joined with coverage, complexity, churn and rank, and rolled up to files."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions import metrics as M
from riskweave.functions.text import estimated_cc, symbol_id

#: Places of a file whose sums run in one window; a file with more has several.
PART_PLACES = 50_000


def running(rows: DataFrame, key: str | list[str], at: str, sums: list[str] | dict[str, Column], part: int = PART_PLACES, asks: str | None = None) -> DataFrame:
    """rows(key, at, sums..., asks), at being a whole number: every sum becomes that of the key's rows up to and with at; with asks only the rows
    stay where it isn't null.  Sums may be made of other columns, as name: column, which is done after the exchange.

    A window holds `part` numbers of a key only, and what its earlier ones sum to, a row each, is added.  Both are made of one exchange."""
    keys = [key] if isinstance(key, str) else key
    window = F.floor(F.col(at) / part)
    dealt = rows.repartition(*keys, window)
    dealt = dealt.withColumns(sums) if isinstance(sums, dict) else dealt
    columns = dealt.columns
    dealt = dealt.withColumn("_part", window).where(" and ".join(f"{k} is not null" for k in [*keys, "_part"]))
    inner = Window.partitionBy(*keys, "_part").orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.count(asks) if asks else F.count("*")
    parts = dealt.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums], wanted.alias("_asks"))
    # first windows have none before them: for files of one window nothing is left to join
    parts = parts.select(*keys, "_part", "_asks", *[F.sum(f"_{c}").over(outer).alias(f"_{c}") for c in sums]).where(F.col("_asks") > 0).where(F.coalesce(*[F.col(f"_{c}") for c in sums]).isNotNull())
    within = dealt.withColumns({c: F.sum(c).over(inner) for c in sums})
    within = within if asks is None else within.where(F.col(asks).isNotNull())
    return within.join(parts.drop("_asks"), [*keys, "_part"], "left").withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in sums}).select(*columns)


def coverage(bodies: DataFrame, statements: DataFrame, fallback_t: float = 0.0, part: int = PART_PLACES) -> DataFrame:
    """bodies(id, uri, body_start, body_end) and statements(uri, executed, start_line, end_line): id, covered, total, t.

    A statement counts if its lines overlap the body's, and t is the share of executed ones, else fallback_t within 0 and 1.

    No pair of a body and a statement is made.  What overlaps a body are the statements of its file that begin at its last line or before,
    less those that end before its first line: running sums over the lines, which the bodies read as rows among the statements.  A statement goes
    through one exchange, as one row, or two if it ends on another line than it begins.  A file's lines are dealt over windows of `part` lines,
    to which what the earlier windows sum to is added, so neither a long statement nor a file with very many costs more than its rows.  Statements
    and bodies that end before they begin overlap nothing, nor do those without a file or a line.  Several bodies of one id count together.
    """
    zero, line = F.lit(0).cast("long"), lambda c: F.col(c).cast("long")
    # a row has one small number until it is dealt: what begins or ends on its line, whether that was executed, or which end of a body asks
    begins, ends, hit, last, first = 1, 2, 4, 8, 16
    row = lambda at, kind: F.struct(at.alias("at"), F.lit(kind).alias("kind"))
    marks = statements.where("start_line <= end_line and uri is not null").withColumn("_m", F.when(F.col("start_line") == F.col("end_line"), F.array(row(line("start_line"), begins | ends))).otherwise(F.array(row(line("start_line"), begins), row(line("end_line"), ends))))
    marks = marks.select("uri", F.explode("_m").alias("_m"), F.when(F.col("executed"), hit).otherwise(0).alias("hit")).select("uri", "_m.at", (F.col("_m.kind") + F.col("hit")).alias("kind"), F.lit(None).cast(bodies.schema["id"].dataType).alias("id"))
    asked = bodies.where("body_start <= body_end and uri is not null and id is not null").select("uri", F.explode(F.array(row(line("body_end"), last), row(line("body_start") - 1, first))).alias("_m"), "id").select("uri", "_m.at", "_m.kind", "id")
    marked = lambda bits: (F.col("kind").bitwiseAND(bits) == bits).cast("long")
    sums = running(marks.unionByName(asked), "uri", "at", {"begun": marked(begins), "begun_hit": marked(begins | hit), "over": marked(ends), "over_hit": marked(ends | hit)}, part, "id")
    within = lambda plus, less: F.sum(F.when(F.col("kind") == last, F.col(plus)).otherwise(-F.col(less)))
    hits = sums.groupBy("id").agg(within("begun", "over").alias("total"), within("begun_hit", "over_hit").alias("covered"))
    share = F.when(F.coalesce(F.col("total"), F.lit(0)) > 0, F.col("covered") / F.col("total")).otherwise(M.clamp01(F.lit(float(fallback_t))))
    return bodies.select("id").distinct().join(hits, "id", "left").select("id", F.coalesce("covered", zero).alias("covered"), F.coalesce("total", zero).alias("total"), share.alias("t"))


def resolved_cc(functions: DataFrame, by_line: DataFrame | None, by_name: DataFrame | None, text: Column | None = None, estimate: Column | None = None) -> DataFrame:
    """functions(uri, name, sel_line, ...): adds cc, that of a tool for the line, else for line and name, else the estimate, which is made from text
    if none is given.

    A tool's 0 counts.  The tools' lines are 1-based.
    """
    line1, out, found = F.col("sel_line") + 1, functions, []
    if by_line is not None:
        lines = by_line.groupBy(F.col("uri").alias("_u1"), F.col("line1").alias("_l1")).agg(F.max("cc").alias("_c1"))
        out, found = out.join(lines, (F.col("uri") == F.col("_u1")) & (line1 == F.col("_l1")), "left"), ["_c1"]
    if by_name is not None:
        names = by_name.groupBy(F.col("uri").alias("_u2"), F.col("key").alias("_k2")).agg(F.max("cc").alias("_c2"))
        out, found = out.join(names, (F.col("uri") == F.col("_u2")) & (F.concat_ws(":", line1.cast("string"), F.col("name")) == F.col("_k2")), "left"), [*found, "_c2"]
    return out.withColumn("cc", F.coalesce(*found, estimated_cc(text) if estimate is None else estimate)).drop("_u1", "_l1", "_c1", "_u2", "_k2", "_c2")


def slice_text(lines: Column, first: Column, last: Column) -> Column:
    """Lines first to last, both included, joined by line feeds."""
    return F.array_join(F.slice(lines, first + 1, F.greatest(last - first + 1, F.lit(0))), "\n")


def clamped_text(lines: Column, first: Column, last: Column) -> Column:
    """As slice_text, for places from an editor that may lie outside: first and last are moved to the lines there are."""
    inside = lambda x: F.least(F.greatest(x, F.lit(0)), F.size(lines) - 1)
    return slice_text(lines, inside(first), inside(last))


#: Kinds of editor symbols that are functions.
FUNCTION_KINDS = ("Function", "Method", "Constructor")


def flattened_symbols(nested: DataFrame) -> DataFrame:
    """nested(uri, path array<int>, kind, name, ...): the functions among an editor's nested symbols, outer before inner; path is the way through
    the children.  Adds ord."""
    found = nested.where(F.col("kind").isin(*FUNCTION_KINDS))
    return found.withColumn("ord", F.row_number().over(Window.partitionBy("uri").orderBy("path")) - 1)


def first_selected(metrics: DataFrame, ids: list[str]) -> DataFrame:
    """The metrics of the first of the selected ids that is a symbol."""
    wanted = F.array_position(F.array(*[F.lit(i) for i in ids]) if ids else F.array().cast("array<string>"), F.col("id"))
    return last_by_id(metrics).where(wanted > 0).orderBy(wanted).limit(1)


def symbol_inputs(documents: DataFrame | None, functions: DataFrame, statements: DataFrame | None, by_line: DataFrame | None, by_name: DataFrame | None, fallback_t: float = 0.0) -> DataFrame:
    """One row a function of a known document: id, uri, name, cc, t, file order and function order.  Functions that carry file_ord and estimate, as
    those of scanned sources do, need no documents."""
    if "estimate" in functions.columns:
        own = functions.withColumn("id", symbol_id(F.col("uri"), F.col("sel_line"), F.col("sel_char")))
        own = resolved_cc(own, by_line, by_name, estimate=F.col("estimate")).drop("estimate")
    else:
        own = functions.join(documents.select("uri", F.col("ord").alias("file_ord"), "lines"), "uri")
        own = own.withColumn("id", symbol_id(F.col("uri"), F.col("sel_line"), F.col("sel_char")))
        own = resolved_cc(own, by_line, by_name, slice_text(F.col("lines"), F.col("body_start"), F.col("body_end"))).drop("lines")
    columns = ["file_ord", "ord", "id", "uri", "name", "cc", "t", "sel_line", "body_start", "body_end"]
    if statements is None:
        return own.withColumn("t", M.clamp01(F.lit(float(fallback_t)))).select(*columns)
    key = F.to_json(F.struct("uri", "ord"))
    t = coverage(own.select(key.alias("id"), "uri", "body_start", "body_end"), statements, fallback_t).select(F.col("id").alias("_key"), "t")
    return own.withColumn("_key", key).join(t, "_key").select(*columns)


def symbol_metrics(symbols: DataFrame, ranks: DataFrame) -> DataFrame:
    """symbols(id, cc, t, ...) and ranks(id, r): adds r (1 outside the graph), crap, f, g = 1 and f_prime = f."""
    found = symbols.join(ranks.select(F.col("id").alias("_id"), F.col("r").alias("_r")), F.col("id") == F.col("_id"), "left")
    out = found.withColumn("r", F.coalesce("_r", F.lit(1.0))).drop("_id", "_r").withColumn("crap", M.crap(F.col("cc"), F.col("t")))
    return out.withColumn("f", M.failure_risk(F.col("r"), F.col("crap"))).withColumn("g", F.lit(1.0)).withColumn("f_prime", F.col("f"))


def apply_churn(metrics: DataFrame, churn: DataFrame) -> DataFrame:
    """churn(uri, commits): sets g and f_prime = f g for files with a count; others stay as they are."""
    counts = churn.select(F.col("uri").alias("_u"), "commits")
    x = metrics.join(counts, F.col("uri") == F.col("_u"), "left").withColumn("_g", M.churn_multiplier(F.col("commits")))
    return x.withColumn("f_prime", F.coalesce(F.col("f") * F.col("_g"), F.col("f_prime"))).withColumn("g", F.coalesce("_g", "g")).drop("_u", "_g", "commits")


def file_rollup(rows: DataFrame, mode: str = "max", value: str = "f_prime") -> DataFrame:
    """uri, rollup: the largest or the sum of a file's values; avg is an extension."""
    if mode not in ("max", "sum", "avg"):
        raise ValueError(f"unknown rollup {mode}")
    return rows.groupBy("uri").agg(getattr(F, mode)(value).alias("rollup"))


def last_by_id(metrics: DataFrame) -> DataFrame:
    """One row an id, the last by ord."""
    columns = [c for c in metrics.columns if c != "id"]
    return metrics.groupBy("id").agg(F.max_by(F.struct(*columns), "ord").alias("_m")).select("id", "_m.*")


#: Lines of a file that one sweep goes over, and how often parts are dealt in parts themselves: lines are below 2^31.
SWEEP_LINES, SWEEP_LEVELS = 20_000, 2
_WHO = "struct<ord:bigint,id:string,name:string>"


def at_cursor(functions: DataFrame, metrics: DataFrame, cursors: DataFrame, part: int = SWEEP_LINES) -> DataFrame:
    """cursors(uri, line): the first function, by ord, with metrics whose lines, from its name to its body's end, hold the cursor.

    Null lines hold nothing and are in nothing; of functions with one ord the first by id counts; a cursor that is in no function has no row, repeated
    cursors have one."""
    known = functions.withColumn("id", symbol_id(F.col("uri"), F.col("sel_line"), F.col("sel_char"))).join(metrics.select("id").distinct(), "id")
    ranges = known.where("sel_line <= body_end").select("uri", F.struct(F.coalesce(F.col("ord").cast("long"), F.lit((1 << 63) - 1)).alias("ord"), "id", "name").cast(_WHO).alias("who"), F.col("sel_line").cast("long").alias("a"), F.col("body_end").cast("long").alias("b"))
    asked = cursors.select("uri", F.col("line").cast("long").alias("at")).where("uri is not null and at is not null").distinct()
    found = first_over(ranges, asked, part)
    return found.select("uri", F.col("at").cast(dict(cursors.dtypes)["line"]).alias("line"), "who.id", "who.name")


def first_over(ranges: DataFrame, asked: DataFrame, part: int = SWEEP_LINES, levels: int = SWEEP_LEVELS) -> DataFrame:
    """ranges(uri, who, a, b) and asked(uri, at), without repetitions: uri, at, who, the least who of the ranges that hold a place.

    A sweep.  A file's places are cut into parts, and a part's ranges and places are gone over in order, with the open ranges on a heap.  A range is in
    the parts of its two ends only: of the ranges that hold a part as a whole the least is all that counts, and which that is, is the same
    question about the parts.  So however long ranges are, and however many there are in a file, each is two rows a level.
    """
    if not levels:  # few places are left
        return ranges.select("uri", "who", F.explode(F.sequence("a", "b")).alias("at")).groupBy("uri", "at").agg(F.min("who").alias("who")).join(asked, ["uri", "at"], "left_semi")
    at = lambda c: F.floor(F.col(c) / part)
    ranges = ranges.withColumn("pa", at("a")).withColumn("pb", at("b"))
    asked = asked.withColumn("part", at("at"))
    parts = asked.select("uri", F.col("part").alias("at")).distinct()
    over = first_over(ranges.where("pb - pa >= 2").select("uri", "who", (F.col("pa") + 1).alias("a"), (F.col("pb") - 1).alias("b")), parts, part, levels - 1)
    begin, end = F.col("part") * part, (F.col("part") + 1) * part - 1
    near = ranges.select("uri", "who", "a", "b", F.explode(F.array_distinct(F.array("pa", "pb"))).alias("part")).select("uri", "part", "who", F.greatest("a", begin).alias("a"), F.least("b", end).alias("b"))
    near = near.unionByName(over.withColumnRenamed("at", "part").select("uri", "part", "who", begin.alias("a"), end.alias("b")))
    near = near.join(parts.withColumnRenamed("at", "part"), ["uri", "part"], "left_semi")  # where something is asked
    places = asked.select("uri", "part", F.lit(None).cast(ranges.schema["who"].dataType).alias("who"), F.col("at").alias("a"), F.lit(None).cast("long").alias("b"))
    # part by part; at one place ranges come first
    rows = near.unionByName(places).repartition("uri", "part").sortWithinPartitions("uri", "part", "a", F.col("who").isNull())
    found = rows.select("uri", "part", "a", "b", F.col("who").isNull().alias("asks"), "who.*").mapInArrow(_swept, "uri string, at long, ord long, id string, name string")
    return found.select("uri", "at", F.struct("ord", "id", "name").cast(_WHO).alias("who"))


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, open_ = None, []
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        found = []
        for r in batch.to_pylist():
            if (r["uri"], r["part"]) != place:
                place, open_ = (r["uri"], r["part"]), []
            if not r["asks"]:
                heapq.heappush(open_, (r["ord"], r["id"], r["name"] is not None, r["name"] or "", r["b"]))
                continue
            while open_ and open_[0][-1] < r["a"]:
                heapq.heappop(open_)
            if open_:
                ord_, id_, named, name, _ = open_[0]
                found.append((r["uri"], r["a"], ord_, id_, name if named else None))
        columns = list(zip(*found, strict=True)) or [[]] * len(kinds)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["uri", "at", "ord", "id", "name"])
