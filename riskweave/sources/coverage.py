"""Coverage reports as statement tables: LCOV and JaCoCo text read by Spark's text source, and their places in a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.functions.text import leading_int


#: Lines or tags of a report that is given as text which are scanned together.
PART_ROWS = 100_000


def _split(spark: SparkSession, paths: list[str], separator: str) -> DataFrame:
    rows = spark.read.option("lineSep", separator).text(paths)
    return rows.select(F.col("_metadata.file_path").alias("report"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("ord"), F.col("value").alias("line"))


def report_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """report, part, ord, line of report files, which are read in splits: part is where a split begins, ord counts within it."""
    return _split(spark, paths, "\n").withColumn("line", F.regexp_replace("line", "\r$", ""))


def report_tags(spark: SparkSession, paths: list[str]) -> DataFrame:
    """As report_lines, for XML: what stands before each closing angle bracket, as such reports often have one line only."""
    return _split(spark, paths, ">")


def _rows(reports: DataFrame, pattern: str) -> DataFrame:
    """The rows of reports(report, content), or of reports in rows already."""
    if "content" not in reports.columns:
        return reports.select("report", "part", "ord", "line")
    rows = reports.select("report", F.posexplode(F.split("content", pattern)).alias("ord", "line"))
    return rows.select("report", F.floor(F.col("ord") / PART_ROWS).alias("part"), F.col("ord").cast("bigint").alias("ord"), "line")


def last_seen(head: Column, keys: list[str], order: str) -> Column:
    """The last value of head that is not null, up to and with the row."""
    return F.last(head, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def carried(rows: DataFrame, heads: dict[str, Column], keys: list[str], part: str = "part", order: str = "ord", before: tuple[str, ...] = (), after: tuple[str, ...] = ()) -> DataFrame:
    """Adds for each head its last value that is not null up to and with the row, among the rows of equal keys in the order (part, order).

    Heads named in `before` don't see the row itself; those in `after` look ahead, to the next value behind the row.  A window holds a part of a
    key only; what earlier parts end with, a row a part, is carried on to it.  Keys and parts must not be null."""
    own = Window.partitionBy(*keys, part).orderBy(order)
    spans = {n: (1, Window.unboundedFollowing) if n in after else (Window.unboundedPreceding, -1 if n in before else 0) for n in heads}
    rows = rows.withColumns({f"_h{k}": h for k, h in enumerate(heads.values())})
    pick = lambda n: F.first if n in after else F.last
    held = rows.withColumns({f"_o{k}": pick(n)(f"_h{k}", ignorenulls=True).over(own.rowsBetween(*spans[n])) for k, n in enumerate(heads)})
    edge = lambda k, n: (F.min_by if n in after else F.max_by)(F.col(f"_h{k}"), F.when(F.col(f"_h{k}").isNotNull(), F.col(order)))
    ends = rows.groupBy(*keys, part).agg(*[edge(k, n).alias(f"_e{k}") for k, n in enumerate(heads)])
    parts = Window.partitionBy(*keys).orderBy(part)
    reach = lambda n: parts.rowsBetween(1, Window.unboundedFollowing) if n in after else parts.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, part, *[pick(n)(f"_e{k}", ignorenulls=True).over(reach(n)).alias(f"_c{k}") for k, n in enumerate(heads)])
    joined = held.join(ends, [*keys, part]).withColumns({n: F.coalesce(f"_o{k}", f"_c{k}") for k, n in enumerate(heads)})
    return joined.drop(*[f"_{x}{k}" for x in "hoc" for k in range(len(heads))])


def lcov_statements(reports: DataFrame) -> DataFrame:
    """reports(report, content), or report_lines: report, file, ord, executed, start_line, end_line of all DA records with a file.

    A file named by SF holds until the next SF or end_of_record; a DA record needs a comma, numbers to begin both its parts
    and a line of 1 or more.  A file named twice has the statements of both places.  A report of any size is scanned in parts.
    """
    head = F.when(F.col("line").startswith("SF:"), F.trim(F.substr("line", F.lit(4)))).when(F.trim("line") == "end_of_record", F.lit(""))
    rows = _rows(reports, "\r?\n").where(F.col("line").startswith("DA:") | head.isNotNull())
    held = carried(rows, {"file": head}, ["report"]).where(F.col("line").startswith("DA:") & (F.col("file") != ""))
    rest = F.substr("line", F.lit(4))
    comma = F.instr(rest, ",")
    number = leading_int(F.substr(rest, F.lit(1), comma - 1))
    hits = leading_int(F.substr(rest, comma + 1))
    found = held.where(comma > 0).select("report", "file", F.struct("part", "ord").alias("ord"), (hits > 0).alias("executed"), (number - 1).cast("int").alias("start_line"))
    return found.where("executed is not null and start_line >= 0").withColumn("end_line", F.col("start_line"))


def jacoco_statements(reports: DataFrame) -> DataFrame:
    """reports(report, content), or report_tags: report, file (package/source), ord, executed, start_line, end_line.

    Attributes are expected in the order nr, mi, ci.  A package ends with its closing tag, where another begins, or with the text.  A source ends
    with the first closing tag behind it, which must come before the package's end; further sources that open before that are
    passed over.  Of a file that a report names twice with lines, the last place counts; files without lines are left out.  A
    report of any size is scanned in parts.
    """
    tag = lambda pattern: F.regexp_extract("line", pattern, 1)
    package, source, line = r"<package\s+name=\"([^\"]*)\"", r"<sourcefile\s+name=\"([^\"]*)\"", r"<line\s+nr=\"(\d+)\"\s+mi=\"\d+\"\s+ci=\"(\d+)\"[^/]*/$"
    kind = F.when(F.col("line").rlike(line), "line").when(F.col("line").rlike(source), "source").when(F.col("line").endswith("</sourcefile"), "/source").when(F.col("line").rlike(package), "package").when(F.col("line").endswith("</package"), "/package")
    tags = _rows(reports, ">").withColumn("kind", kind).where("kind is not null")
    name = F.when(F.col("kind") == "source", tag(source)).when(F.col("kind") == "package", tag(package))
    number = lambda k: F.regexp_extract("line", line, k).try_cast("bigint")
    tags = tags.select("report", "part", "ord", "kind", name.alias("name"), (number(2) > 0).alias("executed"), (number(1) - 1).cast("int").alias("start_line"))
    tags = carried(tags, {"last": F.when(F.col("kind") != "line", F.col("kind"))}, ["report"], before=("last",))
    place = F.struct("kind", "name", F.struct("part", "ord").alias("at"))
    opened = F.when(F.col("kind") == "source", F.when(~F.col("last").eqNullSafe(F.lit("source")), place)).when(F.col("kind") != "line", place)
    heads = {"package": F.when(F.col("kind").isin("package", "/package"), place), "source": opened, "next": F.when(~F.col("kind").isin("line", "source"), F.col("kind"))}
    lines = carried(tags, heads, ["report"], after=("next",)).where("kind = 'line' and package.kind = 'package' and source.kind = 'source' and next = '/source'")
    file = F.when(F.col("package.name") == "", F.col("source.name")).otherwise(F.concat_ws("/", "package.name", "source.name"))
    found = lines.select("report", file.alias("file"), F.col("source.at").alias("_at"), F.struct("part", "ord").alias("ord"), "executed", "start_line").where("executed is not null and start_line >= 0")
    last = found.groupBy("report", "file").agg(F.max("_at").alias("_last"))
    kept = found.join(last, ["report", "file"]).where(F.col("_at") == F.col("_last"))
    return kept.select("report", "file", "ord", "executed", "start_line", F.col("start_line").alias("end_line"))


def merged(*statements: DataFrame) -> DataFrame:
    """All statements of all tables; nothing is united by line."""
    out = statements[0]
    for more in statements[1:]:
        out = out.unionByName(more)
    return out


def absolute_path(path: Column, root: str) -> Column:
    """A path of a report, relative ones below root; backslashes become slashes and dot segments are resolved at the front."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    p = F.when(p.rlike("^/"), p).when(p.rlike("^[A-Za-z]:/"), F.concat(F.lit("/"), p)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))
    return F.regexp_replace(F.regexp_replace(p, r"/(\./)+", "/"), r"/[^/]+/\.\./", "/")


def at_uris(statements: DataFrame, root: str) -> DataFrame:
    """LCOV statements at file URLs; if one report names a file by several paths, the last of them in the report counts."""
    from riskweave.functions.text import path_uris

    x = statements.withColumn("uri", path_uris(absolute_path(F.col("file"), root)))
    last = x.groupBy("report", "uri").agg(F.max_by("file", "ord").alias("_file"))
    return x.join(last, ["report", "uri"]).where(F.col("file") == F.col("_file")).select("uri", "executed", "start_line", "end_line")


def suffix_uris(statements: DataFrame, files: DataFrame) -> DataFrame:
    """JaCoCo statements at the first file (uri, by order) whose path ends in their key.

    Keys and files meet by the hash of the last segments of a path, as many as the key has, and by that text itself; a file takes part with as many
    tails as there are lengths of keys.  Files of one name thus don't meet, however many there are."""
    keys = statements.select("file").distinct().where("file is not null").withColumn("_n", F.size(F.split("file", "/")))
    lengths = F.broadcast(keys.agg(F.array_sort(F.collect_set("_n")).alias("_lengths")))  # one row: a number a depth of folders
    segments = files.select("uri", F.split("uri", "/").alias("_s")).join(lengths)
    tails = segments.select("uri", F.explode(F.filter("_lengths", lambda n: n <= F.size("_s"))).alias("_n"), "_s")
    tails = tails.select("uri", "_n", F.array_join(F.slice("_s", -F.col("_n"), F.col("_n")), "/").alias("file"))
    key = [F.xxhash64("file").alias("_h"), "_n", "file"]
    first = keys.select(*key).join(tails.select("uri", *key), ["_h", "_n", "file"]).groupBy("file").agg(F.min("uri").alias("uri"))
    return statements.join(first, "file").select("uri", "executed", "start_line", "end_line")


def stored(statements: DataFrame, uri: str, ignore_case: bool = False) -> DataFrame:
    """The statements of a file; where paths know no case, those that differ in case only are taken if none is equal."""
    if not ignore_case:
        return statements.where(F.col("uri") == uri)
    alike = statements.where(F.lower("uri") == uri.lower())
    some = alike.agg(F.coalesce(F.max(F.col("uri") == uri), F.lit(False)).alias("_some"))  # one row
    return alike.crossJoin(F.broadcast(some)).where((F.col("uri") == uri) | ~F.col("_some")).drop("_some")
