"""Source files: discovery and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.text import LANGUAGES, is_test_file, language_of, path_uris
from riskweave.lineage import placed
from riskweave.sources import listing
from riskweave.sources.ignore import is_ignored

#: Folders that discovery never enters, for the command line and for editors.
IGNORED_FOLDERS = ("node_modules", "out", "dist", ".git")
IGNORED_IN_EDITOR = ("node_modules",)


def _local(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/*", "/")


def discover(spark: SparkSession, root: str, max_files: int = 400, exclude_tests: bool = True, respect_gitignore: bool = False, scope: str | None = None, editor: bool = False) -> DataFrame:
    """ord, uri, language_id, lines of the source files below root, by path.

    The command line takes the first max_files and filters those; editors filter first, among twice as many, and take max_files then.
    scope limits both to a folder.  Names may begin with an underscore; those that begin with a dot are found in editors only, as patterns of the
    command line pass over them.  Only files that are left in the end are opened.
    """
    return numbered(documents(found_paths(spark, root, max_files, exclude_tests, respect_gitignore, scope, editor), scope or root))


def found_paths(spark: SparkSession, root: str, max_files: int = 400, exclude_tests: bool = True, respect_gitignore: bool = False, scope: str | None = None, editor: bool = False) -> DataFrame:
    """path, uri of the files that discover reads."""
    ignored = IGNORED_IN_EDITOR if editor else IGNORED_FOLDERS
    found = listing.listed(spark, scope or root, rf"\.({'|'.join(LANGUAGES)})$", ignored, editor, 2 * max_files if editor else max_files)
    files = found.select("path", path_uris(_local(F.col("path"))).alias("uri"))
    files = files.where(kept(spark, root, exclude_tests, respect_gitignore))
    return files.orderBy("path").limit(max_files) if editor else files


def kept(spark: SparkSession, root: str, exclude_tests: bool, respect_gitignore: bool) -> Column:
    """Whether a file, by uri, is left by the filters."""
    keep: Column = F.lit(True)
    if exclude_tests:
        keep = keep & ~is_test_file(F.col("uri"))
    if respect_gitignore and (text := ignore_text(spark, root)):
        from riskweave.functions.text import path_uri

        keep = keep & ~is_ignored(F.col("uri"), path_uri(root.rstrip("/")), text)
    return keep


def documents(paths: DataFrame, root: str) -> DataFrame:
    """uri, language_id, lines of paths(path, uri, ...), with their other columns; they are dealt over the tasks before any is opened."""
    others = [c for c in paths.columns if c not in ("path", "uri")]
    tasks = 2 * paths.sparkSession.sparkContext.defaultParallelism  # not fewer where paths are few bytes: files are far larger
    text = F.split(F.col("content").cast("string"), "\r?\n")
    return listing.contents(paths.repartition(tasks, "path"), root).select("uri", language_of(F.col("uri"), "plaintext").alias("language_id"), text.alias("lines"), *others)


def ignore_text(spark: SparkSession, root: str) -> str:
    """The root's ignore file on any file system that Spark reads; nothing if there is none, while other errors are raised."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.gitignore")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return ""
    stream = system.open(path)  # Spark's readers skip hidden files
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def numbered(files: DataFrame) -> DataFrame:
    """Adds ord, the place by uri.  The files are read once: what is made of them starts from a written table."""
    return placed(files, "uri", name="ord").select("ord", *files.columns)


def in_scope(uri: Column, root_uri: str) -> Column:
    return uri.startswith(root_uri if root_uri.endswith("/") else f"{root_uri}/")


def readable_scheme(uri: Column) -> Column:
    return uri.rlike("^(file|untitled):")
