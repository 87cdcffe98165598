"""Names, paths and source text as columns."""

from __future__ import annotations

from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Languages by file extension.
LANGUAGES = {
    "ts": "typescript",
    "tsx": "typescriptreact",
    "js": "javascript",
    "jsx": "javascriptreact",
    "mjs": "javascript",
    "cjs": "javascript",
    "py": "python",
    "java": "java",
}
SCRIPT_LANGUAGES = ("typescript", "typescriptreact", "javascript", "javascriptreact")
#: What names a test file; the second pattern is case-sensitive.
TEST_NAME = r"(?i)\.(test|spec)\.[^/\\]+$"
TEST_CLASS = r"(Test|Tests|IT)\.[^/\\]+$"
TEST_FOLDER = r"(?i)(^|[/\\])(__tests__|tests?|test_[^/\\]+)([/\\]|$)"


def is_test_file(uri: Column) -> Column:
    return uri.rlike(TEST_NAME) | uri.rlike(TEST_CLASS) | uri.rlike(TEST_FOLDER)


def language_of(uri: Column, unknown: str = "unknown") -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(uri, r"\.([A-Za-z]+)$", 1))), F.lit(unknown))


def symbol_id(uri: Column, line: Column, character: Column) -> Column:
    return F.concat(uri, F.lit("#"), line.cast("string"), F.lit(":"), character.cast("string"))


def parsed_symbol_id(sid: Column) -> Column:
    """struct(uri, line, character) of an id, split at its first #; null unless a uri stands before and two numbers behind it."""
    pattern = r"(?s)^([^#]+)#\s*([+-]?\d+)[^:]*:\s*([+-]?\d+)"
    part = lambda k: F.regexp_extract(sid, pattern, k)
    return F.when(
        sid.rlike(pattern), F.struct(part(1).alias("uri"), part(2).try_cast("int").alias("line"), part(3).try_cast("int").alias("character"))
    )


def path_matches(uri: Column, path: Column) -> Column:
    """Whether a uri is a path or ends in it at a slash; backslashes count as slashes."""
    u, p = F.replace(uri, F.lit("\\"), F.lit("/")), F.replace(path, F.lit("\\"), F.lit("/"))
    return (u == p) | u.endswith(F.concat(F.lit("/"), p))


def file_name(uri: Column) -> Column:
    return F.regexp_extract(uri, r"[^/\\]*$", 0)


def label_of(sid: Column) -> Column:
    """What follows the last # of an id, else the id."""
    return F.when(sid.contains("#"), F.regexp_extract(sid, r"[^#]*$", 0)).otherwise(sid)


def decoded_path(uri: Column) -> Column:
    """The path of a URL with percent signs decoded; a plus sign stays."""
    path = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def relative_path(uri: Column, root: str) -> Column:
    """The path of a file URL below root, else the uri as it is."""
    base = root.replace("\\", "/")
    base = base if base.startswith("/") else f"/{base}"
    base = base if base.endswith("/") else f"{base}/"
    path = decoded_path(uri)
    return F.when(uri.startswith("file:") & F.coalesce(path.startswith(base), F.lit(False)), F.substr(path, F.lit(len(base) + 1))).otherwise(uri)


def path_uri(path: str) -> str:
    """A local absolute path as a file URL."""
    return "file://" + quote(path.replace("\\", "/"), safe="/:@!$&'()*+,;=~-._")


def path_uris(path: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def encode(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: None if p is None else path_uri(p))

    return encode(path)


def leading_int(text: Column) -> Column:
    """The integer that a text begins with, after white space; null without one."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint")


#: Words, besides `if`, that each add a decision.
DECISION_WORDS = ("while", "for", "foreach", "case", "catch")
_WORD = r"(?<![A-Za-z0-9_]){}(?![A-Za-z0-9_])"


def estimated_cc(text: Column) -> Column:
    """Decisions in a source text plus one: the words above, `if`, && and ||, and conditional expressions.  Word bounds are ASCII."""
    words = "|".join((*DECISION_WORDS, "if"))
    count = F.regexp_count(text, F.lit(_WORD.format(f"(?:{words})"))) + F.regexp_count(text, F.lit(r"&&|\|\|")) + F.regexp_count(text, F.lit(r"\?[^;?:]+:"))
    return F.greatest(F.lit(1), 1 + count).cast("double")


def message_complexity(message: Column) -> Column:
    """The number in `complexity of N`."""
    return F.regexp_extract(message, r"(?i)complexity of (\d+)", 1).try_cast("double")


def html_escaped(text: Column) -> Column:
    out = text
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out
