"""Functions, calls and imports of source files, extracted on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.text import SCRIPT_LANGUAGES

CALLS = "file_ord long, uri string, language string, class_name string, line int, character int, call int, receiver string, name string, place int"
DECLARATIONS = "file_ord long, uri string, language string, class_name string, ord int, name string, line int, character int, linked boolean"
FIELDS = "file_ord long, uri string, name string, type string"
IMPORTS = "uri string, local string, module string, exported string"
EXPORTS = "uri string, exported string, local string, module string"
CLASSES = "uri string, name string, base string"
BINDINGS = "uri string, name string, type string, first int, last int"


#: What a source file is scanned into: a row a file, an array a kind.
PARTS = {
    "functions": "ord int, name string, sel_line int, sel_char int, body_start int, body_end int",
    "declarations": "class_name string, ord int, name string, line int, character int, linked boolean",
    "calls": "class_name string, line int, character int, call int, receiver string, name string, place int",
    "fields": "name string, type string",
    "imports": "local string, module string, exported string",
    "exports": "exported string, local string, module string",
    "classes": "name string, base string",
    "bindings": "name string, type string, first int, last int",
}
SCANNED = ", ".join(f"{k} array<struct<{v.replace(' ', ':').replace(',:', ',')}>>" for k, v in PARTS.items())
#: Scanning tasks a core: files differ in length.
TASKS_A_CORE = 4
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _family(language: str) -> str | None:
    return "script" if language in SCRIPT_LANGUAGES else language if language in ("python", "java") else None


def _java(source: str, _uri: str) -> dict[str, list[tuple]]:
    from riskweave.sources import java_code

    j = java_code.parse(source)
    if not j.class_name:
        return {"functions": java_code.functions(source)}
    calls = [(m, receiver, name) for m in j.methods for receiver, name in m.calls]
    return {
        "functions": java_code.functions(source),
        "declarations": [(j.class_name, k, m.name, m.line, 0, True) for k, m in enumerate(j.methods)],
        "calls": [(j.class_name, m.line, 0, k, receiver, name, None) for k, (m, receiver, name) in enumerate(calls)],
        "fields": list(j.fields),
    }


def _script(source: str, uri: str) -> dict[str, list[tuple]]:
    from riskweave.sources import script_code

    script = script_code.parse(source)
    out = {
        "functions": [(f.name, f.line, f.character, f.line, f.end_line) for f in script.functions],
        "imports": [(local, module, exported) for local, (module, exported) in script.imports.items()],
    }
    if not uri.endswith(".d.ts"):
        out["declarations"] = [(f.class_name, k, f.name, f.line, f.character, f.linked) for k, f in enumerate(script.functions)]
        out["calls"] = [(owner, f.line, f.character, k, receiver, name, place) for k, f, owner, receiver, name, place in script_code.placed_calls(script)]
        out["exports"], out["bindings"] = script.exports, script.bindings
        out["classes"] = [(name, base) for name, base, _, _ in script.classes]
    return out


def _python(source: str, _uri: str) -> dict[str, list[tuple]]:
    from riskweave.sources import python_code

    return {"functions": python_code.functions(source)}


_READERS = {"script": _script, "java": _java, "python": _python}


def scanned(documents: DataFrame) -> DataFrame:
    """documents(ord, uri, language_id, lines, ...): each file read once; the columns of documents and the arrays of PARTS.

    Files that can't be read as their language have empty arrays, and so have those of other languages.  A table of many files may be small, and one task's
    to read, so they are dealt over all cores first."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields) + f", {SCANNED}"
    kinds = {k: pa.list_(pa.struct([(n, _KINDS[t]) for n, t in (c.split() for c in v.split(", "))])) for k, v in PARTS.items()}
    names = {k: [c.split()[0] for c in v.split(", ")] for k, v in PARTS.items()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {k: [] for k in PARTS}
            rows = batch.select(["uri", "language_id", "lines"]).to_pylist()
            for d in rows:
                reader = _READERS.get(_family(d["language_id"]))
                try:
                    found = reader("\n".join(d["lines"]), d["uri"] or "") if reader and d["lines"] else {}
                except (IndexError, RecursionError):
                    found = {}
                if "functions" in found:
                    found["functions"] = [(k, *f) for k, f in enumerate(found["functions"])]
                for k in PARTS:
                    made[k].append([dict(zip(names[k], x, strict=True)) for x in found.get(k, [])])
            yield pa.record_batch([*batch.columns, *(pa.array(made[k], kinds[k]) for k in PARTS)], [*batch.schema.names, *PARTS])

    return dealt(documents).mapInArrow(read, schema)


def dealt(documents: DataFrame) -> DataFrame:
    """The rows of documents(uri, ...) over TASKS_A_CORE tasks a core, for work that takes far longer than reading them."""
    return documents.repartition(TASKS_A_CORE * documents.sparkSession.sparkContext.defaultParallelism, "uri")


def _of(documents: DataFrame) -> DataFrame:
    """Scanned sources as they are; documents are scanned."""
    if "functions" in documents.columns:
        return documents
    return scanned(documents if "ord" in documents.columns else documents.withColumn("ord", F.lit(0).cast("long")))


def functions(documents: DataFrame) -> DataFrame:
    """Documents, or scanned sources: the functions of each file, as FUNCTIONS."""
    return _of(documents).select("uri", F.inline("functions"))


def estimated_functions(sources: DataFrame) -> DataFrame:
    """The functions of scanned sources with file_ord and estimate, the complexity estimated from the lines of each, which go no further."""
    from riskweave.functions.text import estimated_cc
    from riskweave.operators.symbols import slice_text

    each = sources.select("uri", F.col("ord").alias("file_ord"), "lines", F.inline("functions"))
    return each.withColumn("estimate", estimated_cc(slice_text(F.col("lines"), F.col("body_start"), F.col("body_end")))).drop("lines")


def declarations(documents: DataFrame) -> DataFrame:
    """What calls can lead to: Java methods of files with a class, script functions."""
    return _parts(documents, "declarations", DECLARATIONS)


def calls(documents: DataFrame) -> DataFrame:
    """The calls inside functions, with the calling function's place."""
    return _parts(documents, "calls", CALLS)


def fields(documents: DataFrame) -> DataFrame:
    """The fields of Java files with a class; the first of a name counts."""
    return _parts(documents, "fields", FIELDS)


def imports(documents: DataFrame) -> DataFrame:
    return _parts(documents, "imports", IMPORTS)


def exports(documents: DataFrame) -> DataFrame:
    """Names that script files pass on: exported (* for all), local (* for a whole module), module (null for the file itself)."""
    return _parts(documents, "exports", EXPORTS)


def classes(documents: DataFrame) -> DataFrame:
    return _parts(documents, "classes", CLASSES)


def bindings(documents: DataFrame) -> DataFrame:
    """Variables, parameters and fields (this.name) of script files with the names of their types, and the tokens where they hold."""
    return _parts(documents, "bindings", BINDINGS)


def _parts(documents: DataFrame, kind: str, schema: str) -> DataFrame:
    sources = _of(documents)
    language = F.when(F.col("language_id").isin(*SCRIPT_LANGUAGES), "script").otherwise(F.col("language_id"))
    return sources.select(F.col("ord").alias("file_ord"), "uri", language.alias("language"), F.inline(kind)).select(*[c.split()[0] for c in schema.split(", ")])


def by_family(documents: DataFrame, family: str) -> DataFrame:
    return documents.where(F.col("language_id").isin(*SCRIPT_LANGUAGES) if family == "script" else F.col("language_id") == family)
