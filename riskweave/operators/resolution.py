"""Calls resolved to the functions they lead to, by joins; the result is a table of edges (ord, caller, callee)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.text import symbol_id
from riskweave.lineage import cut, placed


def _edges(found: DataFrame) -> DataFrame:
    """Edges without self-calls, the first of equal ones, numbered in the order of files and calls: files have numbers without gaps, so that
    40 bits hold a trillion of them beside the calls of each and the language."""
    kept = found.where(F.col("callee").isNotNull() & (F.col("caller") != F.col("callee")))
    first = kept.groupBy("caller", "callee").agg(F.min(F.struct("file_ord", "call")).alias("at"))
    return first.select((F.shiftleft(F.col("at.file_ord"), 20) + F.col("at.call")).alias("ord"), "caller", "callee")


def method_index(declarations: DataFrame) -> DataFrame:
    """class_name, name, id: of methods of one class and name, in whichever files, the last counts."""
    sid = symbol_id(F.col("uri"), F.col("line"), F.col("character"))
    return declarations.groupBy("class_name", "name").agg(F.max_by(sid, F.struct("file_ord", "ord")).alias("id"))


def java_target(own: Column, receiver: Column, field_type: Column) -> Column:
    """The class a call looks in: the own class without a receiver or with `this`, else the field's type, else the receiver as a class."""
    return F.when(receiver.isNull() | (receiver == "this"), own).otherwise(F.coalesce(field_type, receiver))


def java_edges(declarations: DataFrame, calls: DataFrame, fields: DataFrame) -> DataFrame:
    index = method_index(declarations.where("language = 'java'")).select(F.col("class_name").alias("_c"), F.col("name").alias("_m"), F.col("id").alias("callee"))
    known = fields.select(F.col("uri").alias("_u"), F.col("name").alias("_f"), F.col("type").alias("_t"))
    x = calls.where("language = 'java'").join(known, (F.col("uri") == F.col("_u")) & (F.col("receiver") == F.col("_f")), "left")
    x = x.withColumn("_c2", java_target(F.col("class_name"), F.col("receiver"), F.col("_t")))
    found = x.join(index, (F.col("_c2") == F.col("_c")) & (F.col("name") == F.col("_m")))
    return _edges(found.withColumn("caller", symbol_id(F.col("uri"), F.col("line"), F.col("character"))))


def module_path(uri: Column, module: Column) -> Column:
    """A relative module next to a file, without its extension; null for packages."""
    folder = F.regexp_replace(uri, r"/[^/]*$", "")
    joined = F.concat_ws("/", folder, module)
    clean = F.regexp_replace(joined, r"/\.(?=/|$)", "")
    for _ in range(8):
        clean = F.regexp_replace(clean, r"/[^/]+/\.\.(?=/|$)", "")
    return F.when(module.startswith("."), F.regexp_replace(clean, r"\.(ts|tsx|js|jsx|mjs|cjs)$", ""))


_EXTENSION = r"\.(ts|tsx|js|jsx|mjs|cjs)$"


def jumped(pairs: DataFrame) -> DataFrame:
    """pairs(a, b), one row an a: a, b, where b is the last of the way a, b, the b of that, and so on; without those that never end.

    Pointer jumping: each round replaces b by what b leads to, so that a way of n steps takes log2(n) rounds."""
    now, rounds = cut(pairs), 0
    total = now.count()
    while total and rounds <= math.ceil(math.log2(total + 1)):
        on = now.select(F.col("a").alias("b"), F.col("b").alias("_next"))
        now = cut(now.select("a", "b").join(on, "b", "left").select("a", F.coalesce("_next", "b").alias("b"), F.col("_next").isNotNull().alias("_moved")))
        rounds += 1
        if not now.where("_moved").limit(1).count():
            break
    now = now.select("a", "b")
    return now.join(now.select(F.col("a").alias("b")), "b", "left_anti").select("a", "b") if total else now


def reached(pairs: DataFrame) -> DataFrame:
    """pairs(a, b): a, b, steps, for everything that can be reached from a, with the fewest steps; the ways double each round."""
    now = cut(pairs.where("a <> b").select("a", "b", F.lit(1).cast("bigint").alias("steps")).distinct())
    size = now.count()
    while size:
        far = now.join(now.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("steps").alias("more")), "b").where("a <> c").select("a", F.col("c").alias("b"), (F.col("steps") + F.col("more")).alias("steps"))
        now = cut(now.unionByName(far).groupBy("a", "b").agg(F.min("steps").alias("steps")))
        grown = now.count()
        if grown == size:
            break
        size = grown
    return now


def _key(stem, name) -> Column:
    return F.concat_ws("#", stem, name)


def export_targets(declared: DataFrame, exports: DataFrame, imports: DataFrame) -> DataFrame:
    """asked, target: for the names that modules pass on, as keys stem#name, where they are declared, over any number of modules.

    declared(stem, name), exports(stem, exported, local, to), imports(stem, local, to, exported), `to` being the stem of a module.  A
    module's own declarations and named exports go before those of `export *`, of which the nearest module counts, then the first by name; `default`
    isn't passed on by `export *`.  Names that lead round in a circle have no target."""
    named = exports.where("exported <> '*'")
    through = named.where("to is null").join(imports.select("stem", "local", F.col("to").alias("_to"), F.col("exported").alias("_exported")), ["stem", "local"], "left")
    target = F.when(F.col("_to").isNotNull(), _key(F.col("_to"), F.col("_exported"))).otherwise(_key(F.col("stem"), F.col("local")))
    own = through.select(_key(F.col("stem"), F.col("exported")).alias("a"), target.alias("b"))
    own = own.unionByName(named.where("to is not null").select(_key(F.col("stem"), F.col("exported")).alias("a"), _key(F.col("to"), F.col("local")).alias("b")))
    own = cut(own.where("a <> b").groupBy("a").agg(F.min("b").alias("b")))
    here = declared.select("stem", "name").unionByName(named.select("stem", F.col("exported").alias("name"))).distinct()
    stars = reached(exports.where("exported = '*' and to is not null").select(F.col("stem").alias("a"), F.col("to").alias("b")))
    passed = stars.join(here.where("name <> 'default'").select(F.col("stem").alias("b"), "name"), "b").groupBy("a", "name").agg(F.min(F.struct("steps", "b")).alias("x"))
    passed = passed.select(_key(F.col("a"), F.col("name")).alias("a"), _key(F.col("x.b"), F.col("name")).alias("b"))
    first = here.select(_key(F.col("stem"), F.col("name")).alias("a"))
    every = own.unionByName(passed.join(first, "a", "left_anti"))
    return jumped(every).select(F.col("a").alias("asked"), F.col("b").alias("target"))


def script_edges(declarations: DataFrame, calls: DataFrame, imports: DataFrame, exports: DataFrame, classes: DataFrame, bindings: DataFrame) -> DataFrame:
    """Calls of scripts, resolved by joins.

    A plain name is an imported one, followed through re-exports, or a function of the file.  Before a dot stand `this` (the class around, or the
    nearest it extends that has the method), a variable, parameter or this.field with a named type, of which the innermost at the call counts (methods
    likewise), a namespace, or a class.  Types, classes and what they extend are looked up as names of their files, so through imports and
    re-exports too."""
    sid = symbol_id(F.col("uri"), F.col("line"), F.col("character"))
    stem = F.regexp_replace("uri", _EXTENSION, "").alias("stem")
    all_ = declarations.where("language = 'script' and linked").withColumn("id", sid).select("*", stem)
    calls = calls.where("language = 'script'").select("*", stem)
    files = all_.select("stem")
    for t in (calls, imports.select(stem), exports.select(stem), classes.select(stem)):
        files = files.union(t.select("stem"))
    files = cut(files.distinct())
    # a module is a file, or the index of a folder
    index = files.where("stem like '%/index'").select(F.regexp_replace("stem", "/index$", "").alias("asked"), "stem", F.lit(1).alias("_p"))
    places = files.select(F.col("stem").alias("asked"), "stem", F.lit(0).alias("_p")).unionByName(index).groupBy("asked").agg(F.min_by("stem", "_p").alias("to"))
    to = lambda t: t.select("*", stem, module_path(F.col("uri"), F.col("module")).alias("asked")).join(places, "asked", "left").drop("asked")
    functions = all_.where("class_name is null").groupBy("stem", "name").agg(F.min_by("id", "ord").alias("id"))
    methods = all_.where("class_name <> ''").groupBy("stem", "class_name", "name").agg(F.min_by("id", "ord").alias("id"))
    classes = classes.select(stem, "name", "base")
    bound = to(imports).where("to is not null").select("stem", "local", "to", "exported")
    passed_on = exports.where("module is not null or exported <> local")
    if not passed_on.isEmpty():
        declared = cut(functions.select("stem", "name").unionByName(classes.select("stem", "name")).distinct())
        bound = cut(bound)
        targets = cut(export_targets(declared, to(exports).where("module is null or to is not null").select("stem", "exported", "local", "to"), bound))
    else:  # only names that are declared and imported where they are
        targets = passed_on.select(F.col("exported").alias("asked"), F.col("local").alias("target"))
    resolved = lambda t, c: t.join(targets.withColumnRenamed("asked", c), c, "left").withColumn(c, F.coalesce("target", c)).drop("target")
    # what a name of a file stands for: an imported one, else one of its own
    names = resolved(bound.select(_key(F.col("stem"), F.col("local")).alias("said"), _key(F.col("to"), F.col("exported")).alias("means")), "means").groupBy("said").agg(F.min("means").alias("means"))
    meaning = lambda t, c, out: t.withColumn("said", _key(F.col("stem"), F.col(c))).join(names, "said", "left").withColumn(out, F.coalesce("means", "said")).drop("said", "means")
    # methods of classes and of those that they extend
    bases = meaning(classes.where("base is not null"), "base", "b").select(_key(F.col("stem"), F.col("name")).alias("a"), "b")
    own = methods.select(_key(F.col("stem"), F.col("class_name")).alias("class"), F.col("name").alias("method"), F.col("id").alias("method_id"))
    methods = own
    if not classes.where("base is not null").isEmpty():
        above = reached(bases).join(own.withColumnRenamed("class", "b"), "b").select(F.col("a").alias("class"), "method", "method_id", "steps")
        methods = own.withColumn("steps", F.lit(0).cast("bigint")).unionByName(above).groupBy("class", "method").agg(F.min_by("method_id", "steps").alias("method_id"))
    functions = functions.select(_key(F.col("stem"), F.col("name")).alias("function"), F.col("id").alias("function_id"))
    # plain names
    calls = calls.select("file_ord", "call", "uri", "stem", "class_name", "receiver", "name", "place", sid.alias("caller"))
    plain = meaning(calls.where("receiver is null"), "name", "function").join(functions, "function").select("file_ord", "call", "caller", F.col("function_id").alias("callee"))
    # this
    inside = calls.where("receiver = 'this'").withColumns({"class": _key(F.col("stem"), F.col("class_name")), "method": F.col("name")}).join(methods, ["class", "method"])
    # variables, parameters and fields: the innermost that holds at the call
    other = calls.where("receiver not in ('this', '')")
    held = bindings.select("uri", F.col("name").alias("receiver"), "type", "first", "last")
    typed = other.join(held, ["uri", "receiver"]).where("place between first and last").groupBy("file_ord", "call", "stem", "caller", "name").agg(F.max_by("type", "first").alias("type"))
    through = meaning(typed, "type", "class").withColumn("method", F.col("name")).join(methods, ["class", "method"])
    # namespaces and classes
    rest = other.join(typed.select("file_ord", "call"), ["file_ord", "call"], "left_anti")
    meant = meaning(rest, "receiver", "class").withColumn("method", F.col("name"))
    whole = meant.where(F.col("class").endswith("#*")).withColumn("function", F.concat(F.expr("substring(class, 1, length(class) - 1)"), "name"))
    whole = resolved(whole, "function").join(functions, "function").select("file_ord", "call", "caller", F.col("function_id").alias("callee"))
    through = through.select("file_ord", "call", "caller", "method_id").unionByName(meant.join(methods, ["class", "method"]).select("file_ord", "call", "caller", "method_id"))
    through = through.unionByName(inside.select("file_ord", "call", "caller", "method_id")).withColumnRenamed("method_id", "callee")
    return _edges(plain.unionByName(whole).unionByName(through))


def united(*edges: DataFrame) -> DataFrame:
    """The edges of several languages, one after the other; the number of the table leads in ord."""
    out = None
    for k, e in enumerate(edges):
        e = e.select((F.lit(k).cast("bigint") * (1 << 60) + F.col("ord")).alias("ord"), "caller", "callee")
        out = e if out is None else out.unionByName(e)
    return out


def first_matching(symbols: DataFrame, path: str, name: str) -> DataFrame:
    """The first symbol, by ord, of a name in a file given by its path or the end of it."""
    from riskweave.functions.text import path_matches

    return symbols.where((F.col("name") == name) & path_matches(F.col("uri"), F.lit(path))).orderBy("ord").limit(1)


def ordered_by(metrics: DataFrame, field: str) -> DataFrame:
    """Adds place, from 1: descending by a metric, equal ones in input order."""
    if field not in ("f", "f_prime", "g", "cc", "crap"):
        raise ValueError(f"can't sort by {field}")
    return placed(metrics, F.col(field).desc(), F.col("ord"), first=1)
