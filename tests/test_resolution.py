"""Calls through imports, re-exports, types and inheritance, from the sources on."""

import pytest

from riskweave.operators import resolution
from riskweave.plans.engine import RiskEngine
from riskweave.sources import script_code


def edges(spark, **files):
    """{(caller, callee)} as file:function names; slashes in names of files are double underscores."""
    docs, names = [], {}
    for k, (name, text) in enumerate(files.items()):
        uri = f"file:///w/{name.replace('__', '/')}.ts"
        docs.append((k, uri, "typescript", text.split("\n")))
        for f in script_code.parse(text).functions:
            names[f"{uri}#{f.line}:{f.character}"] = f"{name}:{f.class_name + '.' if f.class_name else ''}{f.name}"
    found = RiskEngine(spark).call_graph(spark.createDataFrame(docs, "ord long, uri string, language_id string, lines array<string>"))
    return {(names[r["caller"]], names[r["callee"]]) for r in found.collect()}


def test_reexports(spark):
    got = edges(
        spark,
        a="export function f() {}\nexport function g() {}\nexport default function h() {}",
        b="export { f as f2, g } from './a';\nexport * from './a';",
        c="export * from './b';\nexport { default as h } from './a';",
        d__index="import { f2 } from '../c';\nexport { f2 as f3 };\nexport * as all from '../c';",
        e="import { f3, all } from './d';\nimport first, { g } from './c';\nimport def from './a';\nimport * as ns from './c';\nimport { h } from './c';\nfunction run() { f3(); g(); def(); first(); ns.f2(); ns.nothing(); h(); all.g(); }",
        x="export { y } from './z';\nexport { z1 as z2 } from './x';",
        z="export { y } from './x';\nimport { y } from './x';\nfunction r() { y(); }",
    )
    assert got == {("e:run", f"a:{n}") for n in "fgh"}


def test_own_names_go_before_those_of_stars(spark):
    got = edges(spark, a="export function f() {}", b="export function f() {}", c="export * from './a';\nexport function f() {}", d="export * from './c';\nexport * from './b';", e="import { f } from './c';\nfunction r() { f(); }", g="import { f } from './d';\nfunction r() { f(); }")
    assert got == {("e:r", "c:f"), ("g:r", "b:f")}  # of stars the nearest, then the first by name


def test_typed_receivers(spark):
    got = edges(
        spark,
        base="export class Base {\n  save() {}\n  log() { this.save(); }\n}",
        repo="import { Base } from './base';\nexport class Repo extends Base {\n  static make() {}\n  find() { this.log(); }\n  save() { this.missing(); }\n}\nexport interface Shape { area(): number }",
        barrel="export { Repo as Store } from './repo';",
        use="import { Store } from './barrel';\nimport type { Shape } from './repo';\nconst shared: Store = make();\nclass Service {\n  private cache = new Store();\n  other?: Store | null;\n  constructor(private readonly repo: Store, plain: Store) {}\n"
        "  a() { this.repo.find(); this.cache.save(); }\n  b(x: Store, s: Shape) { x.log(); s.area(); this.other.save(); }\n  c() { const x = new Store(); { const x: Service = y; x.a(); } x.save(); }\n  d() { Store.make(); shared.find(); this.plain.find(); q.repo.find(); }\n}\nconst arrow = (r: Store): void => r.find();",
    )
    calls = lambda f, *to: {(f, x) for x in to}
    assert got == (
        calls("base:Base.log", "base:Base.save")
        | calls("repo:Repo.find", "base:Base.log")
        | calls("use:Service.a", "repo:Repo.find", "repo:Repo.save")
        | calls("use:Service.b", "base:Base.log", "repo:Repo.save")
        | calls("use:Service.c", "use:Service.a", "repo:Repo.save")
        | calls("use:Service.d", "repo:Repo.make", "repo:Repo.find")
        | calls("use:arrow", "repo:Repo.find")
    )


def test_closures(spark):
    pairs = lambda *xs: spark.createDataFrame(list(xs), "a string, b string")
    chain = pairs(*[(f"n{k:03d}", f"n{k + 1:03d}") for k in range(100)], ("p", "q"), ("q", "p"), ("o", "p"))
    assert {(r["a"], r["b"]) for r in resolution.jumped(chain).collect()} == {(f"n{k:03d}", "n100") for k in range(100)}
    got = {(r["a"], r["b"]): r["steps"] for r in resolution.reached(pairs(("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", "x"))).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 1, ("b", "c"): 1, ("b", "a"): 2, ("c", "a"): 1, ("c", "b"): 2}
    assert resolution.jumped(pairs(("a", "b")).limit(0)).count() == 0 and resolution.reached(pairs(("a", "b")).limit(0)).count() == 0


@pytest.mark.parametrize("text, want", [("class A<T> extends B<T> implements C {}", [("A", "B")]), ("const x = class extends Y {}", []), ("class A extends ns.B {}", [("A", None)])])
def test_classes(text, want):
    assert [c[:2] for c in script_code.parse(text).classes] == want
