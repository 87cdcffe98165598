import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "text string, lang string, source string"


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_docs=3, top=200):
    """The audit by dictionaries and Python's integers."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts, groups = collections.Counter(), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for text, lang, source in rows:
        groups[lang].add(source)
        terms = TERM.findall(lowered(text))
        docs.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= min_docs)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 1) // (total[s] + len(kept)) for t in kept} for s in sources}
        whole = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 1) // (sum(total.values()) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], whole[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)}
    return out


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["The", "the", "straße", "École", "naïve", "don't", "x1y", "日本語", "𝄞clef", "ÀB", "ab", *(f"{a}{b}" for a in "KLMN" for b in ("a", "é", "", "OO"))]
    text = lambda: rng.choice([" ", "\n", "-", ""]).join(rng.choices(words, range(len(words), 0, -1), k=rng.randrange(40)))
    return [(None if rng.random() < 0.05 else text(), rng.choice(["en", "en", "en", "fr", None, ""]), rng.choice(["hot"] * 5 + ["a", "b", "é", None])) for _ in range(n)]


@pytest.mark.parametrize("seed, part_bytes, cells, min_docs, top", [(0, 1 << 20, 1 << 17, 3, 200), (1, 60, 40, 3, 5), (2, 7, 1, 1, 200), (3, 200, 300, 60, 3)])
def test_against_dictionaries(spark, seed, part_bytes, cells, min_docs, top):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = D.audit(df, min_docs, top, part_bytes, cells).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute(rows, min_docs, top)


def test_collisions_are_told_apart():
    words = ["a", "b", "ab", "ba", "a", "abc", "b", "é", "ab"]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends = D.slices(data, np.array([0, len(data)]))
    for digest in (lambda x: 7, lambda x: len(x), lambda x: x[0]):
        group, heads = D.grouped(data, starts, ends, digest)
        byte = [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)]
        assert [byte[heads[g]] for g in group] == byte and len(set(group.tolist())) == len(set(words))


def test_texts_are_boundaries():
    texts = ["ab", "", "cd", "é", " x ", "y"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    starts, ends = D.slices(data, offsets)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == ["ab", "cd", "é", "x", "y"]


def test_arithmetic_of_large_counts():
    for n, total, kept in [(0, 0, 1), (10**12, 3 * 10**13, 10**8), (9 * 10**15 - 7, 9 * 10**15 - 7, 5), (5, 10, 3)]:
        assert D.scaled(np.array([n]), np.array([total]), kept).tolist() == [1 + 10**9 * (n + 1) // (total + kept)]


def test_odd_tables(spark):
    empty = D.audit(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [(None, None, None), ("", "en", "a"), ("1 2 3", "en", "b"), ("x " * 50_000 + "long" * 30_000, "de", "a"), ("x", "de", "b"), ("x", "de", "b")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"term": F.lit(1), "n": F.lit(2), "held": F.lit(3), "kept": F.lit(4), "block": F.lit(5)})
    assert {tuple(r) for r in D.audit(df, part_bytes=1000).collect()} == brute(rows)
