import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from riskweave.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"
MARKS = chat.Template().controls


def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def odd_text(rng: random.Random) -> str | None:
    """Control strings, whole and in part, escaped and not, among words."""
    pieces = [*MARKS, *(m[0] + "\\" * rng.randrange(3) + m[1:] for m in MARKS), *(m[:-1] for m in MARKS), "<", "[", "\\", "é", "𝄞", "\n", " ok ", "$1", ""]
    return None if rng.random() < 0.1 else "".join(rng.choice(pieces) for _ in range(rng.randrange(8)))


def plain(rows, template):
    """Conversations formatted turn by turn: {conv: (text, learned text)}."""
    import re

    escape = lambda x: re.sub(rf"([<\[])(\\*)({template._rests})", r"\1\\\2\3", x)
    out = {}
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, turns in itertools.groupby(sorted(rows, key=order), key=lambda r: r[0]):
        text = ""
        turns = [(r[2] or "", r[3] or "") for r in turns]
        for role, run in itertools.groupby(turns, key=lambda x: x[0]):
            a, b = template.roles.get(role, (f"[ROLE]{escape(role)}[TEXT]", "[/ROLE]"))
            text += a + template.between.join(escape(x[1]) for x in run) + b
        out[conv] = (text, turns, "".join(x[1] for x in turns if x[0] == "assistant"))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_round_trip_against_a_plain_formatter(spark, seed):
    rng = random.Random(seed)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "[ROLE]", "", None]
    rows = [(rng.choice([0, 1, 2, 3, None]), rng.choice([None, *range(9)]), rng.choice(roles), odd_text(rng)) for _ in range(120)]
    t = chat.Template()
    out = chat.formatted(rows_of(spark, rows))
    got = out.select("conv_id", "formatted", "loss", chat.read_back(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    want = plain(rows, t)
    assert {r["conv_id"] for r in got} == set(want) and len(got) == len(want)
    for r in got:
        text, turns, learned = want[r["conv_id"]]
        assert r["formatted"] == text
        assert [tuple(x) for x in r["turns"]] == turns
        assert r["learned"] == learned
        data = text.encode()
        assert not any(mark.encode() in data[s["start"] : s["start"] + s["length"]] for s in r["loss"] for mark in MARKS)


def test_only_spark_expressions(spark):
    plan = chat.formatted(rows_of(spark, [(1, 0, "user", "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_conversations_and_texts(spark):
    rows = [(1, k, ("user", "assistant")[k // 3 % 2], f"t{k} <s>") for k in range(2000)] + [(2, 0, "assistant", "[INST] word " * 100_000)]
    out = chat.formatted(rows_of(spark, rows)).select("conv_id", chat.read_back(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned"))
    got = {r["conv_id"]: r for r in out.collect()}
    assert [x["text"] for x in got[1]["turns"]] == [r[3] for r in rows[:2000]]
    assert got[1]["learned"] == "".join(r[3] for r in rows[:2000] if r[2] == "assistant")
    assert got[2]["learned"] == "[INST] word " * 100_000


def test_odd_tables(spark):
    assert chat.formatted(rows_of(spark, [])).count() == 0
    extra = rows_of(spark, [(1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None)]).withColumns({"formatted": F.lit(1), "_turns": F.lit(2), "loss": F.lit(3), "_messages": F.lit(4)})
    got = {r["conv_id"]: (r["formatted"], r["loss"]) for r in chat.formatted(extra).collect()}
    assert got == {1: ("[INST]a[NEXT]a[/INST]", []), None: ("[ROLE][TEXT][/ROLE]", [])}
    renamed = rows_of(spark, [(1, 0, "user", "a")]).toDF("formatted", "x", "loss", "conv_id")
    assert chat.formatted(renamed, conv="conv_id", turn="x", role="loss", text="conv_id").first()["formatted"] == "[INST]a[/INST]"
    with pytest.raises(ValueError):
        chat.Template(between="NEXT")
    with pytest.raises(ValueError):
        chat.Template(between="[INST]")


def test_query_on_small_table(spark, tmp_path):
    rows = [(3, 1, "assistant", "ü"), (3, 0, "user", "q"), (3, 2, "assistant", "</s>")]
    rows_of(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in queries.op11_relational_chat(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert set(got) == {3, -7} and got[3]["n_turns"] == 3 and got[3]["loss_chars"] == 5 and got[3]["loss_sha256"] == sha("ü</s>")
    assert got[3]["turns_sha256"] == sha("user\nq\nassistant\nü\nassistant\n</s>\n") and got[-7]["loss_sha256"] == sha("</s>[INST] ok [/INST]")
