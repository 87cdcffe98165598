r"""Chat formatting: conversations as training texts, made and read back with Spark expressions only.

The turns of a conversation are collected as structs, sorted by (turn, role, text), runs of one role are merged, and a template marks the
result::

    [SYS]be brief[/SYS][INST]hello[NEXT]who are you[/INST]<s>a model</s>[ROLE]judge[TEXT]fine[/ROLE]

Inside texts and role names a control string gets a backslash after its first character, and one that has backslashes there gets one more, so
that `[INST]` becomes `[\INST]` and `[\INST]` becomes `[\\INST]`: no control string is left, and taking one backslash away gives the text
again.  Control strings begin with `<` or `[` and hold neither further on, so none can arise between a text and a mark.

The loss mask is a list of spans in UTF-8 bytes of the formatted text, one for each text of the roles that are learned, marks left out.

A null text or role is empty; a null turn comes first; rows that tie in all three are interchangeable; rows without a conversation id
form one conversation without an id; an empty table gives an empty result.  Only the four columns named are read, so other columns can't clash.  A
conversation is one row of the result, hence limited to what a row can hold (2 GB); its work is linear in its length.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CONTROL = re.compile(r"[<\[]/?[A-Za-z_]+[>\]]")
#: Turns whose lengths are summed one after another; sums of such groups are carried on.
_GROUP = 256


@dataclass(frozen=True)
class Template:
    """Control strings: marks around the texts of known roles, around other roles' names and texts, and between merged texts."""

    roles: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    between: str = "[NEXT]"
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if bad := [c for c in self.controls if not _CONTROL.fullmatch(c)]:
            raise ValueError(f"no control strings: {bad}")
        if len(set(self.controls)) < len(self.controls):
            raise ValueError("control strings must differ")

    @property
    def controls(self) -> list[str]:
        return [*(mark for pair in self.roles.values() for mark in pair), *self.other, self.between]

    @property
    def _rests(self) -> str:
        return "|".join(re.escape(c[1:]) for c in self.controls)

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])(\\*)({self._rests})", r"$1\\$2$3")

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])\\(\\*)({self._rests})", "$1$2$3")

    def _chosen(self, role: Column, known: Callable[[tuple[str, str]], Column], unknown: Column) -> Column:
        return functools.reduce(lambda out, name: F.when(role == name, known(self.roles[name])).otherwise(out), self.roles, unknown)

    def opened(self, role: Column) -> Column:
        return self._chosen(role, lambda m: F.lit(m[0]), F.concat(F.lit(self.other[0]), self.escaped(role), F.lit(self.other[1])))

    def closed(self, role: Column) -> Column:
        return self._chosen(role, lambda m: F.lit(m[1]), F.lit(self.other[2]))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f's lambdas use it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _before(lengths: Column) -> Column:
    """For each of an array's numbers the sum of those before it; appending copies an array, hence two levels."""
    running = lambda xs: F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / _GROUP).cast("int") - 1, F.lit(0)))

    def joined(groups: Column) -> Column:
        totals = F.transform(groups, lambda g: F.element_at(g, -1))
        return _let(running(totals), lambda base: F.flatten(F.transform(groups, lambda g, k: F.transform(F.slice(g, 1, F.size(g) - 1), lambda x: x + F.get(base, k)))))

    return _let(F.transform(starts, lambda k: running(F.slice(lengths, k * _GROUP + 1, _GROUP))), joined)


def merged(turns: Column) -> Column:
    """array<struct<role, texts>> of array<struct<turn, role, text>>: neighbours of one role become one."""

    def of(sorted_: Column) -> Column:
        role = lambda k: F.get(sorted_, k)["role"]
        firsts = F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), lambda k: (k == 0) | (role(k) != role(k - 1)))
        run = lambda begin, end: F.struct(role(begin).alias("role"), F.transform(F.slice(sorted_, begin + 1, end - begin), lambda t: t["text"]).alias("texts"))
        return _let(firsts, lambda b: F.transform(b, lambda begin, k: run(begin, F.coalesce(F.get(b, k + 1), F.size(sorted_)))))

    return _let(turns, of)


def formatted(rows: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, formatted (string) and loss (array<struct<start long, length long>>, in bytes): one row a conversation."""
    t = template or Template()
    empty = F.lit("")
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text"))
    held = rows.select(F.col(conv).alias(conv), one.alias("_turn")).groupBy(conv).agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))

    def messages(block: Column) -> Column:
        """The escaped texts of a run, each with the marks before and after it."""
        last = F.size(block["texts"]) - 1
        return F.transform(
            block["texts"],
            lambda x, k: F.struct(
                F.when(k == 0, t.opened(block["role"])).otherwise(t.between).alias("before"),
                t.escaped(x).alias("text"),
                F.when(k == last, t.closed(block["role"])).otherwise("").alias("after"),
                block["role"].isin(list(t.learned)).alias("learned"),
            ),
        )

    size = lambda m, *parts: functools.reduce(operator.add, [F.octet_length(m[p]) for p in parts]).cast("long")
    out = held.select(conv, F.flatten(F.transform(merged(F.col("_turns")), messages)).alias("_messages"))
    m = F.col("_messages")
    starts = _before(F.transform(m, lambda x: size(x, "before", "text", "after")))
    spans = _let(starts, lambda at: F.transform(m, lambda x, k: F.struct((F.get(at, k) + size(x, "before")).alias("start"), size(x, "text").alias("length"), x["learned"].alias("learned"))))
    loss = F.transform(F.filter(spans, lambda s: s["learned"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    return out.select(conv, F.array_join(F.transform(m, lambda x: F.concat(x["before"], x["text"], x["after"])), "").alias("formatted"), loss.alias("loss"))


def read_back(text: Column, template: Template | None = None) -> Column:
    """array<struct<role, text>> of a formatted text: the turns as they were, merged ones apart again."""
    t = template or Template()
    q = re.escape
    name, inner, end = t.other
    pairs = [*t.roles.values(), (name, end)]
    blocks = F.regexp_extract_all(text, F.lit("(?s)" + "|".join(f"{q(a)}.*?{q(b)}" for a, b in pairs)), F.lit(0))

    def turns(block: Column) -> Column:
        of = lambda a, b: F.substring(block, F.lit(len(a) + 1), F.length(block) - len(a) - len(b))
        unknown = _let(of(name, end), lambda x: F.struct(t.unescaped(F.substring_index(x, inner, 1)).alias("role"), F.regexp_replace(x, f"(?s)^.*?{q(inner)}", "").alias("body")))
        known = [(F.startswith(block, F.lit(a)), F.struct(F.lit(role).alias("role"), of(a, b).alias("body"))) for role, (a, b) in t.roles.items()]
        parsed = functools.reduce(lambda out, x: F.when(x[0], x[1]).otherwise(out), known, unknown)
        return _let(parsed, lambda x: F.transform(F.split(x["body"], q(t.between), -1), lambda y: F.struct(x["role"].alias("role"), t.unescaped(y).alias("text"))))

    return F.flatten(F.transform(blocks, turns))


def learned_text(text: Column, loss: Column, template: Template | None = None) -> Column:
    """What stands under the loss mask, unescaped, in order and with nothing between."""
    t = template or Template()
    cut = lambda data: F.transform(loss, lambda s: t.unescaped(F.substring(data, s["start"].cast("int") + 1, s["length"].cast("int")).cast("string")))
    return F.array_join(_let(F.encode(text, "UTF-8"), cut), "")
