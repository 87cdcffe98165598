"""Format-preserving pseudonyms for personal data: validated values are permuted within their own format by a keyed Feistel network.

A value becomes a number below the size of its format, the network permutes those numbers, and the result is written
in the same format and layout (a day or a phone number is one value in all its layouts), so that a pseudonym is valid where its value was, equal values get equal pseudonyms in all documents, and
different values of a format different ones.  Values that fail validation are left alone.  Without the key the mapping can't be
inverted; with it, it can (the rounds run backwards).
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import math
import re
import string
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean

ROUNDS = 8
#: Characters of an address's local part that are permuted together.
LOCAL_PART = 64
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


class Feistel:
    """A keyed permutation of 0 .. size - 1: alternating modular additions on two digits, walking the cycle back into the range."""

    def __init__(self, key: bytes, format_name: str, size: int, rounds: int = ROUNDS):
        self.size, self.rounds = size, rounds
        self.a = math.isqrt(size - 1) + 1
        self.b = -(-size // self.a)
        self.base = hashlib.blake2b(f"{format_name}:{size}".encode(), key=key[:64])

    def _round(self, i: int, half: int) -> int:
        h = self.base.copy()
        h.update(i.to_bytes(1, "big") + half.to_bytes((half.bit_length() + 7) // 8, "big"))
        return int.from_bytes(h.digest(), "big")

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in range(self.rounds):
            if i % 2:
                right = (right + self._round(i, left)) % self.b
            else:
                left = (left + self._round(i, right)) % self.a
        return left * self.b + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in reversed(range(self.rounds)):
            if i % 2:
                right = (right - self._round(i, left)) % self.b
            else:
                left = (left - self._round(i, right)) % self.a
        return left * self.b + right

    def permute(self, x: int, inside: Callable[[int], bool] = lambda x: True) -> int:
        """inside: a subset of the range that holds x and is to be kept."""
        x = self._once(x)
        while x >= self.size or not inside(x):
            x = self._once(x)
        return x

    def invert(self, x: int, inside: Callable[[int], bool] = lambda x: True) -> int:
        x = self._back(x)
        while x >= self.size or not inside(x):
            x = self._back(x)
        return x


def luhn_digit(payload: str) -> str:
    """The check digit after payload."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


@functools.cache
def _alphabet(c: str) -> str:
    """The characters that c may become: ASCII letters of its case, digits, or letters and digits of its category and 128 neighbours; others stay."""
    if not c.isalnum():
        return c
    if c.isascii():
        return string.digits if c.isdigit() else string.ascii_lowercase if c.islower() else string.ascii_uppercase
    first = ord(c) & ~127
    return "".join(x for x in map(chr, range(first, first + 128)) if x.isalnum() and unicodedata.category(x) == unicodedata.category(c) and _unspaced(x) == _unspaced(c))


@functools.cache
def _unspaced(c: str) -> bool:
    """Of a script written without spaces between words."""
    return unicodedata.name(c, "").startswith(("CJK", "HIRAGANA", "KATAKANA", "THAI", "LAO", "KHMER", "MYANMAR"))


def _in_local(c: str) -> bool:
    return c.isalnum() or c in "_%+-" or not c.isascii() and unicodedata.category(c)[0] == "M"


def _alnum_at(text: str, at: int) -> bool:
    c = text[at : at + 1]
    return c.isascii() and c.isalnum()


def iban_check(country: str, account: str) -> str:
    number = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{98 - number % 97:02d}"


#: The length of a country's IBANs.
_IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
#: How cards are written in groups; one group of all digits is another way.
_CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 1), (4, 4, 4, 4, 2), (4, 4, 4, 4, 3), (6, 13)}


class Pseudonyms:
    """Finds and replaces values in texts.  key: secret bytes, at most 64 of which count."""

    # What stands around an @: names joined by single dots on the left (see _local); a domain on the right.
    DOMAIN = re.compile(r"(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])")
    # An IBAN's start, whose ends are searched group by group; digits joined by single blanks or hyphens, which may hold cards among other numbers.
    IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9]{4})")
    IBAN_GROUP = re.compile(r" ?([A-Z0-9]{1,4})")
    DIGITS = re.compile(r"(?<![A-Za-z0-9])[0-9]+(?:[ -][0-9]+)*")
    # Longer formats stand first; of overlapping matches the earlier start, then the earlier kind wins.  Addresses come before all,
    # then IBANs, then cards.
    PATTERNS = {
        # Codes that begin with 0 or 1 are not given out; numbers that have them and are yet written as phones count too.
        "phone": re.compile(
            r"(?<![A-Za-z0-9])(?:(?:\+?1[ .-]?)?(?:(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}|\([0-9]{3}\) ?[0-9]{3})|\+1[ .-]?[0-9]{3}[ .-][0-9]{3})[ .-][0-9]{4}(?![A-Za-z0-9])"
        ),
        "e164": re.compile(r"(?<![A-Za-z0-9+])\+(?:[1-9][0-9]{7,14}|[2-9][0-9]{0,2}(?:[ .-]\(?[0-9]{1,4}\)?){2,5})(?![A-Za-z0-9])"),
        "ssn": re.compile(r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"),
        "ipv4": re.compile(r"(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9]|\.[0-9])"),
        "date": re.compile(r"(?<![A-Za-z0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T[0-9]{2}:)|(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![A-Za-z0-9]))"),
    }

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("a key is needed")
        self.key, self._made = key, {}

    def _feistel(self, name: str, size: int) -> Feistel:
        f = self._made.get((name, size))
        if f is None:
            if len(self._made) > 10_000:
                self._made.clear()
            f = self._made[name, size] = Feistel(self.key, name, size)
        return f

    def _classes(self, name: str, value: str) -> str:
        """Letters and digits permuted together, each staying what it is: lower case, upper case or digit, of its block of Unicode."""
        alphabets = [_alphabet(c) for c in value]
        size = math.prod(map(len, alphabets))
        if size < 2:
            return value
        x = 0
        for c, among in zip(value, alphabets):
            x = x * len(among) + among.index(c)
        x = self._feistel(f"{name}:{''.join(a[0] for a in alphabets)}", size).permute(x)
        out = []
        for among in reversed(alphabets):
            x, r = divmod(x, len(among))
            out.append(among[r])
        return "".join(reversed(out))

    @staticmethod
    def _fill(value: str, characters: str) -> str:
        """value with its letters and digits replaced in order."""
        more = iter(characters)
        return "".join(next(more) if c.isalnum() else c for c in value)

    def email(self, v: str) -> str:
        local, domain = v.rsplit("@", 1)
        names, top = domain.rsplit(".", 1)
        # names are permuted as wholes, so that equal domains stay equal
        # long names are permuted in parts, each under a key made of all that stands before it
        parts, before = [self._classes("local", local[:LOCAL_PART])], hashlib.blake2b(local[:LOCAL_PART].encode("utf-8", "surrogatepass"))
        for k in range(LOCAL_PART, len(local), LOCAL_PART):
            part = local[k : k + LOCAL_PART]
            parts.append(self._classes(f"local:{before.hexdigest()}", part))
            before.update(part.encode("utf-8", "surrogatepass"))
        return f"{''.join(parts)}@{self._classes('domain', names)}.{top}"

    @staticmethod
    def _local(text: str, at: int) -> int:
        """The start of the names before the @ at this place: letters and digits of all scripts with their marks, and _%+-, joined by single dots.
        Where a script without spaces meets another one, the words before an address are no part of it."""
        start, after = at, ""
        while start:
            c = text[start - 1]
            if c == ".":
                if start == at or after == "." or start < 2 or not _in_local(text[start - 2]):
                    break
            elif not _in_local(c) or after and not c.isascii() and _unspaced(c) and not _unspaced(after) and after.isalnum():
                break
            start, after = start - 1, c
        return start

    def _emails(self, text: str) -> Iterator[tuple[int, int]]:
        at = text.find("@")
        while at >= 0:
            domain = self.DOMAIN.match(text, at + 1)
            if domain and (start := self._local(text, at)) < at:
                yield start, domain.end()
            at = text.find("@", at + 1)

    def _ibans(self, text: str) -> Iterator[tuple[int, int, str]]:
        """At each start the end at the country's length, else the last one whose check digits are right."""
        m = self.IBAN.search(text)
        while m:
            ends, at, size = [], m.end(), 4
            while size < 34 and (g := self.IBAN_GROUP.match(text, at)):
                at, size = g.end(), size + len(g[1])
                if 15 <= size <= 34 and not _alnum_at(text, at):
                    ends.append((size, at))
                if len(g[1]) < 4:
                    break
            ends.sort(key=lambda e: (e[0] != _IBAN_LENGTHS.get(m[0][:2]), -e[0]))
            stop = m.end()
            for _, end in ends:
                new = self.iban(text[m.start() : end])
                if new is not None:
                    yield m.start(), end, new
                    stop = end
                    break
            m = self.IBAN.search(text, stop)

    def _cards(self, text: str) -> Iterator[tuple[int, int, str]]:
        """Of each row of digit groups: the whole row, else cards as they are usually written, else other runs of groups from left to right, longest first."""
        for run in self.DIGITS.finditer(text):
            if run.end() - run.start() < 13:
                continue
            groups = [(m.start(), m.end()) for m in re.compile("[0-9]+").finditer(text, run.start(), run.end())]
            if _alnum_at(text, groups[-1][1]):
                groups.pop()
            found = []
            for i in range(len(groups)):
                size = 0
                for j in range(i, len(groups)):
                    size += groups[j][1] - groups[j][0]
                    if size > 19:
                        break
                    if size < 13:
                        continue
                    start, end = groups[i][0], groups[j][1]
                    new = self.card(text[start:end])
                    if new is not None:
                        usual = i == j or tuple(b - a for a, b in groups[i : j + 1]) in _CARD_GROUPS
                        found.append((0 if j - i + 1 == len(groups) else 1 if usual else 2, start, -end, new))
            taken = []
            for _, start, end, new in sorted(found):
                if all(-end <= s or e <= start for s, e in taken):
                    taken.append((start, -end))
                    yield start, -end, new

    def iban(self, v: str) -> str | None:
        flat = v.replace(" ", "")
        if not 15 <= len(flat) <= 34 or iban_check(flat[:2], flat[4:]) != flat[2:4]:
            return None
        account = self._classes("iban", flat[4:])
        return self._fill(v, flat[:2] + iban_check(flat[:2], account) + account)

    def card(self, v: str) -> str | None:
        digits = re.sub("[ -]", "", v)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        # numbers of one digit only are no cards and must not come out either
        f, n = self._feistel("card", 10 ** (len(digits) - 1)), len(digits) - 1
        whole = lambda x: (lambda p: p + luhn_digit(p))(f"{x:0{n}d}")
        return self._fill(v, whole(f.permute(int(digits[:-1]), lambda x: len(set(whole(x))) > 1)))

    def phone(self, v: str) -> str | None:
        """Area code, exchange and the rest as one number; codes that begin with 0 or 1 stay such codes, and others others."""
        digits = re.sub("[^0-9]", "", v)
        n = digits[-10:]
        (first, a), (second, b) = [(0, 200) if code < "200" else (200, 800) for code in (n[:3], n[3:6])]
        x = ((int(n[:3]) - first) * b + int(n[3:6]) - second) * 10_000 + int(n[6:])
        x = self._feistel({(200, 200): "phone", (0, 200): "phone-area", (200, 0): "phone-exchange", (0, 0): "phone-both"}[first, second], a * b * 10_000).permute(x)
        x, rest = divmod(x, 10_000)
        return self._fill(v, f"{digits[:-10]}{x // b + first:03d}{x % b + second:03d}{rest:04d}")

    def e164(self, v: str) -> str | None:
        """Numbers with a country code, however they are grouped; one of the North American plan is the same value as without the code."""
        digits = re.sub("[^0-9]", "", v)
        if not 8 <= len(digits) <= 15:
            return None
        if re.fullmatch("1[0-9]{10}", digits):
            return self.phone(v)
        n = len(digits) - 1
        return self._fill(v, f"{digits[0]}{self._feistel('e164', 10**n).permute(int(digits[1:])):0{n}d}")

    def ssn(self, v: str) -> str | None:
        area, group, serial = map(int, v.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x = self._feistel("ssn", 898 * 99 * 9999).permute(x)
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        area += 1 + (area >= 665)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def ipv4(self, v: str) -> str | None:
        parts = v.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        x = self._feistel("ipv4", 1 << 32).permute(int.from_bytes(bytes(map(int, parts)), "big"))
        return ".".join(map(str, x.to_bytes(4, "big")))

    def date(self, v: str) -> str | None:
        """The day is permuted, whatever its layout, so that one day stays one in all of them; days from 1900 to 2099 stay such days.  Month first is only read where day first can't be;
        for that, days after the twelfth stay such days, and others others."""
        sep = v[4] if v[4] == "-" else "/" if "/" in v else "."
        fields = v.split(sep)
        for order in ("ymd",) if sep == "-" else ("dmy", "mdy"):
            part = dict(zip(order, map(int, fields)))
            try:
                day = datetime.date(part["y"], part["m"], part["d"])
            except ValueError:
                continue
            x = day.toordinal() - _FIRST_DAY
            if 0 <= x < _DAYS:
                name, size, of = "date", _DAYS, lambda x: datetime.date.fromordinal(x + _FIRST_DAY)
            else:  # days of all other years are a class of their own
                x = x + _FIRST_DAY - 1 - (_DAYS if x > 0 else 0)
                name, size, of = "date-far", datetime.date.max.toordinal() - _DAYS, lambda x: datetime.date.fromordinal(x + 1 + (_DAYS if x + 1 >= _FIRST_DAY else 0))
            new = of(self._feistel(name, size).permute(x, lambda x: (of(x).day > 12) == (day.day > 12)))
            wide = 2 if sep == "-" or len(fields[0]) == len(fields[1]) == 2 else 1
            text = {"y": f"{new.year:04d}", "m": f"{new.month:0{wide}d}", "d": f"{new.day:0{wide}d}"}
            return sep.join(text[c] for c in order)
        return None

    def spans(self, text: str | None) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of the validated values, not overlapping."""
        if not text or not ("@" in text or re.search("[0-9]", text)):
            return []
        found = [(start, -1, end, "email", self.email(text[start:end])) for start, end in self._emails(text)]
        found += [(start, 0, end, "iban", new) for start, end, new in self._ibans(text)]
        found += [(start, 1, end, "card", new) for start, end, new in self._cards(text)]
        for rank, (kind, pattern) in enumerate(self.PATTERNS.items(), 2):
            for m in pattern.finditer(text):
                new = getattr(self, kind)(m[0])
                if new is not None:
                    found.append((m.start(), rank, m.end(), kind, new))
        out, end = [], 0
        for start, _, stop, kind, new in sorted(found):
            if start >= end:
                out.append((start, stop, kind, new))
                end = stop
        return out

    def replaced(self, text: str | None) -> tuple[str | None, list[tuple[int, int, str, str]]]:
        spans = self.spans(text)
        if not spans:
            return text, spans
        out, at = [], 0
        for start, end, _, new in spans:
            out += [text[at:start], new]
            at = end
        return "".join([*out, text[at:]]), spans


ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPANS = "array<struct<kind:string,start:long,end:long>>"


def pseudonymized(docs: DataFrame, key: bytes, text: str = "text", spans: str | None = None) -> DataFrame:
    """docs with personal data in the text column replaced; all other columns pass through.

    spans names a column to add with the kinds and places of the values in the original text (code points, exclusive ends).
    Null stays null; an empty table gives an empty result; rows are independent of each other.  A column of the name of spans is an error.
    """
    from pyspark.sql import types as T

    if spans and spans.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {spans} already")
    fields = list(docs.schema.fields) + ([T.StructField(spans, T._parse_datatype_string(SPANS))] if spans else [])

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonyms(key)
        for batch in batches:
            both = [p.replaced(t) for t in batch.column(text).to_pylist()]
            columns = [pa.array([b[0] for b in both], pa.string()) if name == text else batch.column(name) for name in batch.schema.names]
            names = list(batch.schema.names)
            if spans:
                columns.append(pa.array([[{"kind": k, "start": s, "end": e} for s, e, k, _ in b[1]] for b in both], ARROW_SPANS))
                names.append(spans)
            yield pa.RecordBatch.from_arrays(columns, names)

    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    return docs.mapInArrow(lean(replace), nullable)
