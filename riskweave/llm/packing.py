"""Bulk-synchronous best-fit packing of tokenized documents into sequences of fixed capacity.

Documents longer than the capacity are cut into full pieces, each a sequence of its own, and a last piece.  Pieces over half the
capacity never share with one another: each opens a sequence.  Then, in rounds,

* every open sequence's gap offers slots: one as long as the longest waiting piece asks for most of it, else as many as such pieces fit;
* waiting pieces and slots are range-sorted together, from the longest down, and each partition is swept: a slot goes on a stack, a piece
  takes the top of it, which is its successor, the smallest free slot that holds it.  Of the pieces that meet one slot the first by rank
  wins, and the others go on to the next larger one;
* what a partition can't match inside is a number of pieces, which come first, and of slots, which come last.  From these two numbers a
  partition, the sweep is carried on across partitions: pieces take the slots that earlier partitions left, the last ones first;
* the gaps of the sequences that took pieces shrink, and the longest waiting pieces open new sequences, not more than the waiting tokens
  need at least beyond the room that is left;

and the rounds go on until no piece waits.  Only the numbers of the partitions come to the driver.  Each round is a written table, and a range
partition splits equal lengths too, so that no length and no gap is hot.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import Tables, lean, written

CAPACITY = 2048
#: New sequences are opened for this share of the tokens that wait: less makes for more rounds and better fits.
OPEN_FOR = 0.8
CACHE_WORDS = 600_000


#: Letters whose lower case is one letter of the same kind wherever they stand, then characters that are neither letters, digits nor space.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([^\w\s]*)")


#: A byte-level vocabulary writes printable bytes as they are and numbers the others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARACTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def _marked(tail: str) -> bool:
    """Whether a combining mark is there, which the tokenizer's NFC may join to the letter before it."""
    return not tail.isascii() and any(unicodedata.category(c)[0] == "M" for c in tail)


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Ids of whole texts, packed as little-endian unsigned 32-bit numbers, by way of a cache of words.

    The tokenizer drops white space and never joins across it, so words are encoded apart.  A run of plain letters is one piece to
    the tokenizer, so that its model can be asked directly; what follows it without letters, digits, combining marks or spaces is
    encoded apart from it.  All other words are encoded as they are.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.tokenizer, self.limit = _tokenizer(path), cache_words
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size() + 1)]
        self.words: dict[str, bytes] = {"": b""}
        self.runs: dict[str, bytes] = {}
        self.tokenize = self.tokenizer.model.tokenize
        # the model sees bytes as characters; if it doesn't agree with the tokenizer, that one is asked for every run
        self.direct = all(self._run(w) == self._one(w) for w in ("a", "word", "straße", "éàñü"))

    def _one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _run(self, run: str) -> bytes:
        if not run.isascii():
            run = run.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
        return b"".join([self.packed[t.id] for t in self.tokenize(run)])

    def _learn_runs(self, runs: list[str]) -> None:
        one = self._run if self.direct else self._one
        self.runs.update((run, one(run)) for run in runs)

    def _learn(self, words: list[str]) -> None:
        if len(self.words) + len(words) > self.limit:
            self.words = {"": b""}
        if len(self.runs) + len(words) > self.limit:
            self.runs = {}
        letters = [w for w in words if w.isascii() and w.isalpha()]
        plain, other = [], []
        for w in set(words).difference(letters):
            if (m := _PLAIN.fullmatch(w)) and not _marked(m[2]):
                plain.append((w, m[1].lower(), m[2]))
            else:
                other.append(w)
        lower = [w.lower() for w in letters]
        self._learn_runs(list(set(lower).union(run for _, run, _ in plain).difference(self.runs)))
        self.words.update(zip(letters, map(self.runs.__getitem__, lower)))
        for w, run, tail in plain:
            if tail and tail not in self.runs:
                self.runs[tail] = self._one(tail)
            self.words[w] = self.runs[run] + self.runs[tail] if tail else self.runs[run]
        for w in other:
            self.words[w] = self._one(w)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty.  Words are looked up once each, and their ids are gathered by number."""
        if not texts:
            return []
        split = pc.split_pattern(pa.array([(t or "").replace("\n", " ") for t in texts], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        asked, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        packed = list(map(self.words.get, asked))
        missing = [i for i, x in enumerate(packed) if x is None]
        if missing:
            whole = len(self.words) + len(missing) > self.limit
            self._learn(asked if whole else [asked[i] for i in missing])
            for i in range(len(asked)) if whole else missing:
                packed[i] = self.words[asked[i]]
        ids, many = np.frombuffer(b"".join(packed), "<u4"), np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        first, length = (np.cumsum(many) - many)[at], many[at]
        end = np.cumsum(length)
        out = ids[np.repeat(first - end + length, length) + np.arange(end[-1])]
        cuts = np.concatenate([[0], end])[split.offsets.to_numpy()]
        return [out[a:b].tobytes() for a, b in itertools.pairwise(cuts.tolist())]


def _groups(texts: list[str | None], characters: int = 3_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """Texts in groups of about so many characters, with the number of the first, so that few words are held at once."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= characters:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """docs(doc, text): a row a piece: doc, piece, start, length, ids_crc32.  Each document ends with end_id; null counts as empty."""
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds(path)  # with a cache for this task
        for batch in batches:
            rows, starts, lengths, sums = [], [], [], []
            for first, texts in _groups(batch.column("text").to_pylist()):
                for row, ids in enumerate(encoder.encode(texts), first):
                    ids += end
                    for k in range(0, len(ids), width):
                        x = ids[k : k + width]
                        rows.append(row)
                        starts.append(k // 4)
                        lengths.append(len(x) // 4)
                        sums.append(zlib.crc32(x))
            start = np.array(starts, np.int64)
            columns = [batch.column("doc").take(pa.array(rows, pa.int64())), pa.array((start // capacity).astype(np.int32)), pa.array(start), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(lean(pieces, 2000), "doc long, piece int, start long, length long, ids_crc32 long")


Link = tuple[int, int, int, int, int]


def swept(rows: Iterator[tuple[int, bool]]) -> Iterator[tuple[int, int]]:
    """rows(number, slot?) from the largest value down, slots before pieces of the same value: (piece, slot) for each piece that finds a slot
    among the rows, (piece, -1) for the others, and then (-1, slot) for the slots that are left."""
    free: list[int] = []
    for number, slot in rows:
        if slot:
            free.append(number)
        else:
            yield number, free.pop() if free else -1
    yield from ((-1, number) for number in free)


def across(parts: list[tuple[int, int, int]]) -> list[Link]:
    """parts(part, pieces, slots) that are left, in order: links (part, first piece, many, other part, slot): its pieces from the first on take
    that slot of an earlier part and those before it, one each."""
    out, free = [], []
    for part, pieces, slots in parts:
        first = 0
        while first < pieces and free:
            other, held = free.pop()
            many = min(held, pieces - first)
            out.append((part, first, many, other, held - 1))
            first += many
            if many < held:
                free.append((other, held - many))
        if slots:
            free.append((part, slots))
    return out


def opening(parts: list[tuple[int, int, int]], need: int) -> list[tuple[int, int, int]]:
    """parts(part, first piece still waiting, pieces): (part, first, end) of the `need` longest of them, which open sequences."""
    out = []
    for part, first, pieces in parts:
        many = min(need, pieces - first)
        need -= many
        out.append((part, first, first + many))
    return out


def needed(tokens: int, pieces: int, room: int, placed: bool, capacity: int) -> int:
    """How many sequences so many waiting pieces with so many tokens open, where so much room is left; one at least where none was placed."""
    return max(0 if placed else 1, min(pieces, math.ceil((OPEN_FOR * tokens - room) / capacity)))


SWEPT = "part long, what string, rid long, length long, seq long, slot long, place long"


def _sweep(rows: DataFrame) -> DataFrame:
    """rows(value, slot, id, k), dealt and sorted: matched pieces (what = m), pieces (d) and slots (s) that are left, with their place among them."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, places = TaskContext.get().partitionId(), {"m": 0, "d": 0, "s": 0}
        seen: dict[int, tuple[int, int, int]] = {}  # pieces in question and free slots
        numbers = itertools.count()

        def read() -> Iterator[tuple[int, bool]]:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    n = next(numbers)
                    seen[n] = row[0], row[2], row[3]
                    yield n, row[1]

        def found() -> Iterator[tuple]:
            for piece, slot in swept(read()):
                what = "s" if piece < 0 else "d" if slot < 0 else "m"
                length, rid, _ = seen.pop(piece) if piece >= 0 else (None, None, None)
                _, seq, k = seen.pop(slot) if slot >= 0 else (None, None, None)
                yield part, what, rid, length, seq, k, places[what]
                places[what] += 1

        types = [pa.int64(), pa.string(), *[pa.int64()] * 5]
        rows_found = found()
        while chunk := list(itertools.islice(rows_found, 20_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunk), types)], [c.split()[0] for c in SWEPT.split(", ")])

    return rows.mapInArrow(sweep, SWEPT)


def best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces(rid, length), rid a key of the row: rid, sequence_id (the rid of the sequence's first piece), offset.  An empty table gives an empty result."""
    spark, made = pieces.sparkSession, Tables(pieces.sparkSession)
    if pieces.where(f"length < 1 or length > {capacity}").limit(1).count():
        raise ValueError("lengths must be from 1 to the capacity")
    alone = pieces.where(2 * F.col("length") > capacity)
    gaps = made.write(alone.where(F.col("length") < capacity).select(F.col("rid").alias("seq"), F.col("length").alias("used")), "pack-gaps-0")
    zero = F.lit(0).cast("long")
    placed = alone.select("rid", F.col("rid").alias("sequence_id"), zero.alias("offset"))
    waiting = made.write(pieces.where(2 * F.col("length") <= capacity), "pack-waiting")
    many, shortest, longest = waiting.agg(F.count("*"), F.min("length"), F.max("length")).first()
    turn = 0
    while many:
        turn += 1
        # 1. pieces and slots in one order, swept
        open_ = gaps.withColumn("gap", capacity - F.col("used")).where(F.col("gap") >= shortest).withColumn("slots", F.greatest(F.lit(1), F.floor(F.col("gap") / longest)).cast("int"))
        slots = open_.select(F.floor(F.col("gap") / F.col("slots")).cast("long").alias("value"), F.lit(True).alias("slot"), F.col("seq").alias("id"), F.explode(F.sequence(zero, (F.col("slots") - 1).cast("long"))).alias("k"))
        rows = slots.unionByName(waiting.select(F.col("length").alias("value"), F.lit(False).alias("slot"), F.col("rid").alias("id"), zero.alias("k")))
        order = F.col("value").desc(), F.col("slot").desc(), F.col("id"), F.col("k")
        found = made.write(_sweep(rows.repartitionByRange(*order).sortWithinPartitions(*order)), f"pack-swept-{turn}")
        # 2. the same sweep across partitions: three rows a partition
        counted = {(r["part"], r["what"]): r for r in found.groupBy("part", "what").agg(F.count("*").alias("n"), F.min("length").alias("low"), F.max("length").alias("high"), F.sum("length").alias("tokens")).collect()}
        parts, left = sorted({p for p, _ in counted}), {k: r["n"] for k, r in counted.items()}
        links = across([(p, left.get((p, "d"), 0), left.get((p, "s"), 0)) for p in parts])
        first = dict.fromkeys(parts, 0)
        for p, j, n, _, _ in links:
            first[p] = j + n
        link = spark.createDataFrame(links, "part long, first long, many long, other long, last long")
        pieces_left, slots_left = found.where("what = 'd'"), found.where("what = 's'").select(F.col("part").alias("other"), F.col("place").alias("at"), "seq", "slot")
        meets = pieces_left.select("part", "place", "rid", "length").join(F.broadcast(link), "part").where("place >= first and place < first + many")
        taken = meets.withColumn("at", F.col("last") - (F.col("place") - F.col("first"))).join(slots_left, ["other", "at"]).select("rid", "length", "seq", "slot")
        taken = taken.unionByName(found.where("what = 'm'").select("rid", "length", "seq", "slot"))
        # 3. gaps shrink
        before = F.coalesce(F.sum("length").over(Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), zero)
        inside = taken.withColumn("before", before).withColumn("more", F.sum("length").over(Window.partitionBy("seq")))
        now = gaps.join(inside, "seq", "left")
        rest = sum(left.get((p, "d"), 0) - first[p] for p in parts)
        shortest = min([counted[p, "d"]["low"] for p in parts if left.get((p, "d"), 0) > first[p]], default=capacity)
        news = F.array(F.struct(F.lit(True).alias("piece"), "rid", (F.col("used") + F.col("before")).alias("at")), F.when(F.coalesce("before", zero) == 0, F.struct(F.lit(False).alias("piece"), F.lit(None).cast("long").alias("rid"), (F.col("used") + F.coalesce("more", zero)).alias("at"))))
        # what was put where, and what room is left for the pieces that wait on, is summed while the table is written: no further job a round
        sums, gap = Observation(), F.when(~F.col("piece"), capacity - F.col("at"))
        filled = F.sum(F.when(F.col("piece"), F.col("length"))).alias("filled"), F.sum(F.when(gap >= shortest, gap)).alias("room")
        state = now.select("seq", "length", F.explode(news).alias("x")).where("x is not null and (x.rid is not null or not x.piece)").select("seq", "length", "x.*")
        state = made.write(state.observe(sums, *filled).drop("length"), f"pack-state-{turn}")
        gaps = state.where(f"not piece and at < {capacity}").select("seq", F.col("at").alias("used"))
        placed = placed.unionByName(state.where("piece").select("rid", F.col("seq").alias("sequence_id"), F.col("at").alias("offset")))
        # 4. the pieces that wait on, and those that open sequences
        if not rest:
            break
        tokens = sum(r["tokens"] or 0 for r in counted.values()) - (sums.get["filled"] or 0)
        need = needed(tokens, rest, sums.get["room"] or 0, rest < many, capacity)
        cut = opening([(p, first[p], left.get((p, "d"), 0)) for p in parts], need)
        cuts = spark.createDataFrame(cut, "part long, first long, end long")
        tail = pieces_left.select("part", "place", "rid", "length").join(F.broadcast(cuts), "part")
        waiting = tail.where("place >= end").select("rid", "length")
        if need:
            opened = tail.where("place >= first and place < end").select(F.col("rid").alias("seq"), F.col("length").alias("used"))
            gaps = gaps.unionByName(opened)
            placed = placed.unionByName(opened.select(F.col("seq").alias("rid"), F.col("seq").alias("sequence_id"), zero.alias("offset")))
        many = rest - need
        longest = max([counted[p, "d"]["high"] for p, _, end in cut if left.get((p, "d"), 0) > end], default=0)
    return placed


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """docs(doc long, text): doc, piece, start, length, ids_crc32, sequence_id, offset for every piece.

    Null, empty and repeated rows are documents like others; an empty table gives an empty result.
    """
    cut = tokenized(docs.select(F.col("doc").cast("long").alias("doc"), "text"), path, capacity, end_id)
    pieces = written(cut.withColumn("rid", F.monotonically_increasing_id()), "pack-pieces")
    return pieces.join(best_fit(pieces.select("rid", "length"), capacity), "rid").drop("rid")
