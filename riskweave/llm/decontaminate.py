"""Benchmark decontamination with a document-partitioned positional inverted index.

Building: each task turns its documents into index blocks, a block holding for every training token the places where it occurs
(CSR: terms, list starts, word positions in the block).  Terms are 64-bit hashes of words, so that the index knows nothing of any
test set: it is stored once in the shared folder and answers for all of them.  Documents are never split over blocks, so a frequent term
only lengthens its list inside each bounded block and no posting is shuffled.  A block holds about block_words words or one longer document.

Querying: the corpus frequency of each test term is summed over all blocks.  Each window of a test item is kept under its rarest term, and a
block looks only at the windows whose rarest term it holds: the lists are intersected from that one on, each shifted back by the term's
offset in the window, until nothing is left or all terms agree: an exact phrase.  Proximity matches ask that the rarest occurring terms of
an item stand within a span, in any order.

Test items are taken in blocks of at most item_words words; each such block is a pass over the index, so that what is sent to the
tasks stays bounded however large the test set is.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, written

WINDOW = 13
BLOCK_WORDS = 200_000
ITEM_WORDS = 1_000_000
CACHE_WORDS = 150_000
#: Upper-case ASCII is lowered, other ASCII than digits and letters becomes a space, the bytes of other characters stay.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
INDEX_SCHEMA = "doc_ids array<long>, doc_starts binary, n_words long, terms binary, list_starts binary, places binary"
INDEX_ARROW = pa.schema(
    [("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.binary()), ("n_words", pa.int64()), ("terms", pa.binary()), ("list_starts", pa.binary()), ("places", pa.binary())]
)


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lowered; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


def term_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


class _Terms(dict):
    """word -> its term; cleared when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        t = self[word] = term_of(word)
        return t


class Plan:
    """The windows of a block of test items, as terms."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        self.windows: list[tuple[int, ...]] = []
        self.owners: list[list[int]] = []
        known: dict[tuple[int, ...], int] = {}
        self.items = [i for i, _ in items]
        self.item_terms: list[list[int]] = []
        for at, (_, text) in enumerate(items):
            ids = [term_of(w) for w in words_of(text)]
            self.item_terms.append(sorted(set(ids)))
            if not ids:
                continue
            for k in range(max(1, len(ids) - window + 1)):
                w = tuple(ids[k : k + window])
                j = known.setdefault(w, len(self.windows))
                if j == len(self.windows):
                    self.windows.append(w)
                    self.owners.append([])
                if at not in self.owners[j]:
                    self.owners[j].append(at)
        self.terms = np.array(sorted({t for ts in self.item_terms for t in ts}), np.int64)


def item_blocks(items: DataFrame, item_words: int = ITEM_WORDS, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of bounded size, without ever holding more than one on the driver."""
    block, size = [], 0
    for row in items.select(id_col, text_col).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(words_of(row[1]))
        if size >= item_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def _index_block(docs: list[int | None], terms: list[np.ndarray], wanted: np.ndarray | None) -> dict:
    """docs: ids; terms: those of each document's words; wanted: the only terms to hold, else all."""
    lengths = np.fromiter((len(x) for x in terms), np.int64, len(terms))
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    flat = np.concatenate(terms) if terms else np.empty(0, np.int64)
    places = np.flatnonzero(np.isin(flat, wanted)) if wanted is not None else np.arange(len(flat))
    held = flat[places]
    order = np.argsort(held, kind="stable")
    found, first = np.unique(held[order], return_index=True)
    return {
        "doc_ids": docs,
        "doc_starts": starts.tobytes(),
        "n_words": int(starts[-1]),
        "terms": found.tobytes(),
        "list_starts": np.append(first, len(order)).astype(np.int64).tobytes(),
        "places": places[order].astype(np.int64 if starts[-1] > 2**31 - 1 else np.int32).tobytes(),
    }


def build_index(docs: DataFrame, plan: Plan | None = None, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index blocks over the whole texts of docs(id_col, text_col), written to the shared folder.  Ids are integers or null.

    A plan limits the index to its terms, for a small index that answers for one test set only."""
    wanted = None if plan is None else plan.terms

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, terms, size = _Terms(), [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                terms.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                ids.append(doc)
                size += len(words) + 50
                if size >= block_words:
                    yield pa.RecordBatch.from_pylist([_index_block(ids, terms, wanted)], INDEX_ARROW)
                    ids, terms, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_index_block(ids, terms, wanted)], INDEX_ARROW)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(lean(build), INDEX_SCHEMA), "positional-index")


def term_frequencies(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """Occurrences of each of these sorted terms over all blocks, of those that occur: summed a task, then over tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in _rows(batch):
                _, mine, theirs = np.intersect1d(terms, np.frombuffer(row["terms"], np.int64), assume_unique=True, return_indices=True)
                sums[mine] += np.diff(np.frombuffer(row["list_starts"], np.int64))[theirs]
        some = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(terms[some]), pa.array(sums[some])], ["term", "n"])

    summed = index.select("terms", "list_starts").mapInArrow(lean(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    with small_batches(index.sparkSession):
        return {row["term"]: row["n"] for row in summed.toLocalIterator()}  # at most as many rows as terms


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The index blocks of a batch one by one, so that only one is copied at a time."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


class Block:
    """An index block as read back; row: a mapping of its columns."""

    def __init__(self, row):
        self.docs, self.starts = row["doc_ids"], np.frombuffer(row["doc_starts"], np.int64)
        self.lists = np.frombuffer(row["list_starts"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.int64)
        self.places = np.frombuffer(row["places"], np.int64 if row["n_words"] > 2**31 - 1 else np.int32)

    def postings(self, term: int) -> np.ndarray:
        k = int(np.searchsorted(self.terms, term))
        if k == len(self.terms) or self.terms[k] != term:
            return self.places[:0]
        return self.places[self.lists[k] : self.lists[k + 1]]

    def holds(self, terms: np.ndarray) -> list[int]:
        """Those of sorted terms that occur in the block."""
        return np.intersect1d(terms, self.terms, assume_unique=True).tolist()

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1

    def phrase(self, window: tuple[int, ...], order: list[int]) -> np.ndarray:
        """Starts of the window in the block, inside one document; order: offsets, rarest term first."""
        starts = self.postings(window[order[0]]) - order[0]
        for o in order[1:]:
            if not len(starts):
                return starts
            held = self.postings(window[o])
            if not len(held):
                return held
            at = np.searchsorted(held, starts + o)
            starts = starts[(at < len(held)) & (held[np.minimum(at, len(held) - 1)] == starts + o)]
        starts = starts[starts >= 0]
        return starts[self.doc_of(starts) == self.doc_of(starts + len(window) - 1)] if len(starts) else starts

    def near(self, terms: list[int], span: int) -> np.ndarray:
        """Places of the first, rarest term with all other terms at most span words away in the same document."""
        here = self.postings(terms[0])
        for t in terms[1:]:
            if not len(here):
                return here
            held = self.postings(t)
            if not len(held):
                return held
            doc = self.doc_of(here)
            low = np.maximum(here - span, self.starts[doc])
            high = np.minimum(here + span, self.starts[doc + 1] - 1)
            here = here[np.searchsorted(held, low) < np.searchsorted(held, high, side="right")]
        return here


MATCHES_ARROW = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32())
MATCHES = "doc_id long, n_words long, item_id long, kind string, start long, length int"
VERDICTS = "doc_id long, n_words long, n_hit long, item_ids array<long>, n_near long"


class Search:
    """A plan with the corpus frequencies of its terms: windows and items under their rarest terms."""

    def __init__(self, plan: Plan, counts: dict[int, int], near_terms: int):
        self.plan = plan
        self.orders: list[list[int]] = [[]] * len(plan.windows)
        windows, items = defaultdict(list), defaultdict(list)
        for j, w in enumerate(plan.windows):
            if all(t in counts for t in w):  # others occur nowhere
                self.orders[j] = sorted(range(len(w)), key=lambda o: (counts[w[o]], o))
                windows[w[self.orders[j][0]]].append(j)
        # each item's rarest terms of those that occur at all, rarest first, fewer where it has no more; an item of several terms of which only one
        # occurs has none, as nothing is there to meet
        for i, terms in enumerate(plan.item_terms):
            held = sorted((t for t in terms if t in counts), key=lambda t: (counts[t], t))[:near_terms]
            if len(held) > 1 or len(held) == len(terms) == 1:
                items[held[0]].append((i, held))
        self.windows, self.items = dict(windows), dict(items)
        self.window_terms, self.item_terms = (np.array(sorted(x), np.int64) for x in (windows, items))

    def phrases(self, block: Block) -> Iterator[tuple[int, np.ndarray]]:
        """(window, its starts in the block)."""
        for t in block.holds(self.window_terms):
            for j in self.windows[t]:
                starts = block.phrase(self.plan.windows[j], self.orders[j])
                if len(starts):
                    yield j, starts

    def meetings(self, block: Block, span: int) -> Iterator[tuple[int, np.ndarray]]:
        """(item, the places of its rarest term where the others are near)."""
        for t in block.holds(self.item_terms):
            for i, terms in self.items[t]:
                places = block.near(terms, span)
                if len(places):
                    yield i, places


def matches(index: DataFrame, plan: Plan, near_terms: int = 4, near_span: int = 40) -> DataFrame:
    """Each exact occurrence of a window (kind phrase) and each close meeting of an item's rarest terms (kind near), with word positions."""
    search = Search(plan, term_frequencies(index, plan.terms), near_terms)
    windows, owners, items = plan.windows, plan.owners, plan.items

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                b, out = Block(row), []
                for j, starts in search.phrases(b):
                    for s, d in zip(starts.tolist(), b.doc_of(starts).tolist()):
                        out += [(b.docs[d], int(b.starts[d + 1] - b.starts[d]), items[i], "phrase", int(s - b.starts[d]), len(windows[j])) for i in owners[j]]
                for i, starts in search.meetings(b, near_span):
                    out += [(b.docs[d], int(b.starts[d + 1] - b.starts[d]), items[i], "near", int(s - b.starts[d]), 1) for s, d in zip(starts.tolist(), b.doc_of(starts).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, MATCHES_ARROW)], [c.split()[0] for c in MATCHES.split(", ")])

    return index.mapInArrow(lean(find), MATCHES)


def verdicts(index: DataFrame, plan: Plan, near_terms: int = 4, near_span: int = 40) -> DataFrame:
    """A row a document: its words, the words inside any occurring window, the items with such windows (sorted as strings), and the
    number of items whose rarest terms meet closely (n_near)."""
    search = Search(plan, term_frequencies(index, plan.terms), near_terms)
    windows, owners, items = plan.windows, plan.owners, plan.items

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                b = Block(row)
                edges = np.zeros(int(b.starts[-1]) + 1, np.int32)
                of: dict[int, set[int]] = {}
                near = np.zeros(len(b.docs), np.int64)
                for j, starts in search.phrases(b):
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, starts + len(windows[j]), -1)
                    for d in np.unique(b.doc_of(starts)).tolist():
                        of.setdefault(d, set()).update(items[i] for i in owners[j])
                for _, places in search.meetings(b, near_span):
                    near[np.unique(b.doc_of(places))] += 1
                hit = np.concatenate([[0], np.cumsum(np.cumsum(edges)[:-1] > 0)])
                lengths = np.diff(b.starts)
                columns = [
                    pa.array(b.docs, pa.int64()),
                    pa.array(lengths),
                    pa.array(hit[b.starts[1:]] - hit[b.starts[:-1]]),
                    pa.array([sorted(of.get(d, ()), key=str) for d in range(len(b.docs))], pa.list_(pa.int64())),
                    pa.array(near),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "item_ids", "n_near"])

    return index.mapInArrow(lean(judge), VERDICTS)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, item_words: int = ITEM_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs(doc_id, text) against items(item_id, text): doc_id, n_words, n_hit, item_ids, n_near for every document.

    Null and wordless texts have no words and no hits; without items nothing is hit; rows with one doc_id are judged each.
    With several item blocks the hit words of a document are united over the blocks.
    """
    blocks = item_blocks(items, item_words)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        plan = Plan(first, window)
        return verdicts(build_index(docs, None, block_words), plan)
    # passes are united by a key of the row, as ids may be null or repeated
    keyed = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "contamination-rows")
    index = build_index(keyed, None, block_words, "row")
    return _united(keyed, index, (Plan(block, window) for block in itertools.chain([first, second], blocks)))


def _united(keyed: DataFrame, index: DataFrame, plans: Iterator[Plan]) -> DataFrame:
    """Several item blocks over keyed(row, doc_id, text): words hit by windows of any block count once, so their intervals are merged a row."""
    found = None
    for plan in plans:
        m = written(matches(index, plan).withColumnRenamed("doc_id", "row"), "contamination")
        found = m if found is None else found.unionByName(m)
    spans = found.where("kind = 'phrase'").groupBy("row").agg(
        F.collect_set(F.struct("start", "length")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("item_ids")
    )
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), x["start"] + x["length"] - F.greatest(acc["end"], x["start"]))).alias("n"),
            F.greatest(acc["end"], x["start"] + x["length"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    near = found.where("kind = 'near'").groupBy("row").agg(F.countDistinct("item_id").alias("n_near"))
    base = _lengths(index).join(keyed.select("row", "doc_id"), "row")
    by_text = F.transform(F.array_sort(F.transform("item_ids", lambda i: F.struct(i.cast("string").alias("s"), i.alias("i")))), lambda x: x["i"])
    return (
        base.join(spans.select("row", covered.alias("n_hit"), by_text.alias("item_ids")), "row", "left")
        .join(near, "row", "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
    )


def _lengths(index: DataFrame) -> DataFrame:
    """row, n_words of every document in the index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(np.diff(np.frombuffer(row["doc_starts"], np.int64)))], ["row", "n_words"])

    return index.select("doc_ids", "doc_starts").mapInArrow(lean(read), "row long, n_words long")


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def items_digest(ids: str = "item_ids"):
    return F.sha2(F.array_join(F.transform(ids, lambda i: i.cast("string")), ","), 256)


def digest_of(ids) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
