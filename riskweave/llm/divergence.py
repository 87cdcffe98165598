"""Source divergence audit: how far each source's words are from those of the other sources and of the whole language.

1. **Terms** are read from bytes.  Texts come as one buffer of UTF-8; a numpy table of 256 entries says which bytes belong to terms (letters
   A to Z, lower-cased, and all bytes from 128 on), so that boundaries are where that changes and where texts begin.  Slices are grouped by
   xxhash; every slice is compared byte by byte with the first of its group, and slices that collide are told apart by their bytes.
   Documents x terms are a sparse matrix (CSR); its rows are summed into one for each language and source.
2. **Counts** are summed by Spark, with a partial sum in each task, so a very common term or source is a row a task.  A language keeps the
   terms of at least `min_docs` of its documents.
3. **Divergences** are made in blocks of terms.  A block has all sources of its terms as CSR rows; divisions go over the stored counts only,
   those of absent terms being one number a pair of sources, and reduceat sums them by source.  Blocks are added up exactly.

All arithmetic is on integers.  With n the count of a term in a group and N the sum over the V kept terms, p = 1 + floor(SCALE * (n + 1) / (N + V)),
and the divergence of a term is floor((p - q)^2 / q).

Null text, lang and source are empty strings; a document without terms makes its group occur; ties go by the bytes of the item; repeated rows
are documents of their own; an empty table gives an empty result; other columns aren't read.  A text of any length is read in windows that end
between terms.  Counts may grow to 9 * 10^15 a group.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, lean

SCALE_THOUSANDS = 3
MIN_DOCS = 3
TOP_TERMS = 200
#: Bytes of text that are taken together, and (terms x sources) of a block of terms.
PART_BYTES = 1 << 23
BLOCK_CELLS = 1 << 17
#: Languages up to this number are broadcast (a few numbers each); more are joined by sorting.
FEW_LANGS = 50_000

_IN_TERM = np.zeros(256, bool)
_IN_TERM[ord("A") : ord("Z") + 1] = _IN_TERM[ord("a") : ord("z") + 1] = _IN_TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms in the buffer; text k is data[offsets[k]:offsets[k + 1]]."""
    on = _IN_TERM[data]
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1]
    last[:-1] &= ~on[1:]
    filled = offsets[:-1] < offsets[1:]
    begin, end = offsets[:-1][filled], offsets[1:][filled] - 1
    first[begin], last[end] = on[begin], on[end]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest: Callable[[memoryview], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """For each slice its group, and for each group its first slice; slices share a group if and only if their bytes are equal."""
    view, n = memoryview(data), len(starts)
    hashes = np.fromiter((digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, n)
    _, heads, group = np.unique(hashes, return_index=True, return_inverse=True)
    lengths, own = ends - starts, heads[group]
    same = lengths == lengths[own]
    bounds = np.cumsum(lengths) - lengths
    place = np.repeat(starts - bounds, lengths) + np.arange(lengths.sum())
    equal = data[place] == data[place + np.repeat(np.where(same, starts[own] - starts, 0), lengths)]
    same &= np.logical_and.reduceat(equal, bounds) if n else same
    if not same.all():  # collisions
        known: dict[tuple[int, bytes], int] = {}
        more = list(heads)
        for k in np.flatnonzero(~same).tolist():
            key = (int(group[k]), bytes(view[starts[k] : ends[k]]))
            if key not in known:
                known[key] = len(more)
                more.append(k)
            group[k] = known[key]
        heads = np.array(more)
    return group, heads


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The slices as an Arrow array of strings."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    place = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[place]))


def term_counts(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of texts with group numbers: (group, term, count, texts that have it), a row for each group and term."""
    data = _LOWER[data]
    starts, ends = slices(data, offsets)
    term, heads = grouped(data, starts, ends)
    terms = _strings(data, starts[heads], ends[heads])
    text = np.searchsorted(offsets, starts, "right") - 1
    cells, counts = np.unique(text * max(1, len(heads)) + term, return_counts=True)  # CSR: by text, then term
    text, term = np.divmod(cells, max(1, len(heads)))
    order = np.lexsort((term, group[text]))
    rows, cols, counts = group[text][order], term[order], counts[order]
    if not len(rows):
        return rows, terms, counts, counts
    at = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (cols[1:] != cols[:-1])])
    return rows[at], terms.take(pa.array(cols[at])), np.add.reduceat(counts, at), np.diff(np.r_[at, len(rows)])


def _windows(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """data in windows of about size bytes that end between terms."""
    begin = 0
    while begin < len(data):
        end = begin + size
        while end < len(data) and _IN_TERM[data[end]] and _IN_TERM[data[end - 1]]:
            off = np.flatnonzero(~_IN_TERM[data[end : end + size]])
            end += int(off[0]) if len(off) else size
        yield data[begin:end]
        begin = end


def _long_text(data: np.ndarray, size: int) -> tuple[pa.Array, np.ndarray]:
    """Terms and counts of one text that is read in windows."""
    found: dict[str, int] = {}
    for part in _windows(data, size):
        _, terms, counts, _ = term_counts(part, np.array([0, len(part)]), np.zeros(1, np.int64))
        for term, n in zip(terms.to_pylist(), counts.tolist(), strict=True):
            found[term] = found.get(term, 0) + n
    return pa.array(list(found), pa.large_string()), np.array(list(found.values()), np.int64)


def _counted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def made(names: list[tuple[str, str]], group: np.ndarray, terms: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        of = lambda k: pa.array([x[k] for x in names], pa.string()).take(pa.array(group))
        return pa.record_batch([of(0), of(1), terms.cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=schema)

    for batch in batches:
        text = batch.column(2).cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        names: dict[tuple[str, str], int] = {}
        group = np.array([names.setdefault(x, len(names)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
        begin = 0
        while begin < len(text):
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1)
            part = data[offsets[begin] : offsets[end]]
            if len(part) > size:  # one long text
                terms, n = _long_text(part, size)
                yield made(list(names), np.full(len(n), group[begin]), terms, n, np.ones(len(n), np.int64))
            else:
                yield made(list(names), *term_counts(part, offsets[begin : end + 1] - offsets[begin], group[begin:end]))
            begin = end


def scaled(n: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(10^9 * (n + 1) / (total + kept)), by three steps of long division, so that nothing overflows."""
    whole = np.broadcast_to(np.asarray(total, np.int64) + kept, np.shape(n))
    out, rest = np.zeros(np.shape(n), np.int64), np.asarray(n, np.int64) + 1
    lead, rest = np.divmod(rest, whole)
    out = lead
    for _ in range(SCALE_THOUSANDS):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def pair_sums(source: np.ndarray, term: np.ndarray, n: np.ndarray, totals: np.ndarray, kept: int, terms: int, cells: int = BLOCK_CELLS) -> np.ndarray:
    """Sources x sources: the divergences of the first from the second, summed over a block of terms.

    (source, term, n) are the stored counts, sorted by source and term: CSR rows.  With z the first's p of an absent term, a sum over all terms is
    that of f(p, q) - f(z, q) over the first's stored terms, of f(z, q) over the second's, and f(z, z') for each term the second lacks."""
    count = len(totals)
    p = scaled(n, totals[source], kept)
    absent = scaled(np.zeros(count, np.int64), totals, kept)
    dense = np.repeat(absent[None, :], terms, 0)
    dense[term, source] = p
    out = divergence(absent[:, None], absent[None, :]) * (terms - np.bincount(source, minlength=count))[None, :]
    step = max(1, cells // count)
    for a in range(0, len(source), step):
        s, own, q = source[a : a + step], p[a : a + step, None], dense[term[a : a + step]]
        rows = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        out[s[rows]] += np.add.reduceat(divergence(own, q) - divergence(absent[s][:, None], q), rows, axis=0)
        out[:, s[rows]] += np.add.reduceat(divergence(absent[None, :], own), rows, axis=0).T
    return out


def top_terms(source: np.ndarray, term: np.ndarray, n: np.ndarray, totals: np.ndarray, kept: int, order: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the stored counts that are among their source's `top` of this block, with their divergences from the whole language."""
    whole = np.zeros(len(order), np.int64)
    np.add.at(whole, term, n)
    p, q = scaled(n, totals[source], kept), scaled(whole, totals.sum(), kept)[term]
    over = np.flatnonzero(p > q)
    value = divergence(p[over], q[over])
    by = np.lexsort((order[term[over]], -value, source[over]))
    over, value = over[by], value[by]
    firsts = np.flatnonzero(np.r_[True, source[over][1:] != source[over][:-1]]) if len(over) else np.zeros(0, np.int64)
    rank = np.arange(len(over)) - np.repeat(firsts, np.diff(np.r_[firsts, len(over)]))
    return over[rank < top], value[rank < top]


_FOUND = "lang string, source string, part string, item string, value long"


def _block(terms: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """The sums of all pairs of sources, and the first terms of each source, in one block of a language's terms."""
    lang, kept = groups["lang"][0].as_py(), groups["kept"][0].as_py()
    groups = groups.sort_by("source")
    names, totals = groups["source"].combine_chunks(), groups["total"].to_numpy().astype(np.int64)
    held = terms["held"].combine_chunks() if len(terms) else pa.array([], pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))
    items = terms["term"].combine_chunks() if len(terms) else pa.array([], pa.string())
    flat = held.flatten()
    term = np.repeat(np.arange(len(items)), pc.list_value_length(held).to_numpy(zero_copy_only=False)) if len(items) else np.zeros(0, np.int64)
    source = pc.index_in(flat.field("source"), names.cast(flat.field("source").type)).to_numpy(zero_copy_only=False).astype(np.int64)
    n = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
    by = np.lexsort((term, source))
    source, term, n = source[by], term[by], n[by]
    sums = pair_sums(source, term, n, totals, kept, len(items))
    one, other = np.nonzero(~np.eye(len(names), dtype=bool))
    order = np.empty(len(items), np.int64)
    order[pc.sort_indices(items.cast(pa.binary())).to_numpy()] = np.arange(len(items))
    first, value = top_terms(source, term, n, totals, kept, order, top)
    strings = lambda x, k: x.take(pa.array(k)).cast(pa.string())
    rows = len(one) + len(first)
    return pa.table(
        {
            "lang": pa.array([lang] * rows, pa.string()),
            "source": pa.concat_arrays([strings(names, one), strings(names, source[first])]),
            "part": pa.array(["pair"] * len(one) + ["term"] * len(first), pa.string()),
            "item": pa.concat_arrays([strings(names, other), strings(items, term[first])]),
            "value": pa.array(np.r_[sums[one, other], value], pa.int64()),
        }
    )


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, part_bytes: int = PART_BYTES, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """docs(text, lang, source): lang, source, part, item, value long, rank int.

    Part `pair` has all other sources of the language as items, part `term` the `top` terms that a source has more of than its language."""
    made = Tables(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = rows.mapInArrow(lean(functools.partial(_counted, size=part_bytes), 20_000), "lang string, source string, term string, n long, docs long")
    counts = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    held = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("held"))
    kept = made.write(held.where(F.col("docs") >= min_docs).select("lang", "term", "held"), "divergence-terms")  # a list holds a count a source
    # sums of each group, and of each language the kept terms and the blocks they are dealt in
    sums = kept.select("lang", F.inline("held")).groupBy("lang", "source").agg(F.sum("n").alias("_n"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("_n", F.lit(0)).alias("total"))
    groups = made.write(groups, "divergence-groups")
    sizes = groups.groupBy("lang").agg(F.count("*").alias("_sources")).join(kept.groupBy("lang").agg(F.count("*").alias("_kept")), "lang", "left")
    blocks = F.greatest(F.ceil(F.col("_sources") * F.col("kept") / block_cells), F.lit(1)).cast("int")
    langs = made.write(sizes.withColumn("kept", F.coalesce("_kept", F.lit(0))).select("lang", "kept", blocks.alias("blocks")), "divergence-langs")
    small = F.broadcast(langs) if langs.limit(FEW_LANGS + 1).count() <= FEW_LANGS else langs
    dealt = kept.join(small.drop("kept"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks").cast("int")).select("lang", "block", "term", "held")
    sides = groups.join(small, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("lang", "block", "source", "total", "kept")
    parts = made.write(dealt.groupBy("lang", "block").cogroup(sides.groupBy("lang", "block")).applyInArrow(lambda a, b: _block(a, b, top), _FOUND), "divergence-parts")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    first = parts.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(first)
