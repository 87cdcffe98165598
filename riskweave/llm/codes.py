"""Vector codes: product quantization with integer codebooks, each assignment exact.

A component x becomes the integer floor(1024 x); a vector is cut into equal consecutive parts, and the part at each position has a codebook of
its own.  Codebooks start as the vectors with the smallest ids and are improved in rounds: every part goes to its nearest entry, and an entry
becomes the componentwise floor(sum / count) of its parts.

The nearest entry is found by screening.  |c|^2 - 2 x.c, which orders the entries like the squared distance, comes from one float32 matrix
product a batch.  By the error bounds of float arithmetic (n products summed in any order are off by at most n u / (1 - n u) of the sum of
their absolute values, u = 2^-24, and rounding the operands counts as two more) the true value is in a known interval around it.  Every entry whose
interval overlaps that of the best is computed again in int64, and of equal distances the lowest index wins.  So codes are those of
exact arithmetic, whatever order the matrix product sums in.

Each task keeps sums and counts of its parts for a round, which are a row an entry; Spark adds those up.  The driver only holds codebooks:
positions x entries x components, whatever the number of vectors.

A vector goes if it is null or holds a null, NaN, infinity or a component that is so large after scaling that squared distances might not fit into longs (`limit`; 2^27 for 64 components),
or if it has another length than the kept vector with the smallest id.  A length that the parts don't divide is an error.  Null ids come last;
rows that tie on their id go by their vectors; repeated rows count each; with fewer vectors than entries a codebook is as small; an
empty table gives an empty result and empty codebooks.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Vectors that are compared at a time.
CHUNK = 4096
_U = 2.0**-24


@dataclass(frozen=True)
class Codebooks:
    """books[p, k]: entry k at position p, as integers."""

    books: np.ndarray

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and place in the part, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def limit(length: int) -> int:
    """The largest component (absolute, scaled) with which squared distances of vectors of this length fit into longs."""
    return int((2**62 // max(1, length)) ** 0.5) // 2


def integers(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of a column of lists are kept, and these as integers."""
    good = pc.fill_null(pc.equal(pc.list_value_length(column), length), False).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(good)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), length)
    with np.errstate(invalid="ignore", over="ignore"):
        values = np.floor(values * SCALE)
        fine = (np.abs(values) <= limit(length)).all(axis=1)
    return rows[fine], values[fine].astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """For each row of x (integers) the first of the nearest rows of book."""
    n = x.shape[1] + 2
    c32 = book.astype(np.float32)
    squares = (book * book).sum(axis=1)
    score = squares.astype(np.float32)[None, :] - 2 * (x.astype(np.float32) @ c32.T)
    # the largest error of a score in its row, in float64 and a little more than the bound
    far, own = np.sqrt(squares.max().astype(np.float64)), np.sqrt((x * x).sum(axis=1).astype(np.float64))
    gamma = n * _U / (1 - n * _U)
    error = ((2 * gamma + 4 * _U) * own * far + 4 * _U * far * far) * 1.001 + 1e-30
    reach = score.min(axis=1).astype(np.float64) + 2 * error
    close = score.astype(np.float64) <= reach[:, None]
    out = close.argmax(axis=1)
    open_ = np.flatnonzero(close.sum(axis=1) > 1)
    if len(open_):
        row, entry = np.nonzero(close[open_])
        exact = ((x[open_][row] - book[entry]) ** 2).sum(axis=1)
        begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        best = np.minimum.reduceat(exact, begins)
        out[open_] = np.minimum.reduceat(np.where(exact == best[row], entry, len(book)), begins)
    return out


def assigned(values: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Vectors x positions: the entry of each part."""
    width = books.shape[2]
    out = np.empty((len(values), len(books)), np.int64)
    for a in range(0, len(values), CHUNK):
        for p, book in enumerate(books):
            out[a : a + CHUNK, p] = nearest(values[a : a + CHUNK, p * width : (p + 1) * width], book)
    return out


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each used entry: its position and index, the number of its parts and their sums."""
    parts, entries, width = books.shape
    count, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
    for batch in batches:
        _, values = integers(batch.column(0), parts * width)
        codes = assigned(values, books)
        for p in range(parts):
            order = np.argsort(codes[:, p], kind="stable")
            used, begins, n = np.unique(codes[order, p], return_index=True, return_counts=True)
            count[p, used] += n
            if len(used):
                total[p, used] += np.add.reduceat(values[order, p * width : (p + 1) * width], begins, axis=0)
    p, k = np.nonzero(count)
    yield pa.record_batch([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(count[p, k]), *[pa.array(total[p, k, j]) for j in range(width)]], ["part", "entry", "n", *[f"s{j}" for j in range(width)]])


def trained(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """The codebooks of all kept vectors."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has to fit into a byte")
    most = F.floor(F.sqrt(F.lit(2.0**62) / F.size(vector)) / 2)
    scaled = F.transform(vector, lambda x: x.cast("double") * SCALE)
    kept = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(F.forall(scaled, lambda x: x.isNotNull() & (x >= -most) & (x < most + 1)))
    by = [F.col(id_).asc_nulls_last(), F.col(vector)]
    head = kept.orderBy(*by).limit(1).select(F.size(vector).alias("n")).collect()
    if not head:
        return Codebooks(np.zeros((parts, 0, 0), np.int64))
    length = head[0]["n"]
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    first = kept.where(F.size(vector) == length).orderBy(*by).limit(entries).select(F.transform(scaled, lambda x: F.floor(x)).alias("x")).collect()  # at most `entries` rows
    width = length // parts
    books = np.array([r["x"] for r in first], np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    schema = "part int, entry int, n long, " + ", ".join(f"s{j} long" for j in range(width))
    for _ in range(rounds):
        found = vectors.select(vector).mapInArrow(functools.partial(_sums, books=books), schema)
        summed = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(f"s{j}") for j in range(width)]).alias("s"))
        books = books.copy()
        for r in summed.collect():  # a row an entry
            books[r["part"], r["entry"]] = np.array(r["s"], np.int64) // r["n"]
    return Codebooks(books)


def coded(vectors: DataFrame, codebooks: Codebooks, vector: str = "embedding", keep: list[str] | None = None, code: str = "code", error: str = "error") -> DataFrame:
    """Of the kept rows the columns `keep` (all), code (two hex digits a part) and error (squared distance to the entries); columns of these two
    names are replaced."""
    books = codebooks.books
    keep = [c for c in (vectors.columns if keep is None else keep) if c.lower() not in (code.lower(), error.lower())]
    packed = vectors.select(F.struct(*keep).alias("row"), F.col(vector).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not books.shape[1]:
                continue
            kept, values = integers(batch.column(1), books.shape[0] * books.shape[2])
            codes = assigned(values, books)
            entries = books[np.arange(len(books))[None, :], codes].reshape(values.shape)
            text = [bytes(x).hex() for x in codes.astype(np.uint8)]
            off = ((values - entries) ** 2).sum(axis=1)
            yield pa.record_batch([batch.column(0).take(pa.array(kept)), pa.array(text, pa.string()), pa.array(off, pa.int64())], ["row", "code", "error"])

    found = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, code string, error long")
    return found.select("row.*", F.col("code").alias(code), F.col("error").alias(error))
