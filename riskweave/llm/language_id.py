"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text's UTF-8 bytes are read whole, white space and digits too, in windows: CORE bytes with CONTEXT bytes of the text before and after
them.  In each window a forward and a backward GRU run from its ends across all words, and every byte position of the core gets a
probability for each language from both states; the context only brings the states to the text's middle.  A document's probabilities are
the mean over its positions that can be part of a word (ASCII letters and bytes beyond ASCII).  Texts of any length are thus read in
bounded memory, and all windows of a batch run side by side.

Training is by backpropagation through time with Adam, on the driver, on a bounded sample: at most SAMPLE_DOCS documents of each
language (fewer if there are more than SAMPLE_TOTAL / SAMPLE_DOCS languages), chosen by a hash of the id, and of each at most
SAMPLE_WINDOWS windows of TRAIN_BYTES bytes, evenly over the whole text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean

HIDDEN = 16
CORE = 224
CONTEXT = 16
TRAIN_BYTES = 96
SAMPLE_DOCS = 300
SAMPLE_TOTAL = 20_000
SAMPLE_WINDOWS = 16
TRAIN_WINDOWS = 40_000

#: Bytes that can be part of a word.
_WORD = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])


def windows(data: bytes, core: int = CORE, context: int = CONTEXT) -> list[tuple[bytes, int, int]]:
    """(window, start, end) with window[start:end] its core; the cores in a row are the data."""
    out = []
    for k in range(0, len(data), core):
        first = max(0, k - context)
        out.append((data[first : k + core + context], k - first, min(k + core, len(data)) - first))
    return out


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def has_letter(data: bytes) -> bool:
    return any(map(str.isalpha, data.decode("utf-8", "replace")))


def padded(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes, filled up at their ends, and their lengths."""
    lengths = np.array([len(w) for w in parts])
    longest = int(lengths.max())
    return np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in parts), np.uint8).reshape(len(parts), longest), lengths


class BiGRU:
    """Byte inputs, two GRUs of `hidden` units, a softmax over the languages at every position.

    Inside, rows are the last axis: a step works on (units, rows).  The backward GRU reads each row's own bytes from its last one on, so
    that what fills a row up comes last in both directions and changes nothing before it.
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        wide = lambda *s: (rng.standard_normal(s) / np.sqrt(hidden)).astype(np.float32)
        self.p = {"out": wide(2 * hidden, max(1, len(languages))), "bias": np.zeros(max(1, len(languages)), np.float32)}
        for d in "fb":
            # gates in the order update, reset, new; the byte table holds the input weights and biases
            self.p |= {f"x{d}": wide(256, 3 * hidden), f"u{d}": wide(hidden, 3 * hidden), f"c{d}": np.zeros(hidden, np.float32)}

    def _run(self, x: np.ndarray, d: str, keep: list) -> np.ndarray:
        """States (positions, units, rows) of one direction over x (positions, rows); keep collects what backpropagation needs."""
        steps, n, H = len(x), x.shape[1], self.hidden
        table, u, c = np.ascontiguousarray(self.p[f"x{d}"].T), np.ascontiguousarray(self.p[f"u{d}"].T), self.p[f"c{d}"][:, None]
        x = x.astype(np.intp)
        h = np.zeros((H, n), table.dtype)
        out = np.empty((steps, H, n), table.dtype)
        for t in range(steps):
            a, s = np.take(table, x[t], axis=1), u @ h
            gates, m = a[: 2 * H], s[2 * H :]
            gates += s[: 2 * H]
            gates *= 0.5  # the logistic function by way of tanh
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            m += c
            new = m * gates[H:]
            new += a[2 * H :]
            np.tanh(new, out=new)
            now = np.subtract(h, new, out=out[t])
            now *= gates[:H]
            now += new
            keep.append((h, gates[:H], gates[H:], m, new))
            h = now
        return out

    def _states(self, x: np.ndarray, d: str) -> np.ndarray:
        """As _run, for labelling: exponentials take less time than hyperbolic tangents, and signs and factors are in the weights."""
        steps, n, H = len(x), x.shape[1], self.hidden
        factor = np.repeat(np.array([-1, -1, 2], np.float32), H)[:, None]
        table, u = (np.ascontiguousarray(self.p[f"{k}{d}"].T * factor) for k in "xu")
        c = 2 * self.p[f"c{d}"][:, None]
        x = x.astype(np.intp)
        a, s = (np.empty((3 * H, n), table.dtype) for _ in range(2))
        gates, new = s[: 2 * H], s[2 * H :]
        h = np.zeros((H, n), table.dtype)
        out = np.empty((steps, H, n), table.dtype)
        with np.errstate(over="ignore"):  # beyond the largest exponential a gate is 0, a state 1
            for t in range(steps):
                np.take(table, x[t], axis=1, out=a, mode="clip")
                np.matmul(u, h, out=s)
                gates += a[: 2 * H]
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                new += c
                new *= gates[H:]
                new += a[2 * H :]
                np.exp(new, out=new)
                new += 1
                np.divide(-2, new, out=new)
                new += 1
                now = np.subtract(h, new, out=out[t])
                now *= gates[:H]
                now += new
                h = now
        return out

    def _forward(self, x: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, ...]:
        """Probabilities (positions, languages, rows), both directions' states, what they read, and each position's place from the other end."""
        H, out = self.hidden, self.p["out"]
        mirror = np.maximum(lengths - 1 - np.arange(x.shape[1])[:, None], 0)
        # rows of one length are turned round as a whole
        turned = (lambda y, _: y[::-1]) if (lengths == x.shape[1]).all() else (lambda y, at: np.take_along_axis(y, at, 0))
        read = {"f": np.ascontiguousarray(x.T)}
        read["b"] = turned(read["f"], mirror)
        states = {d: self._states(read[d], d) if keep is None else self._run(read[d], d, keep.setdefault(d, [])) for d in "fb"}
        p = turned(out[H:].T @ states["b"], mirror[:, None, :])
        p += out[:H].T @ states["f"]
        p += self.p["bias"][:, None]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p, states, read, mirror

    def label(self, x: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
        """Probabilities (positions, rows, languages) for x (rows, positions) of bytes; those from a row's length on mean nothing."""
        return self._forward(x, np.full(len(x), x.shape[1]) if lengths is None else lengths)[0].transpose(0, 2, 1)

    def gradients(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients by backpropagation through time; y: a language number a row."""
        n, steps = x.shape
        H, out = self.hidden, self.p["out"]
        lengths = np.full(n, steps) if lengths is None else lengths
        keep: dict = {}
        prob, states, read, mirror = self._forward(x, lengths, keep)
        live = (np.arange(steps)[:, None] < lengths) / lengths.sum()
        rows = np.arange(n)
        loss = float(-(np.log(prob[:, y, rows] + 1e-12) * live).sum())
        prob[:, y, rows] -= 1
        prob *= live[:, None, :].astype(prob.dtype)
        error = {"f": prob, "b": np.take_along_axis(prob, mirror[:, None, :], 0) * (live > 0)[:, None, :]}
        g = {"out": np.concatenate([np.tensordot(states[d], error[d], ([0, 2], [0, 2])) for d in "fb"]), "bias": prob.sum((0, 2))}
        for d, w in (("f", out[:H]), ("b", out[H:])):
            back, u = w @ error[d], self.p[f"u{d}"]
            gu, gc = np.zeros_like(u), np.zeros(H, u.dtype)
            into = np.empty((steps, 3 * H, n), u.dtype)
            dh = np.zeros((H, n), u.dtype)
            for t in range(steps - 1, -1, -1):
                h, z, r, m, new = keep[d][t]
                dh += back[t]
                dnew = dh * (1 - z) * (1 - new * new)
                dm = dnew * r
                into[t, :H] = dh * (h - new) * z * (1 - z)
                into[t, H : 2 * H] = dnew * m * r * (1 - r)
                into[t, 2 * H :] = dnew
                ds = np.concatenate([into[t, : 2 * H], dm])
                gu += h @ ds.T
                gc += dm.sum(1)
                dh = dh * z + u @ ds
            seen = read[d].ravel()
            order = np.argsort(seen, kind="stable")
            present, first = np.unique(seen[order], return_index=True)
            gx = np.zeros_like(self.p[f"x{d}"])
            gx[present] = np.add.reduceat(into.transpose(0, 2, 1).reshape(-1, 3 * H)[order], first)
            g |= {f"x{d}": gx, f"u{d}": gu, f"c{d}": gc}
        return loss, g

    def fit(self, parts: list[bytes], labels: list[int], steps: int = 300, batch: int = 128, rate: float = 0.01, seed: int = 0) -> list[float]:
        """`steps` steps of Adam, each over a random batch of windows; returns their losses."""
        rng, losses = np.random.default_rng(seed), []
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        y = np.array(labels)
        for step in range(1, steps + 1 if parts else 1):
            some = rng.integers(0, len(parts), batch)
            x, lengths = padded([parts[i] for i in some])
            loss, g = self.gradients(x, y[some], lengths)
            losses.append(loss)
            lr = rate * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k in self.p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] * g[k] - v[k])
                self.p[k] -= (lr * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
        return losses

    def pooled(self, found: list[tuple[bytes, int, int]], chunk: int = 512) -> np.ndarray:
        """For each window the sums of the probabilities at its core's word bytes and, last, how many these are."""
        out = np.zeros((len(found), len(self.languages) + 1), np.float32)
        order = sorted(range(len(found)), key=lambda i: len(found[i][0]))
        for k in range(0, len(order), chunk):
            part = order[k : k + chunk]
            x, lengths = padded([found[i][0] for i in part])
            start, end = np.array([found[i][1:] for i in part]).T
            at = np.arange(x.shape[1])[:, None]
            counted = ((at >= start) & (at < end) & _WORD[x.T]).astype(np.float32)
            out[part, :-1] = np.einsum("tkn,tn->nk", self._forward(x, lengths)[0], counted)
            out[part, -1] = counted.sum(0)
        return out


def training_sample(labelled: DataFrame, docs: int = SAMPLE_DOCS, total: int = SAMPLE_TOTAL, per_doc: int = SAMPLE_WINDOWS) -> list[tuple[str, list[bytes]]]:
    """labelled(id, text, lang), lang not null: (lang, windows) of at most `docs` documents a language and about `total` in all."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(total).collect()}
    if not counts:
        return []
    docs = max(1, min(docs, total // len(counts)))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * docs / n + 20 / n))])
    place = F.xxhash64(F.col("id").cast("string")).alias("place")
    chosen = labelled.select("lang", "text", place).where((F.col("place") / float(1 << 63) + 1) / 2 < F.element_at(share, F.col("lang")))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch["text"]:
                data = encoded(text)
                some = min(per_doc, -(-len(data) // TRAIN_BYTES))
                starts = np.linspace(0, max(0, len(data) - TRAIN_BYTES), some).astype(int)
                found.append([w for w in (data[k : k + TRAIN_BYTES] for k in starts) if has_letter(w)])
            yield pd.DataFrame({"lang": batch["lang"], "place": batch["place"], "windows": found})

    rows = chosen.mapInPandas(spread, "lang string, place long, windows array<binary>").where("size(windows) > 0").collect()
    out, taken = [], defaultdict(int)
    for lang, place, found in sorted((r["lang"], r["place"], [bytes(w) for w in r["windows"]]) for r in rows):
        if taken[lang] < docs:
            taken[lang] += 1
            out.append((lang, found))
    return out


def trained(sample: list[tuple[str, list[bytes]]], hidden: int = HIDDEN, limit: int = TRAIN_WINDOWS, seed: int = 0) -> BiGRU:
    """A network for the sample's languages; of its windows at most `limit` are used, as many of each language."""
    languages = sorted({lang for lang, _ in sample})
    rng = np.random.default_rng(seed)
    parts, labels, least = [], [], limit // max(1, len(languages))
    for k, lang in enumerate(languages):
        mine = [w for x, ws in sample if x == lang for w in ws]
        # languages count alike: those with few windows return more often
        some = [i for _ in range(-(-least // len(mine))) for i in rng.permutation(len(mine))][:least]
        parts += [mine[i] for i in some]
        labels += [k] * len(some)
    net = BiGRU(languages, hidden, seed)
    net.fit(parts, labels, steps=200 + 100 * len(languages), seed=seed)
    return net


def identified(docs: DataFrame, net: BiGRU, carry: list[str] = ()) -> DataFrame:
    """docs(text, *carry): the carried columns, lang_pred, score, positions (bytes whose probabilities are pooled).

    lang_pred is und with score 0 for a null text or one without a letter, or if the network knows no language; ties go to the first language
    in alphabetical order.  Only the text decides: repeated rows get the same result each, other columns than `carry` are left out, and an
    empty table gives an empty one.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple[bytes, int, int], int] = {}  # a batch's copies are labelled once
            ids = []
            for text in batch.column("text").to_pylist():
                data = encoded(text)
                found = windows(data) if net.languages and has_letter(data) else []
                ids.append(np.fromiter((known.setdefault(w, len(known)) for w in found), np.int64))
            table = net.pooled(list(known))
            langs, scores, places = [], [], []
            for doc in ids:
                sums = table[doc].sum(0, dtype=np.float64)
                if not sums[-1]:
                    langs.append("und")
                    scores.append(0.0)
                else:
                    mean = sums[:-1] / sums[-1]
                    best = int(mean.argmax())
                    langs.append(net.languages[best])
                    scores.append(float(min(1.0, mean[best])))
                places.append(int(sums[-1]))
            found = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *found], [*carry, "lang_pred", "score", "positions"])

    kept = docs.select("text", *carry)
    types = dict(kept.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in carry], "lang_pred string, score double, positions long"])
    return kept.mapInArrow(lean(label), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1
