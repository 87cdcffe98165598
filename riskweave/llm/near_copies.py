"""Exact n-gram Jaccard self-join by prefixes under several global token orders, and its connected components.

A document's set holds the 64-bit hashes of its distinct 5-word shingles; texts with equal sets are one class, known by the set's
hash, and only classes are compared.  Under any total order of all tokens, two sets with
100 * |intersection| >= 80 * |union| share a token within the first n - required + 1 tokens of each, where
required = ceil(4 (n + m) / 9) is the overlap they need.  Candidates must do so under three orders:

1. rarest first: by the number of tokens of all classes in the token's one of 2^BUCKET_BITS buckets, then by the hash.  The prefixes
   are posted by token, and the positions in a posting also bound the possible overlap.
2. and 3. by the magnitude of the bucket's number, then by two other hashes.  A pair's prefixes under these are compared by 32-bit
   fingerprints before the whole sets are fetched.

What the three filters leave is verified: first by the parities of the tokens' counts in BITS hash classes (two sets differ in no more
parities than their symmetric difference has tokens), then on the whole sets.

The bucket numbers are one array of fixed size, summed over all documents.  Passages that many documents share come last in all orders.

Large groups of near copies are not expanded into pairs.  Every posting list first offers only its most central member to the
others, and what is verified there is united.  In lists that still hold several components, members outside the list's
largest component then meet a few other members of that component in turn, and at last, where they are still outside, all members
of other components.  Since a link inside a component changes nothing, no link is lost.

No key is hot: tokens of buckets far above the average are dealt over several salted lists, and so are classes with many partners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, lean
from .components import components

SHINGLE = 5
BITS = 1024
BUCKET_BITS = 18
#: Members of a posting list, or partners of a class, in one salted part; of lists also at least so many times the average bucket.
PART_MEMBERS = 1_000
PART_AVERAGES = 8
#: How many further centres are tried before all remaining pairs are compared.
CENTRES = 2
BROADCAST_IDS = 2_000_000
MET_CLASSES = 1_000_000
#: Columns of a member of a posting list.
MEMBER = ["token", "salt", "parts", "cls", "n", "at"]
#: Words end at ASCII white space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_MIX, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Shingler:
    """Sets of hashed shingles, as sorted arrays."""

    def __init__(self, words: int = SHINGLE):
        self.words = words

    def set_of(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; a text with fewer words has its whole sequence as the one shingle, none if it has no word."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))  # faster than a cache of words
        if not len(h):
            return h
        k = min(self.words, len(h))
        a = h[: len(h) - k + 1] + np.uint64(k)
        for i in range(1, k):
            a = (a ^ (a >> np.uint64(29))) * _MIX + h[i : len(h) - k + 1 + i]
        a = (a ^ (a >> np.uint64(32))) * _MIX
        a ^= a >> np.uint64(29)
        a.sort()  # np.unique takes several times as long on short arrays
        first = np.concatenate(([True], a[1:] != a[:-1]))
        return a if first.all() else a[first]


def set_id(tokens: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(tokens.tobytes(), seed=len(tokens)) - (1 << 63)


def required(n, m, percent: int = 80):
    """The overlap that sets of n and m need: ceil(percent (n + m) / (100 + percent))."""
    return -(-percent * (n + m) // (100 + percent))


def longest_prefix(n: int, percent: int = 80) -> int:
    """With the smallest set that can be linked to one of n."""
    return n - (-(-percent * n // 100)) + 1


def parities(tokens: np.ndarray) -> np.ndarray:
    """The parities of the counts of tokens in BITS classes, as 64-bit integers."""
    odd = np.bincount((tokens & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int = 80) -> bool:
    """The plain test on two sets, for small tables and tests."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc").cast("long").alias("doc"), "text")


def token_counts(docs: DataFrame, made: Tables, bits: int = BUCKET_BITS) -> tuple[DataFrame, np.ndarray]:
    """docs(doc, text): a written table of doc, n, cls (the set's hash; null if empty), and the number of tokens in each of 2^bits buckets.

    A class is counted once a task.  The numbers of a task follow its documents, in a row with an array of buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, met, held, sums = Shingler(), set(), [], np.zeros(1 << bits, np.int64)
        shift = np.uint64(64 - bits)
        names = ["doc", "n", "cls", "buckets", "hits"]
        lists = lambda rows: [pa.array(rows, pa.list_(pa.int32())), pa.array([None if r is None else r.astype(np.int64) for r in rows], pa.list_(pa.int64()))]
        for batch in batches:
            ns, ids = [], []
            for text in batch.column("text").to_pylist():
                s = shingler.set_of(text)
                ns.append(len(s))
                ids.append(set_id(s) if len(s) else None)
                if len(s) and ids[-1] not in met:
                    if len(met) >= MET_CLASSES:
                        met.clear()
                    met.add(ids[-1])
                    held.append((s >> shift).astype(np.int64))
            if held:
                sums += np.bincount(np.concatenate(held), minlength=1 << bits)
                held.clear()
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(ns, pa.int64()), pa.array(ids, pa.int64()), *lists([None] * len(ns))], names)
        some = np.flatnonzero(sums)
        if len(some):
            columns = [pa.array([None], pa.int64()) for _ in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([some.astype(np.int32)], pa.list_(pa.int32())), pa.array([sums[some]], pa.list_(pa.int64()))], names)

    full = made.write(docs.mapInArrow(lean(count), "doc long, n long, cls long, buckets array<int>, hits array<long>"), "near-sets")
    each = full.where("buckets is not null").select(F.explode(F.arrays_zip("buckets", "hits")).alias("x"))
    summed = each.groupBy("x.buckets").agg(F.sum("x.hits").alias("n")).toArrow()  # at most 2^bits rows
    out = np.zeros(1 << bits, np.int64)
    out[summed["buckets"].to_numpy()] = summed["n"].to_numpy()
    sets = made.write(full.where("buckets is null").select("doc", "n", "cls"), "near-rows")
    made.drop("near-sets")  # the tasks' counts are far larger than the rows
    return sets, out


class Orders:
    """The three global orders of tokens, and the parts that a token's list is dealt over."""

    def __init__(self, counts: np.ndarray, frequent: int = PART_MEMBERS):
        self.shift = np.uint64(65 - len(counts).bit_length())
        self.counts = counts
        self.magnitude = np.log2(np.maximum(counts, 1)).astype(np.int8) // 2
        unit = max(frequent, PART_AVERAGES * int(counts.mean()))
        self.parts = np.minimum(-(-counts // unit), 2**31 - 1).astype(np.int32)

    def rarest(self, tokens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The first tokens of a sorted set under order 1, and the parts of their lists."""
        at = (tokens >> self.shift).astype(np.int64)
        first = np.argsort(self.counts[at], kind="stable")[:length]
        return tokens[first], self.parts[at[first]]

    def fingerprints(self, tokens: np.ndarray, length: int) -> list[np.ndarray]:
        """The first tokens under orders 2 and 3, as 32 bits each."""
        size = self.magnitude[(tokens >> self.shift).astype(np.int64)]
        out = []
        for key in (tokens * _MIX, ~(tokens * _OTHER)):
            first = np.lexsort((key, size))[:length]
            out.append((key[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
        return out


def prefixes(docs: DataFrame, orders: Orders, percent: int = 80) -> DataFrame:
    """cls, n, tokens (its prefix under order 1), parts; a row for the first copy of each class that a task meets."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, met = Shingler(), set()
        for batch in batches:
            ids, ns, tokens, parts = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingler.set_of(text)
                if not len(s) or (cls := set_id(s)) in met:
                    continue
                if len(met) >= MET_CLASSES:
                    met.clear()  # a copy more is posted; the lists are made distinct later
                met.add(cls)
                t, p = orders.rarest(s, longest_prefix(len(s), percent))
                ids.append(cls)
                ns.append(len(s))
                tokens.append(t.view(np.int64))
                parts.append(p if p.max() > 1 else None)
            columns = [pa.array(ids, pa.int64()), pa.array(ns, pa.int32()), pa.array(tokens, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["cls", "n", "tokens", "parts"])

    return docs.select("text").mapInArrow(lean(sketch), "cls long, n int, tokens array<long>, parts array<int>")


def _postings(docs: DataFrame, orders: Orders, percent: int, made: Tables) -> DataFrame:
    """token, salt, parts, cls, n, at (the place under order 1) of the tokens in prefixes; those of a single class only where their list is dealt over
    several parts, which can't be told from one of them.  The tokens are exchanged once: copies and lists of one class are left out where they meet,
    and a part of a list gets its rows' number, copies counted, as met and its most central member as c_cls, c_n, c_at."""
    posted = prefixes(docs, orders, percent).select("cls", "n", "parts", F.posexplode("tokens").alias("at", "token"))
    posted = posted.withColumn("parts", F.greatest(F.coalesce(F.get("parts", F.col("at")), F.lit(1)), F.lit(1)))
    posted = posted.withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).select("token", "salt", "parts", "cls", "n", "at")
    dealt = posted.repartition("token", "salt")
    one = Window.partitionBy("token", "salt")
    shared = (F.col("parts") > 1) | (F.min("cls").over(one) != F.max("cls").over(one))
    # what only shared lists need is counted after the others have gone, in the same order
    kept = dealt.withColumn("_shared", shared).where("_shared").withColumns({"met": F.count("*").over(one), "_c": _central().over(one)})
    return made.write(kept.select(*MEMBER, "met", *[F.col(f"_c.{x}").alias(f"c_{x}") for x in ("cls", "n", "at")]).distinct(), "near-postings")


def _central():
    """The most central of a list's members."""
    return F.min(F.struct((F.col("at") / F.col("n")).alias("part"), "cls", "n", "at"))


def _central_offers(postings: DataFrame, percent: int) -> DataFrame:
    """The members of each list with its most central one: the postings have it beside them, but for lists that are dealt over several parts."""
    dealt = postings.where("parts > 1").select(*MEMBER)
    centre = dealt.groupBy("token").agg(_central().alias("c"), F.max("parts").alias("parts"))
    beside = postings.where("parts = 1").select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), F.col("c_cls").alias("b"), F.col("c_n").alias("nb"), F.col("c_at").alias("ib"))
    return beside.where("a <> b").where(_possible(percent)).union(_meetings(dealt, _salted(centre), percent))


def _salted(lists: DataFrame) -> DataFrame:
    """A row for each part of a list."""
    return lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def near_copies(docs: DataFrame, percent: int = 80, frequent: int = PART_MEMBERS, bits: int = BUCKET_BITS) -> DataFrame:
    """docs(doc long, text): doc, n_shingles, component_id (the smallest doc that is reached by links, itself included).

    Null, empty and wordless texts have an empty set and are linked with nothing; equal texts share a component; rows with
    one id are one document when their sets are equal; the smallest doc is null only where all of a component are.  An empty table gives an
    empty result.  Lists of about `frequent` members or more are dealt over several parts.
    """
    made, docs = Tables(docs.sparkSession), _inputs(docs)
    sets, counts = token_counts(docs, made, bits)
    orders = Orders(counts, frequent)
    classes = made.write(sets.where("cls is not null").groupBy("cls").agg(F.min("doc").alias("rep")), "near-classes")
    postings = _postings(docs, orders, percent, made)
    verify = Verifier(docs, classes, orders, percent, made, frequent)

    # 1. the most central member of each list, offered to the others
    verify.test(_central_offers(postings, percent))
    comps = components(verify.edges)
    # 2. members outside a list's largest component meet other members of it
    for turn in range(CENTRES):
        members, main = _open_lists(postings, comps, made)
        place = F.xxhash64("token", "cls", F.lit(turn)).alias("part")
        centre = members.join(main, ["token", "salt"]).where("comp = main").groupBy("token").agg(F.min(F.struct(place, "cls", "n", "at")).alias("c"), F.max("parts").alias("parts"))
        outside = members.join(main, ["token", "salt"]).where("comp <> main")
        more = verify.test(_meetings(outside, _salted(centre), percent))
        made.drop("near-members", "near-main")
        if not more:
            break
        comps = components(verify.edges)
    # 3. all that are still outside, with all members of other components
    members, main = _open_lists(postings, comps, made)
    dealt = members.join(main, ["token", "salt"]).select("*", (F.col("comp") != F.col("main")).alias("out"))
    short = dealt.where("out").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    short = short.select("token", "salt", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), F.col("comp").alias("ca"))
    other = dealt.select(F.col("token").alias("t2"), F.col("salt").alias("s2"), F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), F.col("comp").alias("cb"), F.col("out").alias("ob"))
    once = ~F.col("ob") | (F.col("a") < F.col("b"))
    crossing = short.join(other, (F.col("token") == F.col("t2")) & (F.col("salt") == F.col("s2")) & (F.col("ca") != F.col("cb")) & once & _possible(percent))
    final = components(verify.edges) if verify.test(crossing) else comps
    made.drop("near-members", "near-main")

    joined = classes.join(final, classes.cls == final.node, "left").select("cls", "rep", F.coalesce("label", "cls").alias("comp"))
    least = joined.groupBy("comp").agg(F.min("rep").alias("component"))
    named = made.write(joined.join(least, "comp").select("cls", "component"), "near-named")
    verify.drop()
    made.drop("near-classes", "near-postings")
    filled = sets.where("cls is not null").join(named, "cls").select("doc", F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))
    return filled.union(sets.where("cls is null").select("doc", "n", "doc"))


def _meetings(members: DataFrame, centre: DataFrame, percent: int) -> DataFrame:
    """The members of each list with its centre."""
    offered = members.join(centre, ["token", "salt"]).select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), F.col("c.cls").alias("b"), F.col("c.n").alias("nb"), F.col("c.at").alias("ib"))
    return offered.where("a <> b").where(_possible(percent))


def _open_lists(postings: DataFrame, comps: DataFrame, made: Tables) -> tuple[DataFrame, DataFrame]:
    """The members, with comp, of lists of three or more (a pair has met already) in several components, and the lists' largest ones.  Pairs, of which
    most lists are, stay where they are, and components are broadcast, so that what is exchanged is long lists."""
    comps = F.broadcast(comps) if comps.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else comps
    members = postings.where("met > 2 or parts > 1").join(comps, F.col("cls") == F.col("node"), "left").select(*MEMBER, F.coalesce("label", "cls").alias("comp"))
    sizes = members.groupBy("token", "comp").agg(F.count("*").alias("m"), F.max("parts").alias("parts"))
    lists = sizes.groupBy("token").agg(F.count("*").alias("comps"), F.sum("m").alias("all"), F.max(F.struct("m", "comp")).alias("x"), F.max("parts").alias("parts"))
    main = made.write(_salted(lists.where("comps > 1 and all > 2").select("token", F.col("x.comp").alias("main"), "parts")), "near-main")
    return made.write(members.join(main.select("token", "salt"), ["token", "salt"]), "near-members"), main


def _possible(percent: int):
    """Whether sets of na and nb can still overlap enough after places ia and ib."""
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / (100 + percent))
    return (F.col("na") - F.col("ia") >= need) & (F.col("nb") - F.col("ib") >= need)


class Verifier:
    """Candidates of order 1 against orders 2 and 3 and then the whole sets; remembers what has been tested, fetched and linked."""

    def __init__(self, docs: DataFrame, classes: DataFrame, orders: Orders, percent: int, made: Tables, frequent: int = PART_MEMBERS):
        self.docs, self.classes, self.orders, self.percent, self.made, self.frequent = docs, classes, orders, percent, made, frequent
        self.turn, self.tested, self.whole = 0, None, None
        self.edges = docs.sparkSession.createDataFrame([], "a long, b long")

    def test(self, offers: DataFrame) -> bool:
        """offers(a, b) of classes, in any order and repeated: whether there are new links, which join the edges."""
        made, k = self.made, self.turn
        self.turn += 1
        pairs = made.write(offers.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"near-offers-{k}")
        if self.tested is not None:
            pairs = made.write(pairs.join(self.tested, ["a", "b"], "left_anti"), f"near-new-{k}")
        if pairs.isEmpty():
            return False
        self.tested = pairs if self.tested is None else self.tested.union(pairs)
        self._fetch(pairs, k)
        found = made.write(self._linked(pairs, k), f"near-edges-{k}")
        made.drop(f"near-met-{k}")
        self.edges = self.edges.union(found)
        return not found.isEmpty()

    def _fetch(self, pairs: DataFrame, k: int) -> None:
        """Adds to whole(cls, n, second, third, bits, tokens) the classes of pairs that it lacks, from the texts of their smallest ids."""
        wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        if self.whole is not None:
            wanted = wanted.join(self.whole.select("cls"), "cls", "left_anti")
        ids = self.made.write(wanted.join(self.classes, "cls"), f"near-wanted-{k}")
        if ids.isEmpty() and self.whole is not None:
            return
        small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        reps, hint = ids.select("rep").distinct(), F.broadcast if small else lambda x: x
        texts = self.docs.join(hint(reps), self.docs.doc.eqNullSafe(reps.rep), "left_semi").select("text")
        orders, percent = self.orders, self.percent

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler, met = Shingler(), set()
            for batch in batches:
                columns = [[], [], [], [], [], []]
                for text in batch.column("text").to_pylist():
                    s = shingler.set_of(text)
                    if not len(s) or (cls := set_id(s)) in met:
                        continue
                    if len(met) >= MET_CLASSES:
                        met.clear()
                    met.add(cls)
                    row = cls, len(s), *orders.fingerprints(s, longest_prefix(len(s), percent)), parities(s), s.view(np.int64)
                    for column, x in zip(columns, row):
                        column.append(x)
                types = pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["cls", "n", "second", "third", "bits", "tokens"])

        found = texts.mapInArrow(lean(sets), "cls long, n int, second array<int>, third array<int>, bits array<long>, tokens array<long>")
        # rows may share an id with a wanted one, and null ids name no row of their own
        found = found.join(hint(ids.select("cls")), "cls", "left_semi").dropDuplicates(["cls"])  # and the table's writers don't run beside Python
        found = self.made.write(found, f"near-whole-{k}")
        self.whole = found if self.whole is None else self.whole.union(found)

    def _with(self, pairs: DataFrame, side: str, columns: list[str]) -> DataFrame:
        """pairs with columns of whole for a or b, named a_n and so on; a class with many partners is dealt over several parts."""
        whole = self.whole.select(F.col("cls").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        count = pairs.count()
        # only sets that are asked for are exchanged; the first sketches all are
        if ("tokens" in columns or self.turn > 1) and count <= BROADCAST_IDS:
            whole = whole.join(F.broadcast(pairs.select(side).distinct()), side, "left_semi")
        # bare pairs go to the sets, which then are exchanged for the second side only
        first = F.broadcast if len(pairs.columns) == 2 and count <= BROADCAST_IDS else lambda x: x
        if count <= self.frequent:
            return first(pairs).join(whole, side)
        hot = pairs.groupBy(side).agg(F.count("*").alias("m")).where(F.col("m") > self.frequent).select(side, F.ceil(F.col("m") / self.frequent).cast("int").alias("parts"))
        hot = self.made.write(hot, f"near-hot-{side}")
        many = hot.limit(BROADCAST_IDS + 1).count()
        if not many:
            return first(pairs).join(whole, side)
        hot = F.broadcast(hot) if many <= BROADCAST_IDS else hot
        parts = F.coalesce("parts", F.lit(1))
        other = "b" if side == "a" else "a"
        dealt = pairs.join(hot, side, "left").withColumn("salt", F.pmod(F.xxhash64(other), parts).cast("int")).drop("parts")
        spread = whole.join(hot, side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        return dealt.join(spread, [side, "salt"]).drop("salt")

    def _linked(self, pairs: DataFrame, k: int) -> DataFrame:
        n = F.col("a_n"), F.col("b_n")
        need = F.ceil(F.lit(self.percent) * (n[0] + n[1]) / (100 + self.percent)).cast("int")

        def share(order: str):
            return F.arrays_overlap(*[F.slice(f"{side}_{order}", F.lit(1), size - need + 1) for side, size in zip("ab", n)])

        differ = sum((F.bit_count(F.get("a_bits", F.lit(j)).bitwiseXOR(F.get("b_bits", F.lit(j)))) for j in range(BITS // 64)), F.lit(0))
        sketch = ["n", "second", "third", "bits"]
        x = self._with(self._with(pairs, "a", sketch), "b", sketch).where((n[0] >= need) & (n[1] >= need)).where(share("second")).where(share("third"))
        met = self.made.write(x.where(differ <= n[0] + n[1] - 2 * need).select("a", "b"), f"near-met-{k}")
        both, sizes = F.size(F.array_intersect("a_tokens", "b_tokens")), F.size("a_tokens") + F.size("b_tokens")
        return self._with(self._with(met, "a", ["tokens"]), "b", ["tokens"]).where(100 * both >= self.percent * (sizes - both)).select("a", "b")

    def drop(self) -> None:
        self.made.drop(*[n for n in list(self.made.paths) if n.startswith(("near-offers-", "near-new-", "near-edges-", "near-wanted-", "near-whole-", "near-hot-"))])
