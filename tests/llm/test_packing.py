import collections
import random
import zlib

import numpy as np
import pytest

from riskweave.llm import packing, queries

PATH = queries.tokenizer_path()


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


ODD = ["a<|endoftext|>b", "x\x1cy\x85z  q　w", "É é ́x", "A'S it's\tb İstanbul ΣΑΣ ﬁ don't 've'", "", None, "O'Neil's...'s 's", "ß ẞ straße’s Ÿ", "x" * 3000, "a.b,c 12-3\r\nd"]


def test_ids_are_the_tokenizers(odd_texts):
    texts = ODD + odd_texts
    for cache in (600_000, 3):
        assert [np.frombuffer(x, "<u4").tolist() + [0] for x in packing.WordIds(PATH, cache).encode(texts)] == ids_of(texts)


def test_ids_of_decomposed_letters():
    words = ["cafe\u0301", "perche\u0301", "cafe\u0301.", "e\u0323\u0301!", "é\u0323", "x\u0301", "a.\u0301", "CAFE\u0301 nai\u0308ve", "A\u030a", "ß\u0308\u2019s"]
    texts = words + [" ".join(words), " ".join(f"{a}{chr(m)}" for a in "aeiouncyzAEIOUNCYZéñ" for m in range(0x300, 0x370))]
    assert [np.frombuffer(x, "<u4").tolist() + [0] for x in packing.WordIds(PATH).encode(texts)] == ids_of(texts)


def check(rows, texts, capacity):
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, ids in enumerate(ids_of(texts)):
        want = [(k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(np.array(ids[k : k + capacity], "<u4").tobytes())) for k in range(0, len(ids), capacity)]
        assert sorted(pieces[doc]) == want
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_round_trip(spark, odd_texts, capacity):
    texts = ODD + odd_texts
    rows = packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc long, text string").repartition(3), PATH, capacity).collect()
    used = check(rows, texts, capacity)
    assert used <= 1.1 * -(-sum(map(len, ids_of(texts))) // capacity) + 1


def test_null_ids_and_no_rows(spark):
    rows = packing.packed(spark.createDataFrame([(None, "a"), (None, "a"), (2**60 + 1, None)], "doc long, text string"), PATH).collect()
    assert sorted((str(r["doc"]), r["length"]) for r in rows) == [(str(2**60 + 1), 1), ("None", 2), ("None", 2)]
    assert packing.packed(spark.createDataFrame([], "doc long, text string"), PATH).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps, n = collections.Counter(), 0
    for x in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= x and gaps[g]), default=None)
        if fit is None:
            n, fit = n + 1, capacity
        else:
            gaps[fit] -= 1
        gaps[fit - x] += 1
    return n


def rounds(lengths, capacity, parts):
    """The rounds of best_fit in plain Python, with the rows of each dealt over parts: the sequences, and the number of rounds."""
    sequences, waiting, turns = [[x] for x in lengths if 2 * x > capacity], sorted((x for x in lengths if 2 * x <= capacity), reverse=True), 0
    while waiting:
        turns += 1
        rows = [(-x, 1, None) for x in waiting]
        for i, held in enumerate(sequences):
            gap = capacity - sum(held)
            if gap >= waiting[-1]:
                many = max(1, gap // waiting[0])
                rows += [(-(gap // many), 0, i)] * many
        rows.sort(key=lambda r: r[:2])
        size = -(-len(rows) // parts)
        done, left = [], []
        for p in range(parts):
            mine = rows[p * size : (p + 1) * size]
            found = list(packing.swept((k, r[1] == 0) for k, r in enumerate(mine)))
            done += [(-mine[a][0], mine[b][2]) for a, b in found if a >= 0 and b >= 0]
            left.append((p, [-mine[a][0] for a, b in found if b < 0], [mine[b][2] for a, b in found if a < 0]))
        alone = list(packing.swept((k, r[1] == 0) for k, r in enumerate(rows)))
        first = [0] * parts
        for p, j, n, q, last in packing.across([(p, len(d), len(s)) for p, d, s in left]):
            done += [(left[p][1][j + i], left[q][2][last - i]) for i in range(n)]
            first[p] = j + n
        # the sweep over parts is the sweep over all rows
        assert sorted(done) == sorted((-rows[a][0], rows[b][2]) for a, b in alone if a >= 0 and b >= 0)
        for x, i in done:
            sequences[i].append(x)
        before, waiting = len(waiting), [x for p, d, _ in left for x in d[first[p] :]]
        if waiting:
            room = sum(capacity - sum(held) for held in sequences if capacity - sum(held) >= waiting[-1])
            need = packing.needed(sum(waiting), len(waiting), room, len(waiting) < before, capacity)
            sequences += [[x] for x in waiting[:need]]
            waiting = waiting[need:]
    return sequences, turns


@pytest.mark.parametrize("low, high", [(1, 100), (1, 6), (30, 60), (20, 40), (51, 100), (1, 1), (100, 100)])
def test_rounds(low, high):
    rng = random.Random(high)
    lengths = [rng.randint(low, high) for _ in range(3000)]
    for parts in (1, 4, 13):
        sequences, turns = rounds(lengths, 100, parts)
        assert sorted(x for s in sequences for x in s) == sorted(lengths) and max(map(sum, sequences)) <= 100 and turns <= 100
        assert len(sequences) <= 1.02 * best_fit_decreasing(lengths, 100) + 1


def test_openings():
    assert packing.opening([(0, 2, 5), (3, 0, 4), (7, 1, 9)], 5) == [(0, 2, 5), (3, 0, 2), (7, 1, 1)]


@pytest.mark.parametrize("coalesced", [True, False])
def test_best_fit(spark, coalesced):
    """In one range partition and in several; all pieces have places, gapless, and the sequences are hardly more than one after another gives."""
    rng = random.Random(4)
    lengths = [rng.choice([rng.randint(1, 100), rng.randint(1, 20), 30]) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(lengths)), "rid long, length long").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    try:
        rows = packing.best_fit(df, 100).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = collections.defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["rid"]))
    assert sorted(i for s in held.values() for _, i in s) == list(range(1500))
    for pieces in held.values():
        end = 0
        for offset, i in sorted(pieces):
            assert offset == end
            end += lengths[i]
        assert end <= 100
    assert len(held) <= 1.02 * best_fit_decreasing(lengths, 100) + 1


def test_rounds_run_no_job_for_room_and_tokens(spark, monkeypatch):
    """What waits and what room is left is summed by the jobs that write a round's tables, and is right."""
    rng = random.Random(9)
    lengths = [rng.randint(1, 60) for _ in range(800)]
    asked, needed, firsts = [], packing.needed, []
    monkeypatch.setattr(packing, "needed", lambda tokens, pieces, room, placed, capacity: asked.append((tokens, pieces, room)) or needed(tokens, pieces, room, placed, capacity))
    kind = type(spark.range(0))
    real = kind.first
    monkeypatch.setattr(kind, "first", lambda self: firsts.append(self) or real(self))
    placed = packing.best_fit(spark.createDataFrame(list(enumerate(lengths)), "rid long, length long"), 100)
    assert len(asked) > 1 and len(firsts) == 1
    assert sorted(r["rid"] for r in placed.collect()) == list(range(800))
    short = [x for x in lengths if x <= 50]
    tokens, pieces, room = asked[0]
    opened = [x for x in lengths if x > 50]
    assert 0 < tokens <= sum(short) and pieces < len(short) and 0 <= room <= sum(100 - x for x in opened) - (sum(short) - tokens)


def test_bad_lengths(spark):
    pieces = spark.createDataFrame([(1, 11)], "rid long, length long")
    assert packing.best_fit(pieces.limit(0), 10).count() == 0
    with pytest.raises(ValueError):
        packing.best_fit(pieces, 10)
