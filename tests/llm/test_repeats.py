"""Removed passages and run-length indexes against brute force over all passages."""

import random

import numpy as np
import pytest

from cohortloom.llm import repeats
from cohortloom.llm.run_index import RunLengthIndex

SCHEMA = "doc_id bigint, text string"


def brute(rows):
    first, out = {}, []
    blobs = [(i, (t or "").encode()) for i, t in rows]
    for i, b in blobs:
        for k in range(len(b) - 49):
            if i is not None:
                g = b[k : k + 50]
                first[g] = min(first.get(g, i), i)
    for i, b in blobs:
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        spans = [k for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])]
        ends = [k + 1 for k in range(len(b)) if gone[k] and (k + 1 == len(b) or not gone[k + 1])]
        out.append((i, len(b), tuple(zip(spans, ends, strict=True)), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


def found(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as slice", "'x' as key", "2 as first", "3 as bytes")
    got = repeats.without_repeats(df.repartition(parts)).collect()
    return sorted(((r.doc_id, r.n_bytes, tuple((s.begin, s.end) for s in r.spans), bytes(r.kept)) for r in got), key=str)


def sample(seed):
    rng = random.Random(seed)
    letters = "abé \n" if seed % 2 else "abcdefgh "
    piece = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [piece(n) for n in (49, 50, 51, 60, 90, 300, 1200)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            parts += [piece(rng.randrange(0, 40)), s[a : a + rng.randrange(1, len(s) + 1)] if rng.random() < 0.5 else s]
        rows.append((rng.randrange(-20, 1000), "".join(parts)))
    rows += [(5, None), (6, ""), (7, "x" * 500), (8, "x" * 400), (8, "y" * 200), (8, "y" * 200), (2, "ab" * 300), (3, "ba" * 300),
             (None, shared[-1]), (None, None), rows[0], (10**12, rows[1][1]), (11, "\0" * 120), (12, "\0" * 70 + "z")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_removed_passages_match_brute_force(spark, seed):
    rows = sample(seed)
    assert found(spark, rows) == brute(rows)


def test_slices_pieces_and_large_groups_change_nothing(spark, monkeypatch):
    # tasks import the module anew, so the sizes are changed where they are bound at run time only for the plan: groups
    rows = [(3000 + i, "x" * (60 + 7 * i) + f"<{i}>" + "y" * (90 - i)) for i in range(30)] + sample(4) + [(2000 + i, f"{i:03d}{'q' * (i % 13)}" + "a passage that very many documents hold, word for word, as one line") for i in range(150)]
    expected = brute(rows)
    monkeypatch.setattr(repeats, "GROUP", 3)
    monkeypatch.setattr(repeats, "TASK", 10)
    assert found(spark, rows, 7) == expected


def test_pieces_of_a_long_text(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    offsets = np.array([0, 30, 30, 1010, 1070, 2600, 5000])
    grams = []
    for q in (repeats.CORE, *repeats.FINER):
        runs = repeats._all_runs(data, offsets, q)
        own = {}
        for start, count, key, _ in zip(*runs, strict=True):
            for g in range(start, start + count):
                assert g not in own
                own[g] = key
        assert sorted(own) == [g for a, b in zip(offsets, offsets[1:], strict=False) for g in range(a, b - 49)]
        grams.append(own)
    same = {}
    for g, key in grams[0].items():  # equal grams have equal keys wherever they stand
        assert same.setdefault(data[g : g + 50].tobytes(), key) == key


def test_texts_longer_than_a_slice(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghijklmnop ") for _ in range(repeats.SLICE + 5000))
    rows = [(1, long[:3000]), (2, long), (3, "u" + long[-700:] + "v")]
    got = found(spark, rows)
    assert [(r[0], r[2]) for r in got] == [(1, ()), (2, ((0, 3000),)), (3, ((1, 701),))]


def test_no_documents(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("seed", range(40))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    width, letters = rng.choice([3, 5, 9, 20]), b"ab\0" if seed % 2 else b"abcd"
    some = lambda n: [bytes(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in range(n)]
    held, asked = some(rng.randrange(1, 8)), some(rng.randrange(1, 8))
    block = sorted(rng.randrange(3) for _ in held)
    block = [sorted(set(block)).index(b) for b in block]
    if width > 9:
        asked = [p + rng.choice(held) + p for p in asked]
    own = [rng.choice(block) for _ in asked]
    flat = lambda s: (np.frombuffer(b"".join(s), np.uint8), np.cumsum([0, *map(len, s)]))
    number, place = RunLengthIndex(*flat(held), np.array(block)).statistics(*flat(asked), np.array(own), width)
    expected = [(i, k) for i, p in enumerate(asked) for k in range(len(p) - width + 1)
                if any(b == own[i] and p[k : k + width] in t for t, b in zip(held, block, strict=True))]
    assert sorted(zip(number.tolist(), place.tolist(), strict=True)) == sorted(expected)
