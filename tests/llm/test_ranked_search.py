"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cohortloom.llm import ranked_search
from cohortloom.llm.ranked_search import BLOCK, packed, search, unpacked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            n, score = sum(bag.values()), 0
            for t in terms(text):
                if bag[t]:
                    m = 75 + 25 * n * n_docs // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def sample(seed):
    rng = random.Random(seed)
    vocabulary = [rng.choice("abcdefgé0") * rng.randrange(1, 4) + str(k) for k in range(150)]
    weights = [1 / (k + 1) for k in range(150)]
    text = lambda n: "".join(rng.choice([w, w.upper()]) + rng.choice([" ", ", ", "\n", "_", "\x7f"]) for w in rng.choices(vocabulary, weights, k=n))
    docs = [(i * 7 % 401 - 50, text(rng.choice([1, 5, 40, 200]))) for i in range(400)]
    docs += [docs[0], docs[0], (3, None), (4, ""), (5, " .,\t"), (None, docs[1][1]), (None, docs[1][1]), (900, text(30_000)), (901, "É é È")]
    items = [(i, text(rng.choice([1, 3, 12, 40]))) for i in range(25)]
    items += [(1, docs[2][1]), (None, docs[3][1]), (30, None), (31, ""), (32, "unheardof"), (33, "é è É"), items[0]]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize(("seed", "shard"), [(1, 8 << 20), (2, 4000)])
def test_ranks_match_scores_of_every_document(spark, monkeypatch, seed, shard):
    docs, items = sample(seed)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as term", "2 as shard", "'x' as item_id")
    i = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "5 as doc_id", "'y' as ask")
    monkeypatch.setattr(ranked_search, "BATCH", 60)
    parts = 2 if shard > 10_000 else 40
    got = search(d.repartition(parts), i.repartition(2)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert search(docs.limit(0), items).collect() == []
    assert search(docs, items.limit(0)).collect() == []


def test_numbers_survive_packing():
    values = np.array([1, 127, 128, 16383, 16384, 2**21, 2**28 + 5, 2**31 - 1, 3])
    data, start = packed(values)
    assert unpacked(data).tolist() == values.tolist()
    assert [unpacked(data[a:b])[0] for a, b in zip(start, [*start[1:], len(data)], strict=True)] == values.tolist()


def test_unneeded_blocks_stay_packed():
    import pyarrow as pa

    rng = random.Random(1)
    rare = "needle " * 3
    docs = [("common " * rng.randrange(1, 4) + "word " * rng.randrange(0, 9) + (rare if k in range(700, 730) else "")) for k in range(3000)]
    column = pa.array(docs)
    data, offsets = ranked_search.texts.flat(column)
    rows, sizes = ranked_search.postings(data, offsets, None)
    n = len(rows["n"])
    weights = {"needle": 5000, "common": 1, "word": 1}
    asks = pa.array([[{"ask": 0, "item_id": 0, "times": 1}]] * n)
    table = pa.table(rows | {"w": pa.array([weights[t] for t in rows["term"].to_pylist()]), "asks": asks, "ids": pa.nulls(n, pa.list_(pa.int64()))})
    head = pa.table({f.name: pa.nulls(1, f.type) for f in table.schema})
    head = head.set_column(table.schema.get_field_index("ids"), "ids", pa.array([list(range(3000))]))
    head = head.set_column(table.schema.get_field_index("size"), "size", pa.array([sizes.tolist()], pa.list_(pa.int32())))
    shard = ranked_search.Shard(pa.concat_tables([table, head]), 3000, int(sizes.sum()))
    seen = []
    read = shard.read
    shard.read = lambda t, blocks=None: (seen.append(None if blocks is None else len(blocks)), read(t, blocks))[1]
    lists = np.arange(n)
    found, score = shard.top(lists, np.array([weights[t] for t in rows["term"].to_pylist()]), 20)
    assert len(found) >= 20 and set(found.tolist()) <= set(range(700, 730))
    assert all(s is None or s <= 30 // BLOCK + 2 for s in seen) and seen.count(None) == 1
