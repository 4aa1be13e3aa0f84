"""The convolutional network: held-out accuracy, gradients, whole texts and odd rows."""

import tracemalloc

import numpy as np

from cohortloom.llm import quality, texts
from cohortloom.llm.queries import op5_quality


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op5_quality(spark, folder).where("held_out").collect()
    known = [(labels[r.doc_id], r.predicted) for r in rows if r.doc_id in labels]
    assert sum(a == b for a, b in known) / len(known) > 0.96
    assert sum(b for a, b in known if a) / sum(a for a, _ in known) > 0.98
    sizes = {r.doc_id: r.n for r in spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", "octet_length(text) as n").collect()}
    long = [labels[r.doc_id] == r.predicted for r in rows if r.doc_id in labels and (sizes[r.doc_id] or 0) > 6144]
    assert len(long) > 50 and sum(long) / len(long) > 0.96


def test_gradients_match_differences():
    net = quality.Network.start(1)
    for x in net.parts():
        x += np.random.default_rng(0).standard_normal(x.shape).astype(np.float32) * 0.05
    data = np.random.default_rng(2).integers(0, 256, 3000).astype(np.uint8)
    offsets, label, weight = np.array([0, 1200, 1200, 3000]), np.array([1, 0, 0], np.float32), np.array([1, 2, 1], np.float32)

    def loss():
        p = np.clip(quality.probabilities(net, data, offsets), 1e-9, 1 - 1e-9)
        return float((weight * -(label * np.log(p) + (1 - label) * np.log(1 - p))).sum() / 3)

    grads = quality._gradients(net, data, offsets, label, weight)
    for x, g in zip(net.parts(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        x[at] += 1e-3
        high = loss()
        x[at] -= 2e-3
        low = loss()
        x[at] += 1e-3
        assert abs((high - low) / 2e-3 - g[at]) < 0.05 * abs(g[at]) + 1e-4


def plain(net, text):
    """The probability by its definition: filters at every second byte, the best in each chunk, mean and maximum of chunks."""
    cells = -(-(len(text) + 8) // 64)
    padded = text + bytes(cells * 64 + 8 - len(text))
    embedded = [net.embedding[b].astype(float) for b in padded]
    response = [sum((embedded[i + k] @ net.filters[k * 6 : k * 6 + 6].astype(float) for k in range(8)), np.zeros(24)) for i in range(0, cells * 64 - 6, 2)]
    chunks, at = [], 0
    while True:
        end = min(at + 8, cells)
        chunks.append(np.maximum(np.max(response[at * 32 : end * 32], axis=0) + net.bias, 0))
        if end == cells:
            break
        at += 7
    z = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]) @ net.top + net.shift[0]
    return 1 / (1 + np.exp(-z))


def test_matches_plain_convolution(monkeypatch):
    net, rng = quality.Network.start(4), np.random.default_rng(5)
    cases = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 55, 56, 57, 120, 448, 504, 505, 600, 3000, 5001)]
    data, offsets = np.frombuffer(b"".join(cases), np.uint8), np.cumsum([0, *map(len, cases)])
    expected = [plain(net, c) for c in cases]
    label, weight = np.arange(len(cases)) % 2, np.ones(len(cases), np.float32)
    whole = quality._gradients(net, data, offsets, label.astype(np.float32), weight)
    for most in (1024, 7, 1):
        monkeypatch.setattr(quality, "SLICE", most)
        assert np.allclose(quality.probabilities(net, data, offsets), expected, rtol=1e-4)
        for x, y in zip(whole, quality._gradients(net, data, offsets, label.astype(np.float32), weight), strict=True):
            assert np.allclose(x, y, rtol=1e-3, atol=1e-6)


def test_memory_of_a_long_text():
    net, data = quality.Network.start(3), np.full(16 << 20, 101, np.uint8)
    tracemalloc.start()
    quality.probabilities(net, data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 << 20


def test_texts_that_exceed_the_sample_are_left_out_whole(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "ab" * (50 if i % 5 else 5000)) for i in range(40)] + [(40, None), (1, "a")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(41)], "doc_id bigint, label int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda samples, share: seen.extend(samples))
    quality.train(docs, labels, size=2000)
    assert sorted(seen) == sorted([(b"", 0), (b"a", 1)] + [(b"ab" * 50, i % 2) for i in range(40) if i % 5 and i != 1])


def test_every_chunk_counts():
    net = quality.Network.start(3)
    blank = np.full(20_000, 32, np.uint8)
    plain = quality.probabilities(net, blank, np.array([0, 20_000]))[0]
    for at in (0, 6000, 12_345, 19_980):
        changed = blank.copy()
        changed[at : at + 20] = np.arange(60, 80)
        assert quality.probabilities(net, changed, np.array([0, 20_000]))[0] != plain


def test_neighbours_do_not_matter():
    net = quality.Network.start(3)
    data = np.random.default_rng(2).integers(1, 256, 4000).astype(np.uint8)
    cuts = np.array([0, 57, 121, 121, 185, 700, 764, 4000])
    alone = [quality.probabilities(net, data[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    assert np.allclose(quality.probabilities(net, data, cuts), alone, rtol=1e-5)


def test_odd_rows_and_no_labels(spark):
    rows = [(1, None, "s"), (1, None, "s"), (2, "", "s"), (None, "x" * 500_000, "s"), (3, "abc", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    none = spark.createDataFrame([], "doc_id bigint, label int")
    got = quality.score(docs, quality.train(docs, none))
    assert got.columns == ["doc_id", "text", "score"] and [r.score for r in got.collect()] == [0.5] * 5
    ones = spark.createDataFrame([(1, 1), (1, 0), (7, 1), (None, 0), (3, None)], "doc_id bigint, label int")
    assert all(r.score > 0.9 for r in quality.score(docs, quality.train(docs, ones)).collect())
    assert quality.score(docs.limit(0), quality.train(docs, none)).collect() == []
    assert texts.flat(__import__("pyarrow").array([None, "é"]))[1].tolist() == [0, 0, 2]
