"""Pieces: brute-force best segmentation and exact round trips."""

import random

import numpy as np
import pyarrow as pa

from cohortloom.llm import pieces, texts
from cohortloom.llm.queries import PIECE_MODEL


def brute(table, model, text):
    """Best ids of one text, over the whole text, without units."""
    if not text:
        return []
    points = "▁" + text.replace("▁", "\U0010ffff").replace(" ", "▁")
    best, back = [0.0] + [None] * len(points), [None] * (len(points) + 1)
    for j in range(1, len(points) + 1):
        for i in range(max(0, j - model.longest), j):
            known = table.get(points[i:j])
            if known or i == j - 1:
                now = best[i] + (known[1] if known else model.unknown_score)
                if best[j] is None or now > best[j]:
                    best[j], back[j] = now, (i, known)
    out, j = [], len(points)
    while j:
        i, known = back[j]
        code = points[i:j].replace("\U0010ffff", "▁").encode()
        out = ([known[0]] if known else [int(model.byte_ids[b]) for b in code]) + out
        j = i
    return out


def encoded(model, rows):
    data, offsets = texts.flat(pa.array(rows, pa.string()))
    encoder = pieces.Encoder(model)
    ids, count = encoder.encode(data, offsets)
    again, _ = encoder.encode(data, offsets)
    assert (ids == again).all()
    back, at = pieces.decoded(model, ids, count)
    assert [back[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)] == rows
    return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]


def test_matches_brute_force_on_small_vocabulary():
    rng = random.Random(4)
    words = sorted({"▁", "▁a", "ab", "a", "b", "é", "▁▁", "abé", "b▁", "▁ab", *("".join(rng.choice("abé▁") for _ in range(rng.randrange(1, 5))) for _ in range(20))})
    words = [w for w in words if "▁" not in w.lstrip("▁")]
    listed = [("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), *((w, -float(rng.randrange(1, 9))) for w in words)]
    model = pieces.model_of(listed, list(range(1, 257)), {0})
    table = {w: (i, s) for i, (w, s) in enumerate(listed) if i > 256}
    rows = ["".join(rng.choice("abé  \n▁x😀") for _ in range(rng.randrange(12))) for _ in range(300)] + ["", " ", "ab" * 400]
    assert encoded(model, rows) == [brute(table, model, r) for r in rows]


def test_matches_brute_force_on_the_public_model():
    import sentencepiece

    model = pieces.load(PIECE_MODEL)
    reader = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    table = {reader.id_to_piece(i): (i, reader.get_score(i)) for i in range(259, reader.get_piece_size())}
    rows = ["Hello  world", "", " a ", "a\tb\n", "▁x", "ﬁ①é", "日本 中文 😀", "Eauouon.\nEnpaeux leaux le ouè", "antidisestablishmentarianism" * 3, "x" * 5000]
    got = encoded(model, rows)
    assert got == [brute(table, model, r) for r in rows]
    # the library gives ids that stand for the same text
    assert [reader.decode(x) for x, r in zip(got, rows, strict=True) if "▁" not in r] == [r for r in rows if "▁" not in r]


def test_rows_of_a_table(spark):
    rows = [(1, "One two", "x"), (1, "One two", "x"), (None, None, None), (2, "", "y"), (3, "é\n" * 30_000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").selectExpr("*", "'q' as decoded")
    model = pieces.load(PIECE_MODEL)
    out = pieces.decode(pieces.encode(df, model), model)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = out.collect()
    assert all(r.decoded == r.text for r in got)
    first, second = [r.ids for r in got if r.doc_id == 1]
    assert first == second and len(first) > 0
    assert {r.doc_id: r.ids for r in got}[2] == [] and {r.doc_id: r.ids for r in got}[None] is None
    assert pieces.encode(df.limit(0), model).collect() == []
    ids = spark.createDataFrame([([3 + 0xC3],)], "ids array<int>")
    assert pieces.decode(ids, model).first().decoded == ""
