"""Rank-order profiles against a plain version, and held-out accuracy."""

from collections import Counter

import numpy as np
import pyarrow as pa

from cohortloom.llm import language, texts
from cohortloom.llm.queries import op1_language


def plain_counts(text):
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "").split()
    out = Counter()
    for w in words:
        for n in (1, 2, 3):
            out.update(g for k in range(len(w) + 3 - n) if (g := f" {w} "[k : k + n]).strip())
    return out


def test_counts_match_plain_version():
    rows = ["The cat, the HAT", None, "", "123 !!", "a", "É-é ßx", "x  y\nz", "日本 語", "İx", "no"]
    data, offsets = texts.flat(pa.array(rows, pa.string()))
    text, gram, count = language.ngrams(data, offsets)
    for i, row in enumerate(rows):
        want = plain_counts(row)
        assert sorted(count[text == i].tolist()) == sorted(want.values()), row
    assert len(set(gram[text == 0]) & set(gram[text == 9])) == 0 + len(plain_counts(rows[0]).keys() & plain_counts("no").keys())


def test_distances_match_plain_version(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([
        ("the thing is there then", "en"), ("der die das und", "de"), ("le la les des une", "fr"), ("der Hund", None), ("then they", None), ("des", "fr")])]
    profiles = language.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert profiles.languages == ["de", "en", "fr"]
    plain = {lang: sum((plain_counts(t) for _, t, x in rows if x == lang), Counter()) for lang in profiles.languages}
    for k, lang in enumerate(profiles.languages):
        assert (profiles.ranks[:, k] < language.PROFILE).sum() == len(plain[lang])
    best, clear = profiles.predict(*texts.flat(pa.array(["die Hunde", "they think", "les unes", "", "42"])))
    assert best.tolist() == [0, 1, 2, -1, -1] and (clear[:3] > 0.5).all() and clear[3:].tolist() == [0, 0]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op1_language(spark, folder).where("held_out").collect()
    assert sum(truth[r.doc_id] == r.lang_pred for r in rows) / len(rows) > 0.95


def test_odd_rows(spark):
    rows = [(1, None, "en"), (1, None, None), (2, "", "en"), (None, "the " * 100_000, "en"), (3, "the", None), (4, "999", "de")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "'x' as gram", "1 as score", "2 as lang_pred")
    got = language.predict(docs, language.learn(docs)).collect()
    assert sorted(((r.doc_id, r.lang_pred, r.score) for r in got), key=str) == sorted(
        [(1, "und", 0.0), (1, "und", 0.0), (2, "und", 0.0), (None, "en", 1.0), (3, "en", 1.0), (4, "und", 0.0)], key=str)
    none = language.learn(docs.limit(0))
    assert none.languages == [] and language.predict(docs.limit(0), none).collect() == []
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}
    assert np.isfinite([r.score for r in got]).all()
