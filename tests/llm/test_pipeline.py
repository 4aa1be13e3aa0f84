"""Each stage of the pipeline against SQL or brute force over its own input."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from cohortloom.llm import pieces, quality
from cohortloom.llm.queries import PIECE_MODEL, line_dedup_sql, mixing_sql, near_duplicates_sql

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def net(spark):
    """One network for the stage and for the test: training rounds differently from run to run."""
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").selectExpr("doc_id", "quality as label")
    net = quality.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality, "train", lambda *_: net)
        yield net


@pytest.fixture(scope="module")
def stages(spark, net):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialised(stage(spark, docs, FOLDER), f"test-{name}")
        out.append((docs.toPandas(), after.toPandas()))
        docs = after
    return out


def sql(before, text):
    con = duckdb.connect()
    con.register("before", before)
    con.execute("CREATE TABLE d AS SELECT doc_id, text, lang, source, n_chars FROM before")
    return con.sql(text).fetchall()


def rows(frame, columns):
    return sorted(map(tuple, frame[columns].itertuples(index=False)))


def test_quality(stages, net):
    before, after = stages[0]
    assert list(after.columns) == COLUMNS and 0 < len(after) < len(before)
    one = lambda t: quality.probabilities(net, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    assert set(after.doc_id) == {i for i, t in zip(before.doc_id, before.text, strict=True) if one(t) >= corpus_pipeline.LEAST_SCORE}


def test_line_dedup(stages):
    before, after = stages[1]
    want = sql(before, f"WITH {line_dedup_sql('d')} SELECT doc_id, text FROM rest WHERE n_dropped = 0 OR regexp_matches(text, '[^\\x20\\x09-\\x0D]')")
    assert list(after.columns) == COLUMNS and rows(after, ["doc_id", "text"]) == sorted(want)
    assert (after.n_chars == after.text.str.len()).all()


def test_near_duplicates(stages):
    before, after = stages[2]
    want = sql(before, f"WITH RECURSIVE {near_duplicates_sql('d', threshold=80)} SELECT d.* FROM d JOIN near USING (doc_id) WHERE doc_id = component_id")
    assert list(after.columns) == COLUMNS and rows(after, COLUMNS) == sorted(want)


def test_near_duplicates_from_0_80_on(spark):
    words = [f"w{i}" for i in range(104)]
    edited = ["x" if i in (20, 60) else w for i, w in enumerate(words)]  # 90 of 110 shingles: 0.82
    other = ["x" if i in (20, 60, 80) else w for i, w in enumerate(words)]  # 85 of 115 with the first, 95 of 105 with the second
    for texts, kept in (([words, edited], {0}), ([words, other], {0, 1}), ([words, edited, other], {0})):
        docs = spark.createDataFrame([(i, " ".join(t), "en", "src1", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).collect()} == kept


def test_mixing(stages):
    before, after = stages[3]
    want = {r[0]: r[1] for r in sql(before, f"WITH {mixing_sql('d', 1)} SELECT doc_id, taken FROM mixed")}
    assert list(after.columns) == COLUMNS and set(after.doc_id) == set(want) and 0 < len(after) < len(before)
    whole = dict(zip(before.doc_id, before.text, strict=True))
    for i, text in zip(after.doc_id, after.text, strict=True):
        assert text.split() == whole[i].split()[: want[i]] and whole[i].startswith(text)


def test_pieces(stages):
    before, after = stages[4]
    assert rows(after, COLUMNS) == rows(before, COLUMNS) and after.round_trip.all()
    encoder = pieces.Encoder(pieces.load(PIECE_MODEL))
    for text, ids, n in zip(after.text, after.ids, after.n_tokens, strict=True):
        data = np.frombuffer(text.encode(), np.uint8)
        assert encoder.encode(data, np.array([0, len(data)]))[0].tolist() == list(ids) and n == len(ids)


def test_a_task_of_the_last_stage_runs_one_python_function(spark):
    docs = spark.createDataFrame([(1, "one text"), (2, None)], "doc_id bigint, text string")
    out = corpus_pipeline.to_pieces(spark, docs, None)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.doc_id, r.round_trip) for r in out.collect()) == [(1, True), (2, True)]


def test_run_gives_the_last_stage(stages, spark):
    assert rows(corpus_pipeline.run(spark, FOLDER).toPandas(), COLUMNS) == rows(stages[-1][1], COLUMNS)


def test_stages_keep_columns_with_clashing_names(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(20).selectExpr(
        "*", "1 as score", "2 as n_dropped", "3 as minhash", "4 as row", "5 as domain", "6 as taken", "7 as component_id", "8 as decoded")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == docs.columns, name
        assert {(r.score, r.n_dropped, r.row, r.domain, r.taken, r.component_id) for r in after.collect()} == {(1, 2, 4, 5, 6, 7)}, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs.withColumn("ids", docs.doc_id), FOLDER)
    assert last.where("round_trip").count() == 20


def test_odd_rows(spark, tmp_path):
    docs = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "x", 0), (None, "a b c", "en", "src1", 5), (3, "word " * 30_000, "en", "src1", 1)]
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    labels = "doc_id bigint, quality int, toxic int"
    for n, rows_ in (("odd", docs), ("none", [])):
        spark.createDataFrame(rows_, kinds).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        spark.createDataFrame([], labels).write.parquet(f"{tmp_path}/{n}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{n}").collect()
        assert all(r.round_trip for r in got) and (len(got) > 0) == (n == "odd")
