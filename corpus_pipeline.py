"""The corpus pipeline: each stage's rows are written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import line_dedup, minhash_dedup, mixing, pieces, quality
from cohortloom.llm.queries import PIECE_MODEL, SEED, SHARE, WEIGHTS, domain, table
from cohortloom.session import materialised

LEAST_SCORE = 0.5
NEAR = 80  # per cent of 5-word shingles that near copies share at least
NEAR_COLLECTIONS = 16  # of them a pair at 0.80 is missed with a probability of 0.0002


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score, from a network trained on all labels, is under ``LEAST_SCORE`` go; null texts score as empty ones."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(docs, quality.train(docs, labels), target="quality_stage_score")
    return scored.where(F.col("quality_stage_score") >= LEAST_SCORE).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats go, and with them documents of which nothing is left."""
    out = line_dedup.dedup_lines(docs, ("line_stage_lines", "line_stage_dropped"))
    return out.where("line_stage_dropped = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return minhash_dedup.one_of_each(docs, NEAR, NEAR_COLLECTIONS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that make up the weights of ``WEIGHTS``, none twice; the last one of a leaf ends where the budget does."""
    mixed = mixing.mix(docs, domain(), WEIGHTS, SHARE, epochs=1, seed=SEED)
    return mixing.taken_texts(docs, domain(), mixed)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ids, n_tokens (their number) and round_trip (whether they decode to the text again); columns of
    these names are replaced. The ids are written in between, so that a task never holds two Python workers with the model."""
    model = pieces.load(PIECE_MODEL)
    out = pieces.decode(materialised(pieces.encode(docs, model), "pipeline-ids"), model)
    return out.select(*[c for c in docs.columns if c not in ("ids", "n_tokens", "round_trip")], "ids", F.size("ids").cast("bigint").alias("n_tokens"),
                      F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"))


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("piece_encoding", to_pieces),
]

#: SQL can't express the network of the first stage or the Viterbi search of the last; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
