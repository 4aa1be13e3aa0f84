"""What several operators share: row numbers of batches, digests of ids, and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.session import materialised, shared_folder


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text (fold 0)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected ``edges`` (u, v): node, component (the smallest node reached).

    Alternating stars: in every round each node's neighbours are linked to the smallest one, first the
    larger neighbours, then the smaller ones, until every node has one edge, to a root. Only two-column edges are shuffled; a
    node with very many edges is counted by an aggregate and joined back, never gathered. Each round is
    written to the shared folder, so a lost executor costs one round at most. Nulls and loops are left out.
    """
    now = materialised(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u is not null and v is not null and u <> v").distinct(),
        name,
    )
    while not _all_stars(now):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialised(small.union(least.select("u", F.col("m").alias("v"))).distinct(), name)
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return roots.union(now.select(F.col("v"), F.col("v")).distinct())


def _all_stars(edges: DataFrame) -> bool:
    n, nodes = edges.agg(F.count("*"), F.count_distinct("u")).first()
    return n == nodes and edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Write ``df`` to the shared folder in as many buckets of ``key`` as there are shuffle partitions.

    A join on ``key`` then moves the other side only. The table's name leaves the catalog at once; its files stay.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    label = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", f"{shared_folder(spark)}/{label}").saveAsTable(label)
    out = spark.table(label)
    out.schema  # resolved while the name is known
    spark.sql(f"DROP TABLE {label}")
    return out
