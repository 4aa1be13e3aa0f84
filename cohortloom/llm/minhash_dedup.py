"""Near-duplicate texts by MinHash with tensored banding, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm import texts
from cohortloom.llm.shared import components
from cohortloom.session import materialised

WIDTH = 5
COLLECTIONS = 12
HASHES = 3
THRESHOLD = 85
_SHIFT = np.uint64(12)  # shingles are 52-bit numbers, so that up to 4096 texts sort together with them
_PLACES = texts.mixed(np.arange(11, 11 + 2 * WIDTH, dtype=np.uint64)) | np.uint64(1)
_SEEDS = texts.mixed(np.arange(101, 101 + 64, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order, and their count for each text.

    A shingle is ``width`` words in a row, A-Z lower-cased; a text with fewer words has one, its whole sequence.
    """
    data, n = texts.lowered(data), len(offsets) - 1
    begin, end, text = texts.words(data, offsets)
    hashes = texts.spans_hash(data, begin, end)
    count = np.bincount(text, minlength=n)
    first = np.cumsum(count) - count
    size = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(n), size)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + first[owner]
    length = np.minimum(count[owner], width)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    total = length.astype(np.uint64) * _PLACES[WIDTH]
    for k in range(width):
        total += np.where(k < length, padded[at + k], np.uint64(0)) * _PLACES[k % WIDTH]
    keys = np.sort((owner.astype(np.uint64) << np.uint64(52)) | (texts.mixed(total) >> _SHIFT))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    owner = (keys >> np.uint64(52)).astype(np.int64)
    return keys & np.uint64((1 << 52) - 1), np.bincount(owner, minlength=n)


def digests(ids: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
    """Two 64-bit sums over each set; equal sets have equal sums."""
    some = count > 0
    start = (np.cumsum(count) - count)[some]
    out = {"d1": np.zeros(len(count), np.uint64), "d2": np.zeros(len(count), np.uint64)}
    if len(start):
        spread = texts.mixed(ids)
        out["d1"][some] = np.add.reduceat(spread, start)
        out["d2"][some] = np.add.reduceat(texts.mixed(spread + np.uint64(1)), start)
    return out


def bitmaps(ids: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
    """256 bits of each set in four numbers: each shingle turns one bit over. Two sets differ in at least as many
    shingles as their bitmaps in bits."""
    some = count > 0
    start = (np.cumsum(count) - count)[some]
    out = {f"b{k}": np.zeros(len(count), np.uint64) for k in range(4)}
    if len(start):
        spread = texts.mixed(ids + np.uint64(3))
        bit = np.uint64(1) << ((spread >> np.uint64(8)) & np.uint64(63))
        for k in range(4):
            out[f"b{k}"][some] = np.bitwise_xor.reduceat(np.where((spread & np.uint64(3)) == k, bit, np.uint64(0)), start)
    return out


def _signatures(collections: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts.flat(batch.column("text"))
            for i, j in texts.slices(offsets):
                here = offsets[i : j + 1] - offsets[i]
                ids, count = shingle_sets(data[offsets[i] : offsets[j]], here)
                some = count > 0
                start = (np.cumsum(count) - count)[some]
                out = digests(ids, count) | {f"c{c}": np.zeros(j - i, np.uint64) for c in range(collections)}
                if len(start):
                    spread = texts.mixed(ids)
                    for c in range(collections):
                        key = np.zeros(len(start), np.uint64)
                        for h in range(hashes):
                            x = spread * _SEEDS[c * hashes + h]
                            x ^= x >> np.uint64(29)
                            key = texts.mixed(key + np.minimum.reduceat(x * np.uint64(0xBF58476D1CE4E5B9), start))
                        out[f"c{c}"][some] = key
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id").slice(i, j - i), "n_shingles": pa.array(count.astype(np.int64))}
                    | {k: pa.array(v.view(np.int64)) for k, v in out.items()}
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = texts.flat(batch.column("text"))
        for i, j in texts.slices(offsets):
            ids, count = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            bounds = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {k: pa.array(v.view(np.int64)) for k, v in (digests(ids, count) | bitmaps(ids, count)).items()}
                | {"ids": pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.view(np.int64)))}
            )


def signatures(docs: DataFrame, collections: int = COLLECTIONS, hashes: int = HASHES) -> DataFrame:
    """Per row: doc_id, n_shingles, a digest of the shingle set (d1, d2) and a number for each collection."""
    kinds = ", ".join(f"{k} bigint" for k in ["doc_id", "n_shingles", "d1", "d2", *(f"c{c}" for c in range(collections))])
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(_signatures(collections, hashes), kinds)


def _tables(collections: int) -> Column:
    """The key of every pair of collections."""
    return F.array(*[F.xxhash64(F.lit(i), F.lit(j), f"c{i}", f"c{j}") for i, j in combinations(range(collections), 2)])


def _class() -> Column:
    """The number of a class of equal sets."""
    return F.xxhash64("d1", "d2").alias("rep")


def _similar(threshold: int, a: str = "ids_a", b: str = "ids_b") -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= threshold * (F.size(a) + F.size(b) - both)


def _sharing_rare(docs: DataFrame, threshold: int) -> DataFrame:
    """Pairs (rep, centre) of different parts among ``docs`` (rep, n_shingles, part, bitmaps, ids) that can be similar.

    Prefix filter: with shingles in one order, rarest first, two sets with similarity t share one of the first
    n - ceil(2t / (1 + t) n) + 1 of the smaller set (of both, if they have equal sizes) and of the first n - ceil(t n) + 1 of
    the larger one. What edits made is rare, so a copy edited too much shares none of them with any other. Of those
    that do, pairs go whose bitmaps differ in more bits than similar sets of their sizes can differ in shingles.
    """
    t, n = threshold / 100, F.col("n_shingles")
    bits = ["b0", "b1", "b2", "b3"]
    rows = docs.select("rep", "n_shingles", "part", *bits, F.explode("ids").alias("shingle"))
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("often", "shingle"))
    rows = rows.join(often, "shingle").withColumn("rank", rank)
    slack = 1e-9  # against rounding up what is whole
    rows = rows.withColumn("short", n - F.ceil(2 * t / (1 + t) * n - slack) + 1).where(F.col("rank") <= n - F.ceil(t * n - slack) + 1)
    small = rows.where("rank <= short").select("shingle", F.col("rep").alias("centre"), F.col("n_shingles").alias("size"), F.col("part").alias("of"), *[F.col(b).alias(f"of_{b}") for b in bits])
    apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"of_{b}"))) for b in bits), F.lit(0))
    large = rows.select("shingle", "rep", "n_shingles", "part", *bits, (F.col("rank") <= F.col("short")).alias("early"))
    return large.join(small, "shingle").where(
        "part <> of and (n_shingles > size or (n_shingles = size and early and rep > centre))"
    ).where((100 * F.col("size") >= threshold * n) & ((100 + threshold) * apart <= (100 - threshold) * (n + F.col("size"))))


def linked_classes(docs: DataFrame, classes: DataFrame, threshold: int, collections: int) -> DataFrame:
    """node, component: the components of similar classes, by their representatives.

    Members of a table's key are compared with one centre first; who is linked to it is of its component. A
    second round takes another centre in keys that still hold several components. For the members of keys that
    are open even then, the last round finds every pair of different components that shares one of its rarest
    shingles, without which two sets can't be similar. Each pair is confirmed on the full sets once. So a group
    of many near copies costs a few comparisons a copy, and pairs of the same component are not compared any more.
    """
    rows = classes.select("rep", "n_shingles", F.explode(_tables(collections)).alias("key"))
    shared = rows.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("key")
    members = materialised(rows.join(shared, "key"), "minhash-members")
    spark = docs.sparkSession
    wanted = classes.join(members.select("rep").distinct(), "rep").select("first_doc").distinct()
    own = docs.select(F.col("doc_id").cast("bigint"), "text").join(wanted, F.col("doc_id") == F.col("first_doc"), "left_semi")
    sets = own.select("text").mapInArrow(_sets, "d1 bigint, d2 bigint, b0 bigint, b1 bigint, b2 bigint, b3 bigint, ids array<bigint>")
    # rows that repeat a doc_id give a class several times
    sets = materialised(sets.select(_class(), "b0", "b1", "b2", "b3", "ids").dropDuplicates(["rep"]), "minhash-sets")
    links = spark.createDataFrame([], "u bigint, v bigint")
    tried = spark.createDataFrame([], "u bigint, v bigint")
    found = components(links, "minhash-links")
    for step in ("first", "second", "rest"):
        now = members.join(found, members.rep == found.node, "left").select(
            "key", "rep", "n_shingles", F.coalesce("component", "rep").alias("part"))
        order = F.struct((F.col("rep") if step == "first" else F.xxhash64("rep")).alias("by"), "rep", "n_shingles", "part")
        open_keys = now.groupBy("key").agg(
            F.min("part").alias("low"), F.max("part").alias("high"), F.min(order).alias("centre")).where("low <> high")
        if step == "rest":
            left = now.join(open_keys.select("key"), "key").groupBy("rep").agg(F.min("n_shingles").alias("n_shingles"), F.min("part").alias("part"))
            pairs = _sharing_rare(left.join(sets, "rep"), threshold)
        else:
            pairs = now.join(open_keys.select("key", F.col("centre.rep").alias("centre"), F.col("centre.n_shingles").alias("size"),
                                              F.col("centre.part").alias("of")), "key")
        pairs = pairs.where(
            (F.col("part") != F.col("of"))
            & (100 * F.least("n_shingles", "size") >= threshold * F.greatest("n_shingles", "size"))
        ).select(F.greatest("rep", "centre").alias("u"), F.least("rep", "centre").alias("v")).distinct()
        pairs = materialised(pairs.join(tried, ["u", "v"], "left_anti"), "minhash-pairs")
        confirmed = (
            pairs.join(sets.select(F.col("rep").alias("u"), F.col("ids").alias("ids_a")), "u")
            .join(sets.select(F.col("rep").alias("v"), F.col("ids").alias("ids_b")), "v")
            .where(_similar(threshold)).select("u", "v")
        )
        # what was joined before is one edge a node by now
        links = found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(confirmed)
        found = materialised(components(links, "minhash-links"), "minhash-found")
        tried = tried.union(pairs)
    return found


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, collections: int = COLLECTIONS, hashes: int = HASHES) -> DataFrame:
    """Group documents whose 5-word shingle sets have 100 * intersection >= ``threshold`` * union.

    Tensored banding: ``collections`` numbers of ``hashes`` minhashes each are computed, and every pair of
    them makes one table key, so 66 tables of six minhashes cost 36 minhashes. Two sets at similarity 0.85
    meet in no table with a probability of 0.0002. Equal sets are one class before any search, whatever
    their number; candidates are confirmed on full sets.

    Takes columns doc_id and text; others are ignored. Returns per row doc_id, n_shingles, component_id (smallest
    doc_id reachable, itself included), kept (doc_id = component_id). A null, empty or blank text has an empty set
    and is linked with nothing; a null doc_id keeps null and links nothing. Rows that repeat a doc_id are one node:
    each row is returned, with the component of the id (the links of all its texts count).
    """
    rows = materialised(signatures(docs, collections, hashes), "minhash-signatures")
    numbers = [f"c{c}" for c in range(collections)]
    usable = rows.where("n_shingles > 0 and doc_id is not null")
    classes = materialised(
        usable.groupBy(_class(), "n_shingles", *numbers).agg(F.min("doc_id").alias("first_doc")), "minhash-classes")
    joined = linked_classes(docs, classes, threshold, collections)
    groups = classes.join(joined, classes.rep == joined.node, "left").select(
        "rep", "first_doc", F.coalesce("component", "rep").alias("group"))
    heads = groups.groupBy("group").agg(F.min("first_doc").alias("head"))
    heads = groups.join(heads, "group").select("rep", "head")
    found = usable.select("doc_id", _class()).join(heads, "rep").select("doc_id", "head")
    found = materialised(found, "minhash-heads")
    # a doc_id with several texts joins their groups
    several = found.groupBy("doc_id").agg(F.min("head").alias("u"), F.max("head").alias("v")).where("u <> v").select("doc_id")
    bridges = components(found.join(several, "doc_id").select(F.col("doc_id").alias("u"), F.col("head").alias("v")), "minhash-bridges")
    found = found.groupBy("doc_id").agg(F.min("head").alias("head"))
    found = found.join(bridges, F.col("head") == F.col("node"), "left").select("doc_id", F.coalesce("component", "head").alias("component_id"))
    out = rows.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def one_of_each(docs: DataFrame, threshold: int = THRESHOLD, collections: int = COLLECTIONS) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id is the smallest of its group; rows without an id stay."""
    gone = near_duplicates(docs, threshold, collections).where("not kept").select(F.col("doc_id").alias("minhash_gone_id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("minhash_gone_id"), "left_anti")
