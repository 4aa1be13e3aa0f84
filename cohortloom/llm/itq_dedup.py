"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and a check on the vectors themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.shared import components
from cohortloom.session import materialised

LEAST_COSINE = 0.98
SAMPLE_ROWS = 20_000  # most vectors that the rotation is learned from
BITS = 64
PART = 16  # bits of a substring, one table for each
TILE = 1024  # members of a bucket that one tile takes from either side
_SMALL = 48


def rotation(sample: np.ndarray, bits: int = BITS, rounds: int = 40, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions, bits) of iterative quantisation: principal axes, turned so that the signs of the
    projected sample lie as near to it as a rotation can bring them."""
    bits = min(bits, sample.shape[1])
    mean = sample.mean(axis=0)
    axes = np.linalg.svd(np.cov((sample - mean).T).reshape(sample.shape[1], -1) if len(sample) > 1 else np.eye(sample.shape[1]))[0][:, :bits]
    flat = (sample - mean) @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
        turn = (u @ v).T
    return mean, axes @ turn


def _usable() -> Column:
    x = F.col("embedding")
    return F.col("label").isNotNull() & (F.size(x) > 0) & F.coalesce(
        F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(x, lambda e: e != 0), F.lit(False))


def learned(classes: DataFrame, rows: int = SAMPLE_ROWS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and projection for each length of vectors, from the ``rows`` vectors in all with the smallest class numbers."""
    found: dict[int, list] = {}
    for r in classes.orderBy("cls").limit(rows).select("v").collect():
        found.setdefault(len(r.v), []).append(r.v)
    out = {}
    for n, vectors in found.items():
        out[n] = rotation(_unit(np.array(vectors, np.float64)))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def coded(classes: DataFrame, models: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Columns cls, group, copies, v of ``classes`` and code, 64 signs of the projected vector. A length that the sample lacks
    has the signs of its first components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v").to_pylist()
            code = np.zeros(len(lists), np.uint64)
            sizes = np.array([len(v) for v in lists])
            for n in np.unique(sizes):
                here = np.flatnonzero(sizes == n)
                x = _unit(np.array([lists[i] for i in here], np.float64))
                mean, axes = models.get(int(n), (np.zeros(n), np.eye(n)[:, :BITS]))
                bits = (x - mean) @ axes >= 0
                code[here] = (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.view(np.int64))], names=[*batch.schema.names, "code"])

    return classes.mapInArrow(run, "cls bigint, group bigint, copies bigint, v array<double>, code bigint")


def memberships(codes: DataFrame) -> DataFrame:
    """cls, table, spot, side, bucket: the buckets of each code in the multi-index tables.

    Two codes meet where a 16-bit substring is equal (spot 16), or equal but for the bit at ``spot``, which is 0 in
    one (side 0) and 1 in the other (side 1).
    """
    tables = BITS // PART
    part = F.expr(f"shiftrightunsigned(code, `table` * {PART})").bitwiseAND(F.lit((1 << PART) - 1))
    rows = codes.select("cls", "group", "code", F.explode(F.array(*[F.lit(t) for t in range(tables)])).alias("table"))
    rows = rows.select("cls", "group", "table", part.alias("part"), F.explode(F.array(*[F.lit(s) for s in range(PART + 1)])).alias("spot"))
    mask = F.when(F.col("spot") < PART, F.expr("shiftleft(1L, spot)")).otherwise(F.lit(0).cast("bigint"))
    side = F.when(F.col("part").bitwiseAND(mask) != 0, 1).otherwise(0)
    return rows.select("cls", "table", "spot", side.alias("side"),
                       F.xxhash64("group", "table", "spot", F.col("part").bitwiseAND(F.bitwise_not(mask))).alias("bucket"))


def _far_before(x: np.ndarray, y: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether codes differ in two bits or more in each substring before ``table``: the pair was met in no table so far."""
    out = np.ones(np.broadcast_shapes(x.shape, y.shape), bool)
    apart = x ^ y
    for t in range(BITS // PART - 1):
        near = np.bitwise_count((apart >> np.uint64(PART * t)) & np.uint64((1 << PART) - 1)) < 2
        out &= ~(near & (t < table))
    return out


class _Tiles:
    """Takes sorted rows of tiles and gives links: cls, root (least class that the tile's links join it to), links."""

    def __init__(self, least: float):
        self.least, self.out = least, []

    def pairs(self, a: np.ndarray, b: np.ndarray, rows: dict[str, np.ndarray]) -> None:
        """Rows a[i] against b[i], each pair emitted alone."""
        keep = _far_before(rows["code"][a], rows["code"][b], rows["table"][a])
        a, b = a[keep], b[keep]
        keep = np.einsum("ij,ij->i", rows["unit"][a], rows["unit"][b]) >= self.least
        a, b = a[keep], b[keep]
        low = np.minimum(rows["cls"][a], rows["cls"][b])
        self.out += [(rows["cls"][a], low, rows["copies"][b]), (rows["cls"][b], low, rows["copies"][a])]

    def block(self, a: np.ndarray, b: np.ndarray, rows: dict[str, np.ndarray]) -> None:
        """All rows of a against all of b (or those after it, if they are the same)."""
        near = rows["unit"][a] @ rows["unit"][b].T >= self.least
        near &= _far_before(rows["code"][a][:, None], rows["code"][b][None, :], rows["table"][a[0]])
        if a is b:
            np.fill_diagonal(near, False)
        left, right = rows["cls"][a].copy(), rows["cls"][b].copy()
        most = np.iinfo(np.int64).max
        while True:
            new_left = np.minimum(left, np.where(near, right[None, :], most).min(axis=1))
            new_right = np.minimum(right, np.where(near, new_left[:, None], most).min(axis=0))
            if a is b:
                new_left = new_right = np.minimum(new_left, new_right)
            if (new_left == left).all() and (new_right == right).all():
                break
            left, right = new_left, new_right
        some = near.any(axis=1)
        self.out.append((rows["cls"][a][some], left[some], (near @ rows["copies"][b])[some]))
        if a is not b:
            some = near.any(axis=0)
            self.out.append((rows["cls"][b][some], right[some], (near.T @ rows["copies"][a])[some]))

    def take(self, rows: dict[str, np.ndarray]) -> None:
        """Whole tiles: runs of equal tile number."""
        tile = rows["tile"]
        bounds = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1], [True]]))
        size = np.diff(bounds)
        small = size <= _SMALL
        begin, size_small = bounds[:-1][small], size[small]
        first = np.repeat(np.arange(len(size_small)), size_small * size_small)
        nth = np.arange(len(first)) - np.repeat(np.cumsum(size_small * size_small) - size_small * size_small, size_small * size_small)
        a, b = begin[first] + nth // size_small[first], begin[first] + nth % size_small[first]
        role = rows["role"]
        keep = ((role[a] == 0) & (role[b] == 1)) | ((role[a] == 2) & (role[b] == 2) & (a < b))
        self.pairs(a[keep], b[keep], rows)
        for k in np.flatnonzero(~small):
            here = np.arange(bounds[k], bounds[k + 1])
            if role[here[0]] == 2:
                self.block(here, here, rows)
            elif (role[here] == 0).any() and (role[here] == 1).any():
                self.block(here[role[here] == 0], here[role[here] == 1], rows)

    def given(self) -> pa.RecordBatch:
        parts = self.out or [(np.zeros(0, np.int64),) * 3]
        self.out = []
        arrays = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["cls", "root", "links"])


def _linked(least: float):
    names = ["tile", "role", "table", "cls", "copies", "code"]

    def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        rows = {c: batch.column(c).to_numpy() for c in names}
        rows["code"] = rows["code"].view(np.uint64)
        lists = batch.column("v")
        flat = lists.flatten().to_numpy()
        width = np.diff(lists.offsets.to_numpy())
        unit = np.zeros((len(width), width.max(initial=1)))
        unit[np.repeat(np.arange(len(width)), width), np.arange(len(flat)) - np.repeat(np.cumsum(width) - width, width)] = flat
        rows["unit"] = _unit(unit) if len(width) else unit
        return rows

    def joined(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        width = max(a["unit"].shape[1], b["unit"].shape[1])
        wide = lambda u: np.pad(u, ((0, 0), (0, width - u.shape[1])))
        return {c: np.concatenate([a[c], b[c]]) if c != "unit" else np.concatenate([wide(a[c]), wide(b[c])]) for c in a}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tiles = None, _Tiles(least)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                new = columns(batch.slice(at, 4096))
                held = joined(held, new) if held is not None else new
                cut = np.flatnonzero(held["tile"] != held["tile"][-1])  # the last tile may go on in the next rows
                if len(cut):
                    tiles.take({c: x[: cut[-1] + 1] for c, x in held.items()})
                    held = {c: x[cut[-1] + 1 :] for c, x in held.items()}
                    yield tiles.given()
        if held is not None:
            tiles.take(held)
            yield tiles.given()

    return run


def class_links(codes: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """cls, root, links: by tile, how many rows each class of ``codes`` is linked with, and a class of its component.

    A pair counts in the first table where it meets. Buckets are cut into tiles of bounded size: members are
    spread over chunks, and each pair of chunks is a tile, so that a bucket with a third of all rows is many tasks.
    """
    met = memberships(codes)
    counts = met.groupBy("bucket").agg(
        F.count("*").alias("n"), (F.min("side") != F.max("side")).alias("crossed"), F.max("spot").alias("spot"))
    counts = counts.where(f"n > 1 and (crossed or spot = {PART})").select("bucket", F.ceil(F.col("n") / TILE).cast("int").alias("chunks"))
    met = met.join(counts, "bucket")
    own = F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    even = F.col("spot") == PART
    role = F.when(~even, F.col("side")).when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(2)
    first = F.when(role == 1, F.col("other")).otherwise(F.col("own"))
    second = F.when(role == 1, F.col("own")).otherwise(F.col("other"))
    met = met.select("cls", "table", role.cast("int").alias("role"), F.xxhash64("bucket", first, second).alias("tile"))
    rows = met.join(codes.select("cls", "copies", "code", "v"), "cls").select("tile", "role", "table", "cls", "copies", "code", "v")
    rows = rows.repartition("tile").sortWithinPartitions("tile")
    return rows.mapInArrow(_linked(least), "cls bigint, root bigint, links bigint")


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label; others are ignored).

    Rows of one label whose vectors have a cosine of ``least`` or more are linked. Candidates are pairs whose 64-bit codes,
    from a rotation learned on a bounded sample, agree in a 16-bit substring but for one bit at most; the
    cosine in double precision decides, so that no pair below ``least`` is linked. At a cosine of just 0.98 about 97 of
    a hundred pairs are found, nearer ones more surely.

    Equal vectors of a label are one class: its copies are linked without being paired. A label or vector that
    is null, a zero vector, or one with null or non-finite components links with nothing; vectors of
    different lengths don't link. Rows that repeat a vec_id count as vectors each. A null vec_id has links, but no component.
    """
    cls = F.xxhash64("label", F.col("embedding").cast("array<double>"))
    rows = vectors.select("vec_id", "label", "embedding").withColumn("cls", F.when(_usable(), cls))
    classes = rows.where("cls is not null").groupBy("cls").agg(
        F.xxhash64(F.first("label"), F.size(F.first("embedding"))).alias("group"), F.count("*").alias("copies"),
        F.first("embedding").cast("array<double>").alias("v"))
    classes = materialised(classes, "itq-classes")
    codes = materialised(coded(classes, learned(classes)), "itq-codes")
    found = materialised(class_links(codes, least).groupBy("cls", "root").agg(F.sum("links").alias("links")), "itq-links")
    joined = components(found.select(F.col("cls").alias("u"), F.col("root").alias("v")), "itq-components")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    per_class = rows.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    per_class = per_class.join(joined, per_class.cls == joined.node, "left").select(
        "cls", "least_id", "copies", F.coalesce("component", "cls").alias("component"))
    heads = per_class.groupBy("component").agg(F.min("least_id").alias("component_id"))
    per_class = per_class.join(heads, "component").join(links, "cls", "left").select(
        F.col("cls").alias("of"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(per_class, F.col("cls") == F.col("of"), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      (F.col("vec_id") == component).alias("kept"))
