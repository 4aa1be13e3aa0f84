"""Exact greatest inner products by a bit-sliced index: bitmaps of quantised components, added and searched bit by bit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
ROWS = 8192  # rows of a tile: bitmaps of a kilobyte
QUERIES = 512


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, an array of floor(scale * x) as long, of the vectors that take part.

    A vector that is null or empty, or holds a null or non-finite component, takes no part, nor does a null vec_id.
    """
    x = F.col("embedding")
    usable = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint"), "embedding").where(F.col("vec_id").isNotNull() & (F.size(x) > 0) & usable)
    return rows.select("vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))


def slices_of(values: np.ndarray) -> np.ndarray:
    """Bitmaps of non-negative ``values`` (rows, dimensions): [dimension, bit, word]; bit r of the words is row r."""
    bits = max(1, int(values.max(initial=0)).bit_length())
    rows = -(-values.shape[0] // 64) * 64
    planes = np.zeros((values.shape[1], bits, rows), np.uint8)
    for b in range(bits):
        planes[:, b, : values.shape[0]] = ((values >> b) & 1).T
    return np.packbits(planes, axis=2, bitorder="little").view(np.uint64)


def added(columns: list[list[np.ndarray]], words: int) -> np.ndarray:
    """The sum, bit by bit, of bitmaps: ``columns[w]`` holds stacks of bitmaps of weight 2**w.

    Full adders take three bitmaps of one weight to one of it and one of the next, until each weight has one.
    """
    out = []
    carried: list[list[np.ndarray]] = [list(c) for c in columns]
    w = 0
    while w < len(carried):
        stack = np.concatenate(carried[w]) if carried[w] else np.zeros((1, words), np.uint64)
        while len(stack) > 1:
            if w + 1 == len(carried):
                carried.append([])
            if len(stack) == 2:
                carried[w + 1].append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
                break
            m = len(stack) // 3
            a, b, c = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m]
            half = a ^ b
            carried[w + 1].append((a & b) | (c & half))
            stack = np.concatenate([half ^ c, stack[3 * m :]])
        out.append(stack[0])
        w += 1
    return np.stack(out)


def top_rows(score: np.ndarray, alive: np.ndarray, k: int) -> np.ndarray:
    """Bitmap of the rows in ``alive`` that can be among the ``k`` greatest, ties with the last one included.

    From the most significant slice downward: rows that are surely in, and candidates that equal the k-th so far.
    """
    sure, candidates = np.zeros_like(alive), alive.copy()
    for plane in score[::-1]:
        ones = candidates & plane
        n = int(np.bitwise_count(sure | ones).sum())
        if n >= k:
            candidates = ones
            if n == k:
                break
        else:
            sure |= ones
            candidates &= ~plane
    return sure | candidates


def search(ids: np.ndarray, values: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its id, and ids and scores of its ``k`` best rows other than its own."""
    low = values.min(axis=0)
    shifted = values - low
    planes = slices_of(shifted)
    words = planes.shape[2]
    everyone = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view(np.uint64)
    turned = ~planes & everyone  # of 2**bits - 1 - shifted, for negative factors
    for query_id, query in zip(query_ids, queries, strict=True):
        columns: list[list[np.ndarray]] = [[] for _ in range(planes.shape[1] + max(1, int(np.abs(query).max(initial=0)).bit_length()))]
        for q in range(int(np.abs(query).max(initial=0)).bit_length()):
            for source, part in ((planes, query > 0), (turned, query < 0)):
                own = source[part & ((np.abs(query) >> q) & 1 > 0)]
                for b in range(planes.shape[1]):
                    if len(own):
                        columns[q + b].append(own[:, b])
        alive = everyone.copy()
        for r in np.flatnonzero(ids == query_id):
            alive[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        found = np.flatnonzero(np.unpackbits(top_rows(added(columns, words), alive, k).view(np.uint8), bitorder="little"))
        exact = values[found] @ query  # the boundary is resolved on the integers themselves
        best = np.lexsort((ids[found], -exact))[:k]
        yield query_id, ids[found][best], exact[best]


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = SCALE) -> DataFrame:
    """The ``k`` greatest integer inner products of each query with all rows but its own: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id ``every`` divides. Components become floor(scale * x); ties go to the smaller
    vec_id. Vectors of another length than the query's are no candidates; rows that repeat a vec_id are candidates each,
    but for a query of that id. A query id with several different vectors gets the k best over all of them.

    Rows and queries are cut into tiles of bounded size by hashes of their ids; each pair of a row tile and a query
    tile is one group, in which the index is built and searched, so that a task holds one tile of each. Only the
    k best of each query and tile are shuffled again. Sums must fit in 64 bits, or an error is raised.
    """
    rows = quantised(vectors, scale)
    n = rows.count()
    spread, per = -(-n // ROWS) or 1, -(-n // (every * QUERIES)) or 1
    place = lambda tiles: F.pmod(F.xxhash64("vec_id", "v"), F.lit(tiles)).cast("int")
    several = lambda tiles: F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    dims = F.size("v").alias("dims")
    left = rows.select(dims, place(spread).alias("tile"), several(per).alias("part"), "vec_id", "v")
    asked = rows.where(F.col("vec_id") % every == 0).distinct()
    right = asked.select(dims, several(spread).alias("tile"), place(per).alias("part"), "vec_id", "v")

    def run(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(queries):
            values, asked = np.stack(own["v"].to_list()), np.stack(queries["v"].to_list())
            if float(np.abs(values).max()) * float(np.abs(asked).max()) * values.shape[1] >= 2**62:
                raise ArithmeticError("inner products may pass 64 bits")
            for query_id, ids, scores in search(own["vec_id"].to_numpy(), values, queries["vec_id"].to_numpy(), asked, k):
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    keys = ["dims", "tile", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
