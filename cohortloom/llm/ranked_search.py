"""Ranked lexical search by Block-Max MaxScore over compressed posting lists of document shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm import texts
from cohortloom.operators.skew import running_total
from cohortloom.session import materialised

SHARD_BYTES = 8 << 20
SHARD_ROWS = 1 << 16
BLOCK = 64  # postings of a block
BATCH = 1 << 17  # pairs of item and term that are searched together
FILTER_BITS = 23
_INSIDE = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_INDEX = ("shard bigint, term string, n bigint, last array<int>, at array<int>, ends array<int>, freq array<int>, "
          "size array<int>, data binary, ids array<bigint>")


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text number of every term: letters and digits, and all that is not ASCII."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _INSIDE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begin = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return begin, end, np.searchsorted(offsets, begin, "right") - 1


def _strings(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[texts.runs(begin, length)])))


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values).cast(kind))


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the last byte of a number below 128; the bytes, and where each number begins."""
    n = np.ones(len(values), np.int64)
    for k in range(1, 5):
        n += values >= 1 << (7 * k)
    start = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for k in range(int(n.max(initial=0))):
        some = n > k
        out[start[some] + k] = ((values[some] >> (7 * k)) & 127) | np.where(n[some] > k + 1, 128, 0)
    return out, start


def unpacked(data: np.ndarray) -> np.ndarray:
    last = data < 128
    start = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(start, np.diff(np.concatenate([start, [len(data)]])))
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), start)


def postings(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None) -> tuple[dict[str, pa.Array], np.ndarray]:
    """The posting lists of some texts, one row a term, and the number of terms of each text.

    A list holds blocks of gaps and frequencies in packed bytes (``data``, block k from byte ``at[k]`` on). Of each block
    there is the last text (``last``) and what can score best in it whatever the statistics of the corpus are: the pairs of
    frequency and text size that no other posting of the block beats in both (``freq``, ``size`` up to ``ends[k]``).
    """
    data = texts.lowered(data)
    begin, end, text = spans(data, offsets)
    sizes = np.bincount(text, minlength=len(offsets) - 1)
    hashes = texts.spans_hash(data, begin, end)
    if wanted is not None:
        bit = hashes & np.uint64((1 << FILTER_BITS) - 1)
        keep = (wanted[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
        begin, end, text, hashes = begin[keep], end[keep], text[keep], hashes[keep]
    order = np.argsort(hashes, kind="stable")
    hashes, doc = hashes[order], text[order]
    new_term = np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(order)]
    first = np.flatnonzero(new_term | np.concatenate([[True], doc[1:] != doc[:-1]])[: len(order)])
    freq, doc, new_term = np.diff(np.concatenate([first, [len(order)]])), doc[first], new_term[first]
    head = np.flatnonzero(new_term)
    count = np.diff(np.concatenate([head, [len(doc)]]))
    new_block = (np.arange(len(doc)) - np.repeat(head, count)) % BLOCK == 0
    block = np.flatnonzero(new_block)
    before = np.where(new_term, -1, np.concatenate([[-1], doc[:-1]]))
    stream = np.empty(2 * len(doc), np.int64)
    stream[::2], stream[1::2] = doc - before, freq
    out, start = packed(stream)
    # blocks of each list, bytes of each list
    blocks = np.searchsorted(block, np.concatenate([head, [len(doc)]]))
    bytes_at = np.concatenate([start[2 * head], [len(out)]]) if len(doc) else np.zeros(1, np.int64)
    last = doc[np.concatenate([block[1:], [len(doc)]]) - 1] if len(doc) else doc
    at = start[2 * block] - np.repeat(bytes_at[:-1], np.diff(blocks))
    number = np.cumsum(new_block) - 1
    by = np.lexsort((-freq, sizes[doc], number))
    raised = freq[by] + number[by] * (1 << 40)  # a running maximum that starts anew with each block
    best = np.concatenate([[True], raised[1:] > np.maximum.accumulate(raised)[:-1]])[: len(by)]
    front = by[best]
    per_block = np.bincount(number[front], minlength=len(block))
    ends = np.cumsum(per_block)
    of_list = np.concatenate([[0], ends])[blocks]
    ends = ends - np.repeat(of_list[:-1], np.diff(blocks))
    place = order[first[head]]
    rows = {
        "term": _strings(data, begin[place], (end - begin)[place]), "n": pa.array(count),
        "last": _lists(last, blocks, pa.int32()), "at": _lists(at, blocks, pa.int32()), "ends": _lists(ends, blocks, pa.int32()),
        "freq": _lists(freq[front], of_list, pa.int32()), "size": _lists(sizes[doc[front]], of_list, pa.int32()),
        "data": pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(bytes_at.astype(np.int32)), pa.py_buffer(out)]),
    }
    return rows, sizes


def _indexed(wanted: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        schema = None
        for batch in batches:
            data, offsets = texts.flat(batch.column("text"))
            for i, j in texts.slices(offsets, SHARD_BYTES, SHARD_ROWS):
                rows, sizes = postings(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], wanted)
                n = len(rows["n"])
                rows = {"shard": pa.array(np.full(n, shard))} | rows | {"ids": pa.nulls(n, pa.list_(pa.int64()))}
                out = pa.RecordBatch.from_pydict(rows)
                schema = out.schema
                head = {"shard": [shard], "size": pa.array([sizes], pa.list_(pa.int32())), "ids": pa.array([batch.column("doc_id").slice(i, j - i).to_pylist()], pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_pydict({f.name: head.get(f.name, pa.nulls(1, f.type)) for f in schema}, schema=schema)
                if n:
                    yield out
                shard += 1

    return run


def index(docs: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """The index of doc_id and text: a row for each term of each shard, and one without term that lists the shard's documents.

    A shard is a run of documents of ``SHARD_BYTES`` in all, or one longer document. ``wanted`` is a bitmap of 2**FILTER_BITS
    bits: terms whose hash hits none of its bits get no list. Within a shard, terms are told apart by 64-bit hashes.
    """
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_indexed(wanted), _INDEX)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ask = TaskContext.get().partitionId() << 32
    for batch in batches:
        data, offsets = texts.flat(batch.column("text"))
        rows, _ = postings(data, offsets, None)
        words = rows["term"].take(pa.array(np.repeat(np.arange(len(rows["n"])), rows["n"].to_numpy())))
        doc, freq = _all_postings(rows)
        hashed = texts.spans_hash(*_flat_terms(words)) & np.uint64((1 << FILTER_BITS) - 1)
        yield pa.RecordBatch.from_pydict({
            "ask": pa.array(ask + doc), "item_id": batch.column("item_id").take(pa.array(doc)), "term": words, "times": pa.array(freq), "bit": pa.array(hashed.astype(np.int64))})
        ask += len(offsets) - 1


def _flat_terms(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = texts.flat(words)
    return data, offsets[:-1], offsets[1:]


def _all_postings(rows: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    if not len(rows["n"]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stream = unpacked(np.frombuffer(rows["data"].buffers()[2], np.uint8))
    first = np.concatenate([[0], np.cumsum(rows["n"].to_numpy())])[:-1]
    total = np.cumsum(stream[::2])
    return total - np.repeat(total[first] - stream[::2][first], rows["n"].to_numpy()) - 1, stream[1::2]


class Shard:
    """The lists of one shard that some items ask for, with the bounds that follow from the corpus."""

    def __init__(self, rows: pa.Table, n_docs: int, n_terms: int):
        head = rows.filter(pa.compute.is_valid(rows["ids"])).slice(0, 1)
        self.rows = rows.filter(pa.compute.is_valid(rows["data"])).combine_chunks()
        ids = head["ids"].combine_chunks().values
        self.unknown = np.asarray(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.damped = 75 + 25 * head["size"].combine_chunks().values.to_numpy() .astype(np.int64) * n_docs // n_terms
        sizes = self._flat("size").astype(np.int64)
        value = self.impact(self._flat("freq").astype(np.int64), 75 + 25 * sizes * n_docs // n_terms)
        self.blocks = self._bounds("last")
        fronts = self._bounds("size")
        starts = np.concatenate([[0], self._flat("ends")])[:-1] if len(value) else np.zeros(0, np.int64)
        starts[self.blocks[:-1]] = 0
        starts += np.repeat(fronts[:-1], np.diff(self.blocks))
        self.block_max = np.maximum.reduceat(value, starts) if len(value) else value
        self.list_max = np.maximum.reduceat(self.block_max, self.blocks[:-1]) if len(value) else value
        self.last, self.at = self._flat("last").astype(np.int64), self._flat("at").astype(np.int64)
        data = self.rows["data"].combine_chunks()
        self.data, self.data_at = np.frombuffer(data.buffers()[2], np.uint8), np.frombuffer(data.buffers()[1], np.int32)[data.offset :]
        self.n = self.rows["n"].to_numpy()
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _flat(self, name: str) -> np.ndarray:
        return self.rows[name].combine_chunks().flatten().to_numpy().copy()

    def _bounds(self, name: str) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(pa.compute.list_value_length(self.rows[name]).to_numpy())]).astype(np.int64)

    @staticmethod
    def impact(freq: np.ndarray, damped: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * freq // (1000 * freq + 12 * damped)

    def read(self, t: int, blocks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of list ``t``, of all its blocks (kept, as other items ask for them too) or of some."""
        if t in self.opened:
            return self.opened[t]
        own = slice(self.blocks[t], self.blocks[t + 1])
        at, last = self.at[own], self.last[own]
        ends = np.concatenate([at[1:], [self.data_at[t + 1] - self.data_at[t]]])
        chosen = np.arange(len(at)) if blocks is None else blocks
        length = ends[chosen] - at[chosen]
        stream = unpacked(self.data[self.data_at[t] + texts.runs(at[chosen], length)])
        gaps, freq = stream[::2], stream[1::2]
        held = np.full(len(chosen), BLOCK)
        held[chosen == len(at) - 1] = self.n[t] - BLOCK * (len(at) - 1)
        total = np.cumsum(gaps)
        first = np.cumsum(held) - held
        base = np.where(chosen > 0, last[chosen - 1], -1)
        docs = total + np.repeat(base - (total[first] - gaps[first]), held)
        found = docs, self.impact(freq, self.damped[docs])
        if blocks is None:
            self.opened[t] = found
        return found

    def top(self, lists: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the ``k`` best for lists with weights; ties with the last one are all in.

        Lists go by their global bound, the greatest first. They are essential, and read whole, until what all others
        can add is less than the k-th score. Of the documents met by then, the block maxima of the others
        tell which can still pass; only blocks that hold such a document are unpacked.
        """
        bound = weights * self.list_max[lists]
        order = np.argsort(-bound, kind="stable")
        lists, weights, bound = lists[order], weights[order], bound[order]
        rest = np.concatenate([np.cumsum(bound[::-1])[::-1], [0]])
        score = np.zeros(len(self.ids), np.int64)
        least, at = 1, 0

        def kth(values: np.ndarray) -> int:
            return max(1, int(np.partition(values, len(values) - k)[len(values) - k])) if len(values) >= k else 1

        while at < len(lists):
            if rest[at] < score.max(initial=0):
                least = kth(score)
                if rest[at] < least:
                    break
            docs, value = self.read(lists[at])
            score[docs] += weights[at] * value
            at += 1
        found = np.flatnonzero((score > 0) & (score + rest[at] >= least))
        own = score[found]
        place, most = [], []
        for t, w in zip(lists[at:], weights[at:], strict=True):
            last = self.last[self.blocks[t] : self.blocks[t + 1]]
            block = np.searchsorted(last, found)
            place.append(block)
            most.append(np.where(block < len(last), w * self.block_max[np.minimum(self.blocks[t] + block, len(self.block_max) - 1)], 0))
        can = own + sum(most, np.zeros(len(found), np.int64))
        for i, (t, w) in enumerate(zip(lists[at:], weights[at:], strict=True)):
            least = max(least, kth(own))
            alive = can >= least
            if not alive.all():
                found, own, can = found[alive], own[alive], can[alive]
                place, most = [p[alive] for p in place], [m[alive] for m in most]
            some = place[i] < self.blocks[t + 1] - self.blocks[t]
            if some.any():
                docs, value = self.read(t, np.unique(place[i][some]))
                hit = np.searchsorted(docs, found)
                met = (hit < len(docs)) & (docs[np.minimum(hit, len(docs) - 1)] == found)
                exact = np.where(met, w * value[np.minimum(hit, len(docs) - 1)], 0)
                own, can = own + exact, can + exact - most[i]
        keep = own >= max(1, kth(own))
        return found[keep], own[keep]


def _searched(n_docs: int, n_terms: int, k: int):
    def run(rows: pa.Table) -> pa.Table:
        shard = Shard(rows, n_docs, n_terms)
        asks = shard.rows["asks"].combine_chunks()
        entry = asks.flatten()
        owner = np.repeat(np.arange(len(asks)), pa.compute.list_value_length(asks).to_numpy())
        ask, item = entry.field("ask").to_numpy(), entry.field("item_id")
        weight = entry.field("times").to_numpy() * shard.rows["w"].to_numpy()[owner]
        order = np.argsort(ask, kind="stable")
        bounds = np.flatnonzero(np.concatenate([[True], ask[order][1:] != ask[order][:-1], [True]]))
        out = [np.zeros((0, 3), np.int64)]
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            own = order[i:j]
            docs, score = shard.top(owner[own], weight[own], k)
            best = np.lexsort((shard.ids[docs], shard.unknown[docs], -score))[:k]
            out.append(np.stack([np.full(len(best), own[0]), docs[best], score[best]], axis=1))
        all_rows = np.concatenate(out)
        return pa.table({
            "ask": pa.array(ask[all_rows[:, 0]]), "item_id": item.take(pa.array(all_rows[:, 0])),
            "doc_id": pa.array(shard.ids[all_rows[:, 1]], mask=shard.unknown[all_rows[:, 1]]), "score": pa.array(all_rows[:, 2])})

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score.

    Terms are letters and digits and all that is not ASCII, A-Z lower-cased. A document's score sums, over the item's terms with
    repeats, w * ((10**9 * tf) div (1000 * tf + 12 * m)), with w = floor(1000 ln((2N + 2) / (2 df + 1))) and
    m = 75 + (25 n N) div L. Only scores above 0 count; equal ones go by doc_id, null ids last. Null and empty texts have no
    term and are neither found nor counted. Every row of ``items`` is one item, also where ids repeat or are null; every row
    of ``docs`` is one document. A text of any length is one document of one shard. Other columns are ignored. A product
    25 n N must stay below 2**63.

    Documents are indexed in shards, one pass over the texts, into a written table. Items are taken in batches of ``BATCH``
    item terms; each pair of shard and batch is searched on its own and gives its k best, which are then merged. To
    the driver go N and L, and the bitmap of asked terms, of fixed size, which only saves lists that nobody asks for.
    """
    spark = docs.sparkSession
    pairs = "ask bigint, item_id bigint, term string, times bigint, bit bigint"
    asked = materialised(items.select(F.col("item_id").cast("bigint"), "text").mapInArrow(_asked, pairs), "search-items")
    words = asked.groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    wanted = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in words.collect():  # no more rows than the bitmap has words
        wanted[r.word] = r.bits
    lists = materialised(index(docs, wanted.view(np.uint64)), "search-index")
    heads = lists.where("term is null")
    sizes = heads.select(F.explode("size").alias("n")).where("n > 0")
    n_docs, n_terms = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    many = asked.groupBy("ask").agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    batches = running_total(many, ["all"], ["ask"], "upto", weight="n").select("ask", F.expr(f"(upto - n) div {BATCH}").alias("batch"))
    held = lists.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
    wants = asked.join(batches, "ask").groupBy("batch", "term").agg(F.collect_list(F.struct("ask", "item_id", "times")).alias("asks"))
    wants = wants.join(held.withColumn("w", weight), "term").select("batch", "term", "w", "asks")
    wants = materialised(wants, "search-terms")
    own = materialised(lists.where("term is not null").join(wants, "term").drop("term", "ids"), "search-lists")
    tops = own.select("shard", "batch").distinct().join(heads.select("shard", "size", "ids"), "shard")
    both = own.unionByName(tops, allowMissingColumns=True)
    found = both.groupBy("shard", "batch").applyInArrow(_searched(n_docs, n_terms, k), "ask bigint, item_id bigint, doc_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
