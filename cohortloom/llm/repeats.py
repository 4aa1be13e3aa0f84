"""Removal of byte passages that an earlier document holds, by run-length indexes over what documents share.

Every passage of ``WIDTH`` bytes (a gram) goes to the group of its least hashed ``CORE``-byte piece, so equal grams of all
documents meet in one group. Grams next to each other mostly share that piece and travel as one string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm import texts
from cohortloom.llm.run_index import RunLengthIndex, words
from cohortloom.llm.shared import bucketed
from cohortloom.session import materialised

WIDTH = 50
CORE = 20
#: Cores that groups with too many strings are split by, one after the other; the last one is the gram itself.
FINER = (33, 42, 48, 50)
#: Core by which strings of a group are cut once more before they are indexed.
NEAR = 42
GROUP = 1 << 16  # strings of a group that one task may hold
TASK = 8192  # strings of small groups that go together
SLICE = 8 << 20
CHUNK = (1 << 20) - 64
KEYS = 1 << 23  # bytes of text whose keys make up one bucket
MOST = 64  # grams of a string, one bit each
_ODD = texts.mixed(np.arange(31, 31 + 8, dtype=np.uint64)) | np.uint64(1)


def _hashes(word: np.ndarray, size: int, q: int) -> np.ndarray:
    """A hash of the ``q`` bytes from every position on, where they fit into ``size`` bytes."""
    n = size - q + 1
    out = np.zeros(n, np.uint64)
    for k, at in enumerate([*range(0, q - 8, 8), q - 8]):
        out += word[at : at + n]
        out *= _ODD[k]
        out ^= out >> np.uint64(32)
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from every position on."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def gram_runs(data: np.ndarray, offsets: np.ndarray, q: int = CORE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of grams of one text that share their least ``q``-byte piece: start, number of grams, key, hash of the bytes.

    All grams of all texts are in exactly one run; which run a gram is in depends on where it stands, its key does not.
    """
    for a in range(0, len(data), CHUNK):
        part = data[a : a + CHUNK + WIDTH - 1]
        n = len(part) - WIDTH + 1
        if n <= 0:
            break
        least = _least(_hashes(words(part), len(part), q), WIDTH - q + 1)
        step = np.zeros(n + 1, np.int32)  # grams that would run over the end of their text
        ends = offsets[1:][(offsets[1:] > a) & (offsets[1:] < a + n + WIDTH)] - a
        np.add.at(step, np.clip(ends - WIDTH + 1, 0, n), 1)
        np.add.at(step, np.minimum(ends, n), -1)
        whole = np.cumsum(step[:n]) == 0
        first = whole & np.concatenate([[True], ~whole[:-1] | (least[1:] != least[:-1])])
        start = np.flatnonzero(first)
        stop = np.flatnonzero(whole & np.concatenate([first[1:] | ~whole[1:], [True]])) + 1
        most = MOST if q < WIDTH else 1  # a core as long as a gram: equal grams are equal strings
        pieces = -(-(stop - start) // most)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, stop = np.repeat(start, pieces) + most * nth, np.repeat(stop, pieces)
        count = np.minimum(stop - start, most)
        yield start + a, count, texts.mixed(least[start]), texts.spans_hash(part, start, start + count + WIDTH - 1)


def _all_runs(data: np.ndarray, offsets: np.ndarray, q: int = CORE) -> list[np.ndarray]:
    parts = list(gram_runs(data, offsets, q))
    kinds = (np.int64, np.int64, np.uint64, np.uint64)
    return [np.concatenate([np.zeros(0, kind), *[p[i] for p in parts]]) for i, kind in enumerate(kinds)]


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        data, offsets = texts.flat(batch.column("text"))
        for i, j in texts.slices(offsets, SLICE, 1 << 20):
            packed = pa.compress(np.ascontiguousarray(data[offsets[i] : offsets[j]]), "zstd", asbytes=True)
            yield pa.RecordBatch.from_pydict({
                "slice": pa.array([number]), "ids": pa.array([batch.column("doc_id").slice(i, j - i).to_pylist()], pa.list_(pa.int64())),
                "bytes": pa.array([np.diff(offsets[i : j + 1])], pa.list_(pa.int64())), "packed": pa.array([packed], pa.binary())})
            number += 1


class Slice:
    """Some documents, read from a row of the table of slices."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.number = batch.column("slice")[row].as_py()
        self.ids = np.array(batch.column("ids")[row].as_py(), np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(np.array(batch.column("bytes")[row].as_py(), np.int64))])
        packed = batch.column("packed")[row].as_py()
        self.data = np.frombuffer(pa.decompress(packed, int(self.offsets[-1]), "zstd", asbytes=True), np.uint8)

    def runs(self) -> list[np.ndarray]:
        """Start, number of grams, key and hash of all runs, and their documents' ids."""
        out = _all_runs(self.data, self.offsets)
        return [*out, self.ids[np.searchsorted(self.offsets, out[0], "right") - 1]]


def _rows(batch: pa.RecordBatch) -> Iterator[Slice]:
    for row in range(len(batch)):
        yield Slice(batch, row)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _distinct(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and which of them several documents have."""
    order = np.argsort(key)
    key, doc = key[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[: len(key)]
    if not len(key):
        return key, np.zeros(0, bool)
    return key[first], np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)


def _packed_keys(key: np.ndarray) -> bytes:
    """Six bytes of each key; those of one bucket that agree in them are taken as shared, which only costs work."""
    return key.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked_keys(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view(np.uint64)[:, 0]


def _keys(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in _rows(batch):
                _, _, key, _, doc = s.runs()
                key, several = _distinct(key, doc)
                own, first = np.unique(_bucket(key, buckets), return_index=True)
                bounds = [*first, len(key)]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(own, pa.int64()), "slice": pa.array(np.full(len(own), s.number)),
                    "keys": pa.array([_packed_keys(key[i:j]) for i, j in zip(bounds, bounds[1:], strict=False)], pa.binary()),
                    "several": pa.array([np.packbits(several[i:j]).tobytes() for i, j in zip(bounds, bounds[1:], strict=False)], pa.binary())})

    return run


def _shared_keys(rows: pa.Table) -> pa.Table:
    """For each slice, which of its keys of one bucket another document has too."""
    own = [_unpacked_keys(k) for k in rows["keys"].to_pylist()]
    several = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(k)) for b, k in zip(rows["several"].to_pylist(), own, strict=True)]
    _, where, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    flagged = np.bincount(where, weights=np.concatenate(several)) > 0
    shared = ((times > 1) | flagged)[where]
    bounds = np.cumsum([0, *map(len, own)])
    return pa.table({"bucket": rows["bucket"], "slice": rows["slice"],
                     "shared": pa.array([np.packbits(shared[i:j]).tobytes() for i, j in zip(bounds, bounds[1:], strict=False)], pa.binary())})


def _shared_runs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, s in enumerate(_rows(batch)):
                start, count, key, string, doc = s.runs()
                distinct, _ = _distinct(key, doc)
                places = np.searchsorted(_bucket(distinct, buckets), np.arange(buckets + 1))
                shared = np.zeros(len(distinct), bool)
                for reply in batch.column("replies")[row].as_py() or []:
                    i, j = places[reply["bucket"]], places[reply["bucket"] + 1]
                    shared[i:j] = np.unpackbits(np.frombuffer(reply["shared"], np.uint8), count=j - i)
                keep = np.flatnonzero(shared[np.searchsorted(distinct, key)])
                keep = keep[np.lexsort((doc[keep], string[keep], key[keep]))]
                k, h, d = key[keep], string[keep], doc[keep]
                new = np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])])[: len(k)]
                first = keep[new]
                latest = d[np.concatenate([np.flatnonzero(new)[1:], [len(k)]]) - 1] if len(k) else d
                place = (start[first] << 8) | (count[first] << 1) | (latest > doc[first])
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array(np.full(len(first), s.number)), "key": _signed(key[first]), "string": _signed(string[first]),
                    "doc": pa.array(doc[first]), "place": pa.array(place)})

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wanted = batch.column("wanted")
        for row, s in enumerate(_rows(batch)):
            own = wanted[row].values
            place = own.field("place").to_numpy()
            start, count = place >> 8, (place >> 1) & 127
            yield pa.RecordBatch.from_pydict({
                "slice": pa.array(np.full(len(start), s.number)), "key": own.field("key"), "string": own.field("string"), "doc": own.field("doc"),
                "bytes": pa.array([s.data[i : i + n + WIDTH - 1].tobytes() for i, n in zip(start, count, strict=True)], pa.binary())})


def _part(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data[texts.runs(begin, end - begin)], np.concatenate([[0], np.cumsum(end - begin)])


def _streamed(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A bit for each gram of each string that a string of an earlier document of its group has.

    Strings come in the order of group and document. In round b, those whose number in the group has bit b are streamed against
    a run-length index of those that agree above bit b and have 0 there; each pair of documents meets in exactly one round.
    """
    mask = np.zeros(len(doc), np.uint64)
    new_group = np.concatenate([[True], group[1:] != group[:-1]])
    group = np.cumsum(new_group) - 1
    steps = np.cumsum(new_group | np.concatenate([[True], doc[1:] != doc[:-1]]))
    number = steps - steps[np.flatnonzero(new_group)][group]
    for b in range(int(number.max(initial=0)).bit_length()):
        block = (group << 32) | (number >> (b + 1))
        odd = (number >> b) & 1 > 0
        asked = np.flatnonzero(odd)
        wanted = np.unique(block[asked])
        held = np.flatnonzero(~odd & np.isin(block, wanted))
        index = RunLengthIndex(*_part(data, offsets[held], offsets[held + 1]), np.searchsorted(wanted, block[held]))
        found, place = index.statistics(*_part(data, offsets[asked], offsets[asked + 1]), np.searchsorted(wanted, block[asked]), WIDTH)
        np.bitwise_or.at(mask, asked[found], np.uint64(1) << place.astype(np.uint64))
    return mask


def earlier_grams(rows: pa.Table) -> pa.Table:
    """For the strings (slice, key, string, doc, bytes) of some groups, a bit for each gram that an earlier document's string has.

    Strings are cut once more, by a longer core. Equal pieces of a group are one, of the first document that has it: later ones
    lose it whole. Cores with several pieces are indexed, and the pieces of later documents streamed against the index.
    Strings without such a gram are left out.
    """
    key, doc = rows["key"].to_numpy(), rows["doc"].to_numpy()
    column = rows["bytes"].combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    start, count, core, piece = _all_runs(data, offsets, NEAR)
    own = np.searchsorted(offsets, start, "right") - 1
    core = texts.mixed(core + texts.mixed(key[own].view(np.uint64)))  # groups stay apart
    order = np.lexsort((doc[own], piece, core))
    start, count, core, piece, own = start[order], count[order], core[order], piece[order], own[order]
    holder = doc[own]
    new_core = np.concatenate([[True], core[1:] != core[:-1]])
    new_piece = new_core | np.concatenate([[True], piece[1:] != piece[:-1]])
    heads, number = np.flatnonzero(new_piece), np.cumsum(new_piece) - 1
    group = (np.cumsum(new_core) - 1)[heads]
    several = np.flatnonzero(np.bincount(group)[group] > 1)
    several = several[np.lexsort((holder[heads[several]], group[several]))]
    chosen = heads[several]
    bits = np.zeros(len(heads), np.uint64)
    if len(chosen):
        part, bounds = _part(data, start[chosen], start[chosen] + count[chosen] + WIDTH - 1)
        bits[several] = _streamed(part, bounds, group[several], holder[chosen])
    whole = np.where(count >= MOST, ~np.uint64(0), (np.uint64(1) << (count % MOST).astype(np.uint64)) - np.uint64(1))
    found = np.where(holder > holder[heads][number], whole, bits[number])
    mask = np.zeros(len(key), np.uint64)
    np.bitwise_or.at(mask, own, found << (start - offsets[own]).astype(np.uint64))
    at = np.flatnonzero(mask)
    take = pa.array(at)
    return pa.table({"slice": rows["slice"].take(take), "key": pa.array(key[at]), "string": rows["string"].take(take), "doc": pa.array(doc[at]), "mask": _signed(mask[at])})


def _split(q: int):
    """Strings cut into runs by a longer core; the bytes stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts.flat(batch.column("bytes"))
            start, count, key, string = _all_runs(data, offsets, q)
            own = pa.array(np.searchsorted(offsets, start, "right") - 1)
            yield pa.RecordBatch.from_pydict({
                "slice": batch.column("slice").take(own), "of_key": batch.column("key").take(own), "of_string": batch.column("string").take(own),
                "doc": batch.column("doc").take(own), "place": pa.array(start - offsets[own.to_numpy()]), "count": pa.array(count),
                "key": _signed(key), "string": _signed(string)})

    return run


#: As many bits as a string has grams; 64 bits are -1.
_ALL_BITS = f"if(count >= {MOST}, -1L, shiftleft(1L, cast(count as int)) - 1L)"


_MASKS = "slice bigint, key bigint, string bigint, doc bigint, mask bigint"


def _indexed(strings: DataFrame, n: int) -> DataFrame:
    """``earlier_grams`` of strings whose groups are of bounded size, many small groups in a task."""
    tasks = F.pmod(F.xxhash64("key"), F.lit(n // TASK + 1)).alias("task")
    return strings.select("slice", "key", "string", "doc", "bytes").groupBy(tasks).applyInArrow(earlier_grams, _MASKS)


def _finer(strings: DataFrame, depth: int = 0) -> DataFrame:
    """``earlier_grams`` of strings of groups that are too large for one index.

    They are cut into finer strings by longer cores, of which equal ones are one again (its later holders lose it whole),
    and so on until a core is a whole gram and no group holds two strings. Bytes are fetched for the finer strings only
    that share their core with another one.
    """
    kinds = "slice bigint, of_key bigint, of_string bigint, doc bigint, place bigint, count bigint, key bigint, string bigint"
    parts = strings.mapInArrow(_split(FINER[depth]), kinds)
    first = F.min("doc").over(Window.partitionBy("key", "string")).alias("first")
    parts = materialised(parts.select("*", first), "repeat-parts")
    marks = parts.where("doc > first").select("slice", "of_key", "of_string", "doc", F.expr(f"shiftleft({_ALL_BITS}, cast(place as int))").alias("mask"))
    if depth + 1 < len(FINER):
        heads = parts.where("doc = first").dropDuplicates(["key", "string"])
        sizes = heads.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        heads = materialised(heads.join(sizes, "key"), "repeat-heads")
        of = strings.select(F.col("key").alias("of_key"), F.col("string").alias("of_string"), F.col("slice"), "bytes")
        cut = heads.join(of, ["of_key", "of_string", "slice"]).withColumn("bytes", F.expr(f"substring(bytes, cast(place + 1 as int), cast(count + {WIDTH - 1} as int))"))
        cut = materialised(cut.select("slice", "key", "string", "doc", "bytes", "size"), "repeat-finer")
        found = _indexed(cut.where(F.col("size") <= GROUP), heads.count())
        large = cut.where(F.col("size") > GROUP)
        if not large.isEmpty():
            found = found.unionByName(_finer(large, depth + 1))
        # all holders in the first document have the mask of its string
        own = found.select("key", "string", "doc", F.col("mask").alias("own")).distinct()
        marks = marks.unionByName(parts.join(own, ["key", "string", "doc"]).select(
            "slice", "of_key", "of_string", "doc", F.expr("shiftleft(own, cast(place as int))").alias("mask")))
    named = marks.select("slice", F.col("of_key").alias("key"), F.col("of_string").alias("string"), "doc", "mask")
    return named.groupBy("slice", "key", "string", "doc").agg(F.bit_or("mask").alias("mask"))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = batch.column("marks")
        for row, s in enumerate(_rows(batch)):
            n = len(s.data)
            grams = np.zeros(n + 1, np.int32)
            if marks[row].is_valid:
                own = marks[row].values
                key, string, first, mask = [own.field(c).to_numpy() for c in ("key", "string", "first", "mask")]
                code = lambda k, h: k ^ texts.mixed(h)
                known = code(key.view(np.uint64), string.view(np.uint64))
                order = np.lexsort((mask != 0, known))  # of two rows of a string, the last one has its mask
                order = order[np.concatenate([known[order][1:] != known[order][:-1], [True]])]
                known, key, string, first, mask = known[order], key[order], string[order], first[order], mask[order]
                start, count, k, h, doc = s.runs()
                at = np.minimum(np.searchsorted(known, code(k, h)), len(known) - 1)
                hit = (key[at].view(np.uint64) == k) & (string[at].view(np.uint64) == h)
                start, count, doc, at = start[hit], count[hit], doc[hit], at[hit]
                later = doc > first[at]
                np.add.at(grams, start[later], 1)
                np.add.at(grams, (start + count + WIDTH - 1)[later], -1)
                same = np.flatnonzero(~later & (mask[at] != 0))
                for b in range(MOST):
                    some = same[(mask[at[same]].view(np.uint64) >> np.uint64(b)) & np.uint64(1) > 0]
                    np.add.at(grams, start[some] + b, 1)
                    np.add.at(grams, start[some] + b + WIDTH, -1)
            gone = np.cumsum(grams[:n], dtype=np.int32) > 0
            edge = np.zeros(n + 1, bool)
            edge[s.offsets[:-1]] = True
            begin = np.flatnonzero(gone & (edge[:n] | np.concatenate([[True], ~gone[:-1]])[:n]))
            end = np.flatnonzero(gone & (edge[1:] | np.concatenate([~gone[1:], [True]])[:n])) + 1
            bounds = np.searchsorted(begin, s.offsets)
            own = np.repeat(s.offsets[:-1], np.diff(bounds))
            spans = pa.StructArray.from_arrays([pa.array(begin - own), pa.array(end - own)], ["begin", "end"])
            kept = np.concatenate([[0], np.cumsum(~gone)])[s.offsets]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(s.ids), "n_bytes": pa.array(np.diff(s.offsets)),
                "spans": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), spans),
                "kept": pa.Array.from_buffers(pa.binary(), len(s.ids), [None, pa.py_buffer(kept.astype(np.int32)), pa.py_buffer(s.data[~gone].tobytes())])})


def _bytes_of(slices: DataFrame, heads: DataFrame) -> DataFrame:
    wanted = heads.groupBy("slice").agg(F.collect_list(F.struct("key", "string", "doc", "place")).alias("wanted"))
    return slices.join(wanted, "slice").mapInArrow(_cut_out, "slice bigint, key bigint, string bigint, doc bigint, bytes binary")


def without_repeats(docs: DataFrame) -> DataFrame:
    """Remove every byte covered by a passage of ``WIDTH`` bytes that also starts in a document with a smaller doc_id.

    Returns per row doc_id, n_bytes, spans (maximal removed runs as begin and end, in bytes) and kept (the remaining bytes
    in one, which need not be UTF-8 any more). Passages are judged on the input and never cross documents; a null
    text is empty. Rows that repeat a doc_id remove nothing from each other, each is returned; rows with a null doc_id
    have no order: they are returned whole and remove nothing. Other columns are ignored.

    Texts are packed once into slices, a table bucketed by slice, so that later passes join what they need to
    know without moving texts again. (1) Each slice sends the distinct keys of its grams; keys of one document only
    end here. (2) What is left are strings of neighbouring grams with one key; equal ones have one first document, and
    all later holders lose them whole. (3) Keys with several strings get a run-length index, against which the strings of
    later documents are streamed; groups too large for one index are split by longer cores first. (4) Each slice takes its marks and cuts its texts. A slice is ``SLICE`` bytes of
    whole texts or one longer text; texts are hashed in pieces of a megabyte.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    slices = bucketed(rows.where("doc_id is not null").mapInArrow(_sliced, "slice bigint, ids array<bigint>, bytes array<bigint>, packed binary"), "slice", "repeat-slices")
    total = slices.agg(F.sum(F.aggregate("bytes", F.lit(0).cast("bigint"), lambda x, y: x + y))).first()[0] or 0
    buckets = total // KEYS + 1
    keys = slices.mapInArrow(_keys(buckets), "bucket bigint, slice bigint, keys binary, several binary")
    replies = keys.groupBy("bucket").applyInArrow(_shared_keys, "bucket bigint, slice bigint, shared binary")
    replies = replies.groupBy("slice").agg(F.collect_list(F.struct("bucket", "shared")).alias("replies"))
    # place: where a string starts, its grams, and whether the slice has a later holder too
    kinds = "slice bigint, key bigint, string bigint, doc bigint, place bigint"
    held = slices.join(replies, "slice").mapInArrow(_shared_runs(buckets), kinds)
    # a string has one row in each slice, whatever the number of its holders
    first = F.min("doc").over(Window.partitionBy("key", "string")).alias("first")
    held = materialised(held.select("*", first), "repeat-runs")
    heads = held.where("doc = first")
    sizes = heads.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    heads = materialised(heads.join(sizes, "key").select("slice", "key", "string", "doc", "place", "size"), "repeat-heads")
    found = _indexed(_bytes_of(slices, heads.where(F.col("size") <= GROUP)), heads.count())
    large = heads.where(F.col("size") > GROUP)
    if not large.isEmpty():
        found = found.unionByName(_finer(materialised(_bytes_of(slices, large), "repeat-large")))
    marks = held.where("doc > first or place % 2 = 1").select("slice", "key", "string", "first", F.lit(0).cast("bigint").alias("mask"))
    marks = marks.unionByName(found.select("slice", "key", "string", F.col("doc").alias("first"), "mask"))
    marks = marks.groupBy("slice").agg(F.collect_list(F.struct("key", "string", "first", "mask")).alias("marks"))
    kinds = "doc_id bigint, n_bytes bigint, spans array<struct<begin:bigint,end:bigint>>, kept binary"
    out = slices.join(marks, "slice", "left").mapInArrow(_marked, kinds)
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    unknown = rows.where("doc_id is null").select(
        "doc_id", F.octet_length(whole).cast("bigint").alias("n_bytes"),
        F.from_json(F.lit("[]"), "array<struct<begin:bigint,end:bigint>>").alias("spans"), whole.alias("kept"))
    return out.unionByName(unknown)
