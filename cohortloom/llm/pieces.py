"""Encoding texts into the pieces of a SentencePiece model by batched Viterbi, and decoding them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cohortloom.llm import texts

MARK = 0x2581  # stands for a space in pieces
_OWN_MARK = 0x110000  # a mark that the text itself holds; in no piece
UNKNOWN_PENALTY = 10.0
_FILTER_BITS = 20
#: Units whose pieces a task remembers at once.
REMEMBERED = 500_000


@dataclass
class Model:
    """Sorted hashes of the pieces with ids and scores, and the bytes of each id; size is that of the vocabulary."""

    hashes: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    longest: int
    byte_ids: np.ndarray
    unknown_score: float
    bytes_flat: np.ndarray
    bytes_start: np.ndarray
    bytes_length: np.ndarray
    alone: np.ndarray  # white space that stands in no piece, so that texts can be parted there

    @property
    def maybe(self) -> np.ndarray:
        """A bit table of the hashes: most substrings that are no piece are told by it."""
        table = np.zeros(1 << _FILTER_BITS, bool)
        table[(self.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return table


def model_of(pieces: list[tuple[str, float]], byte_ids: list[int], special: set[int]) -> Model:
    """From (piece, score) by id; ``byte_ids`` are the pieces of the 256 bytes, ``special`` ids stand for no text."""
    shown, text_of = [], []
    bytes_at = {i: bytes([b]) for b, i in enumerate(byte_ids)}
    for i, (piece, _) in enumerate(pieces):
        text_of.append(bytes_at.get(i, b"" if i in special else piece.replace(chr(MARK), " ").encode()))
        if i not in special and i not in bytes_at:
            shown.append(i)
    points = [np.array([ord(c) for c in pieces[i][0]], np.uint32) for i in shown]
    flat = np.concatenate([*points, np.zeros(0, np.uint32)])
    end = np.cumsum([len(p) for p in points]).astype(np.int64)
    begin = end - np.array([len(p) for p in points], np.int64)
    hashes = np.concatenate([texts.spans_hash(flat[a:b], np.array([0]), np.array([b - a])) for a, b in zip(begin, end, strict=True)])
    order = np.argsort(hashes)
    scores = np.array([pieces[i][1] for i in shown])
    length = np.array([len(b) for b in text_of], np.int64)
    held = set(flat.tolist())
    return Model(
        hashes[order], np.array(shown, np.int32)[order], scores[order], max(len(p) for p in points), np.array(byte_ids, np.int32),
        float(scores[scores > -1e8].min() - UNKNOWN_PENALTY), np.frombuffer(b"".join(text_of), np.uint8), np.cumsum(length) - length, length,
        np.array([c for c in (9, 10, 11, 12, 13) if c not in held], np.uint32),
    )


def load(path: str) -> Model:
    """The model file at ``path``, read on the driver; it goes to the tasks with their code (under 3 MB for 32,000 pieces)."""
    import sentencepiece

    reader = sentencepiece.SentencePieceProcessor(model_file=path)
    size = reader.get_piece_size()
    byte_ids = [reader.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    special = {i for i in range(size) if reader.is_control(i) or reader.is_unknown(i)}
    return model_of([(reader.id_to_piece(i), reader.get_score(i)) for i in range(size)], byte_ids, special)


class Encoder:
    """Encodes slices of texts; remembers the pieces of units it has seen."""

    def __init__(self, model: Model):
        self.model, self.maybe = model, model.maybe
        self.forget()

    def forget(self) -> None:
        self.known, self.start, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = np.zeros(0, np.int32)

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all texts, each after a mark for its begin, where each unit begins, and each text's first unit.

        A unit is marks and what follows them up to the next mark. No piece reaches over its end.
        """
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        size, n = np.diff(chars), len(offsets) - 1
        first = chars[:-1] + np.arange(n)
        out = np.full(len(points) + n, MARK, np.uint32)
        out[texts.runs(first + 1, size)] = np.where(points == MARK, _OWN_MARK, np.where(points == 32, MARK, points))
        is_mark = out == MARK
        cut = is_mark.copy()
        cut[1:] &= ~is_mark[:-1]
        for c in self.model.alone:
            here = np.flatnonzero(out == c)
            cut[here] = True
            cut[here[here + 1 < len(out)] + 1] = True
        cut[first] = True
        begin = np.flatnonzero(cut)
        return out, begin, np.searchsorted(begin, first)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has; an empty text has none."""
        some = np.diff(offsets) > 0
        count = np.zeros(len(some), np.int64)
        if not some.any():
            return np.zeros(0, np.int32), count
        points, begin, first = self.units(data, np.concatenate([offsets[:-1][some], offsets[-1:]]))
        end = np.append(begin[1:], len(points))
        hashes, at, unit = np.unique(texts.spans_hash(points, begin, end), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.forget()
        spot = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = spot < len(self.known)
        new[inside] = self.known[spot[inside]] != hashes[inside]
        if new.any():
            ids, n = self.viterbi(points, begin[at[new]], end[at[new]])
            start = len(self.store) + np.cumsum(n) - n
            self.store = np.concatenate([self.store, ids])
            order = np.argsort(np.concatenate([self.known, hashes[new]]), kind="stable")
            self.known = np.concatenate([self.known, hashes[new]])[order]
            self.start = np.concatenate([self.start, start])[order]
            self.length = np.concatenate([self.length, n])[order]
            spot = np.searchsorted(self.known, hashes)
        start, length = self.start[spot][unit], self.length[spot][unit]
        count[some] = np.add.reduceat(length, first)
        return self.store[texts.runs(start, length)], count

    def viterbi(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best pieces of each unit, one unit after the other, and how many each has."""
        length = end - begin
        order = np.argsort(length, kind="stable")
        ids: list[np.ndarray] = []
        count = np.zeros(len(begin), np.int64)
        at = 0
        while at < len(order):
            size = int(length[order[at]])
            to = int(np.searchsorted(length[order], size, "right"))
            to = min(to, at + max(1, 200_000 // size))
            got, count[order[at:to]] = self._same_length(points[begin[order[at:to], None] + np.arange(size)])
            ids.append(got)
            at = to
        # from the order of lengths back to the given order
        start = np.zeros(len(begin), np.int64)
        start[order] = np.cumsum(count[order]) - count[order]
        return np.concatenate(ids)[texts.runs(start, count)], count

    def _probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of those hashes that are pieces, and which pieces."""
        m = self.model
        here = np.flatnonzero(self.maybe[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        found = np.minimum(np.searchsorted(m.hashes, hashes[here]), len(m.hashes) - 1)
        hit = m.hashes[found] == hashes[here]
        return here[hit], found[hit]

    def _same_length(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All units of one length at once: the best score of each prefix from those up to ``longest`` shorter."""
        m, (n, size) = self.model, units.shape
        most = min(m.longest, size)
        # by units, end and length of the last piece, the longest first, so that ties go to it
        score = np.full((n, size, most), -np.inf)
        piece = np.full((n, size, most), -1, np.int32)
        flat = units.reshape(-1)
        for k in range(1, most + 1):
            begin = (np.arange(n)[:, None] * size + np.arange(size - k + 1)).reshape(-1)
            here, found = self._probe(texts.spans_hash(flat, begin, begin + k))
            row, last = here // (size - k + 1), here % (size - k + 1) + k - 1
            score[row, last, most - k] = m.scores[found]
            piece[row, last, most - k] = m.ids[found]
        single = score[:, :, most - 1]
        score[:, :, most - 1] = np.where(np.isfinite(single), single, m.unknown_score)
        best = np.full((n, size + most), -np.inf)  # best[:, most + j]: of the first j + 1 points; before it: of none
        best[:, most - 1] = 0
        back = np.zeros((n, size), np.int64)
        for j in range(size):
            total = best[:, j : j + most] + score[:, j]
            back[:, j] = total.argmax(axis=1)
            best[:, most + j] = np.take_along_axis(total, back[:, j, None], 1)[:, 0]
        tokens = np.zeros((n, size), np.int32)  # at the piece's last point; -2: none ends here
        tokens[:] = -2
        at, row = np.full(n, size - 1), np.arange(n)
        while len(row):
            taken = back[row, at]
            tokens[row, at] = piece[row, at, taken]
            at = at - (most - taken)
            row, at = row[at >= 0], at[at >= 0]
        return self._with_bytes(tokens, units)

    def _with_bytes(self, tokens: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown points become the ids of their bytes."""
        ends = tokens != -2
        ids, row = tokens[ends], np.nonzero(ends)[0]
        unknown = np.flatnonzero(ids == -1)
        if not len(unknown):
            return ids, ends.sum(axis=1)
        points = units[ends][unknown]
        coded = np.where(points == _OWN_MARK, MARK, points).astype(np.uint32).tobytes().decode("utf-32-le").encode()
        coded = np.frombuffer(coded, np.uint8)
        starts = np.flatnonzero((coded & 0xC0) != 0x80)
        width = np.ones(len(ids), np.int64)
        width[unknown] = np.diff(np.append(starts, len(coded)))
        out = np.repeat(ids, width)
        out[out == -1] = self.model.byte_ids[coded]
        return out, np.bincount(np.repeat(row, width), minlength=len(units))


def decoded(model: Model, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts in a row, and where each begins and the last ends."""
    length = model.bytes_length[ids]
    total = np.concatenate([[0], np.cumsum(length)])
    data = model.bytes_flat[texts.runs(model.bytes_start[ids], length)]
    last = np.cumsum(count)
    begin, end = total[last - count], total[last]
    some = count > 0
    keep = np.ones(len(data), bool)
    keep[begin[some]] = False  # the mark before each text
    return data[keep], np.concatenate([[0], np.cumsum(end - begin - some)])


def encode(docs: DataFrame, model: Model, ids: str = "ids") -> DataFrame:
    """The columns of ``docs`` and ``ids``, the piece ids of the whole ``text`` (replacing a column of that name).

    The pieces are those with the greatest sum of the model's scores, the last piece as long as possible among equal
    sums. Characters of no piece become their bytes. Spaces are marks, one mark more stands before the text, nothing else
    is normalised, so decoding gives the text again. A null text has null ids, an empty one none.
    """
    names = [c for c in docs.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            text = batch.column(ids)
            data, offsets = texts.flat(text)
            for i, j in texts.slices(offsets):
                got, count = encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                bounds = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                null = text.slice(i, j - i).is_null()
                out = pa.ListArray.from_arrays(bounds, pa.array(got), mask=null)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in names] + [out], names=[*names, ids])

    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return docs.select(*names, docs["text"].alias(ids)).mapInArrow(run, schema)


def decode(rows: DataFrame, model: Model, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The columns of ``rows`` and ``text``, the text that ``ids`` stand for (null for null; it replaces such a column).

    Ids of control pieces stand for nothing. Bytes that make no UTF-8 become the replacement character.
    """
    names = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(ids)
            bounds = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0, np.int32)
            for i, j in texts.slices(bounds):
                data, at = decoded(model, flat[bounds[i] : bounds[j]], np.diff(bounds[i : j + 1]))
                try:
                    data.tobytes().decode()
                    out = pa.StringArray.from_buffers(j - i, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data.tobytes()))
                except UnicodeDecodeError:
                    out = pa.array([data[a:b].tobytes().decode(errors="replace") for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())
                null = lists.slice(i, j - i).is_null()
                out = pa.compute.if_else(null, pa.scalar(None, pa.string()), out)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in names] + [out], names=[*names, text])

    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField(text, T.StringType())])
    return rows.select(*names).mapInArrow(run, schema)
