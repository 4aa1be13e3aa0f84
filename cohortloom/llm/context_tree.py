"""Language-model scores by context-tree weighting over bytes, and by token counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm import texts
from cohortloom.session import materialised

DEPTH = 5  # bytes of the longest context
SLOT_BITS = 22  # tasks hold the probabilities of 2**22 grams at most; those of the others are joined
LEAST_COUNT = 1  # every binary context that was seen counts
FREQUENT = 1 << 20  # a token with at least this share of all counts is looked up; there can be no more of them
_SLICE = 1 << 21
_HELD = 1 << 21  # distinct keys that a task counts before it hands them on
_SPACE, _END = 32, 10
_HALF = np.log(0.5)
_TOP = 3  # bytes of the contexts whose subtrees are built side by side


def token_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as the model sees them, where each begins and the last ends, and hash and text number of every word.

    A-Z in lower case, words parted by one space, and one end (a newline, that no word holds) for each text.
    """
    data, n = texts.lowered(data), len(offsets) - 1
    begin, end, text = texts.words(data, offsets)
    words = texts.spans_hash(data, begin, end)
    size = np.bincount(text, end - begin + 1, n).astype(np.int64)
    count = np.bincount(text, minlength=n)
    size += count == 0  # the end alone
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.full(at[-1], _SPACE, np.uint8)
    to = at[text] + np.cumsum(end - begin + 1) - (end - begin + 1)
    first = np.cumsum(count) - count
    base = np.concatenate([[0], np.cumsum(end - begin + 1)])[first[text]] if len(text) else np.zeros(0, np.int64)
    to = to - base
    out[texts.runs(to, end - begin)] = data[texts.runs(begin, end - begin)]
    out[at[1:] - 1] = _END
    return out, at, words, text


def grams(stream: np.ndarray, at: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each byte a number: the byte, and above it its ``depth`` predecessors, the nearest lowest; ends before the text."""
    out = stream.astype(np.uint64)
    place = np.arange(len(stream)) - np.repeat(at[:-1], np.diff(at))
    for k in range(1, depth + 1):
        before = np.full(len(stream), _END, np.uint64)
        before[k:] = stream[:-k] if k < len(stream) + 1 else 0
        before[place < k] = _END
        out |= before << np.uint64(8 * k)
    return out


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _count_corpus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind (0: gram, 1: word, 2: text), key, count in the learned rows and, of grams, in all rows."""
    held: dict[tuple[int, bool], list] = {(0, True): [], (1, True): [], (0, False): []}
    n_texts = 0

    def given(kind: int, learned: bool, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 1 << 17):
            part, n = keys[i : i + (1 << 17)].view(np.int64), counts[i : i + (1 << 17)].astype(np.int64)
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(part), kind, np.int32)), "key": pa.array(part),
                                              "n": pa.array(n if learned else np.zeros(len(n), np.int64)), "seen": pa.array(n)})

    def merged(kind: tuple[int, bool]) -> tuple[np.ndarray, np.ndarray]:
        parts = held[kind]
        held[kind] = []
        return _counted(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))

    for batch in batches:
        learned = batch.column("learned").to_numpy(zero_copy_only=False)
        for own in (True, False):
            rows = batch.column("text").filter(pa.array(learned == own))
            data, offsets = texts.flat(rows)
            n_texts += len(rows) if own else 0
            for i, j in texts.slices(offsets, _SLICE, 1 << 30):
                stream, at, words, _ = token_stream(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held[0, own].append(_counted(grams(stream, at)))
                if own:
                    held[1, own].append(_counted(words))
                for kind in held:
                    if sum(len(k) for k, _ in held[kind]) > _HELD:
                        keys, counts = merged(kind)
                        if len(keys) > _HELD // 2:
                            yield from given(*kind, keys, counts)
                        else:
                            held[kind] = [(keys, counts)]
    for kind in held:
        if held[kind]:
            yield from given(*kind, *merged(kind))
    yield from given(2, True, np.zeros(1, np.uint64), np.array([n_texts]))


_LOG_FACT = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 1 << 14)))])
_LOG_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(0, (1 << 14) - 1) + 0.5))])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of so many zeros and ones under the Krichevsky-Trofimov estimate."""
    def half(n: np.ndarray) -> np.ndarray:  # log(gamma(n + 1/2) / gamma(1/2))
        big = n >= len(_LOG_HALF)
        out = _LOG_HALF[np.where(big, 0, n)]
        return np.where(big, _log_gamma(n + 0.5) - 0.5 * np.log(np.pi), out) if big.any() else out

    total = zeros + ones
    big = total >= len(_LOG_FACT)
    below = _LOG_FACT[np.where(big, 0, total)]
    below = np.where(big, _log_gamma(total + 1.0), below) if big.any() else below
    return half(zeros) + half(ones) - below


@dataclass
class Level:
    """Binary contexts of one depth: the context's bytes, the node (bits of the byte so far, after a 1), counts, log
    weighted probability, and the weight of stopping there."""

    depth: int
    context: np.ndarray
    node: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    log_weighted: np.ndarray
    stop: np.ndarray

    def above(self) -> Level:
        """The contexts one byte shorter: half their own estimate, half the product of their children."""
        mask = np.uint64((1 << (8 * (self.depth - 1))) - 1)
        key, inverse = np.unique((self.context & mask) << np.uint64(8) | self.node, return_inverse=True)
        zeros = np.bincount(inverse, self.zeros, len(key)).astype(np.int64)
        ones = np.bincount(inverse, self.ones, len(key)).astype(np.int64)
        own = _HALF + log_kt(zeros, ones)
        weighted = np.logaddexp(own, _HALF + np.bincount(inverse, self.log_weighted, len(key)))
        return Level(self.depth - 1, key >> np.uint64(8), key & np.uint64(255), zeros, ones, weighted, np.exp(own - weighted))

    def found(self, keys: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the contexts of the grams ``keys`` stand, and whether they were seen; contexts are in order."""
        mask = np.uint64((1 << (8 * self.depth)) - 1)
        wanted, own = ((keys >> np.uint64(8)) & mask) << np.uint64(8) | node, self.context << np.uint64(8) | self.node
        if not len(own):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        spot = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
        return spot, (own[spot] == wanted) & ((self.zeros + self.ones)[spot] >= LEAST_COUNT)

    def mixed(self, keys: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Probability of each of the eight bits of the grams' bytes from this depth on, given those from the next one on
        (``below``, one row a bit). It is 0 where the context was never seen."""
        out = np.zeros(below.shape)
        symbol = keys & np.uint64(255)
        for k in range(8):
            spot, seen = self.found(keys, (np.uint64(1) << np.uint64(k)) | (symbol >> np.uint64(8 - k)))
            zeros, ones = self.zeros[spot[seen]], self.ones[spot[seen]]
            bit = ((symbol[seen] >> np.uint64(7 - k)) & np.uint64(1)) == 1
            own, deeper, stop = (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1), below[k, seen], self.stop[spot[seen]]
            out[k, seen] = np.where(deeper > 0, stop * own + (1 - stop) * deeper, own)
        return out

    def rows(self, part: bool) -> pa.RecordBatch:
        """The contexts as rows; ``part``: what the contexts above need, else what probabilities are made of."""
        n = len(self.node)
        return pa.RecordBatch.from_pydict({
            "part": pa.array(np.full(n, part)), "depth": pa.array(np.full(n, self.depth, np.int32)), "context": pa.array(self.context.view(np.int64)),
            "node": pa.array(self.node.astype(np.int32)), "zeros": pa.array(self.zeros), "n": pa.array(self.zeros + self.ones),
            "log_weighted": pa.array(self.log_weighted if part else self.stop)})


_NODE = "part boolean, depth int, context bigint, node int, zeros bigint, n bigint, log_weighted double"
_BITS = [f"q{k}" for k in range(8)]
_LOWER = _NODE + ", key bigint, seen bigint, " + ", ".join(f"{q} float" for q in _BITS)


def deepest(keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH) -> Level:
    """Contexts of the greatest depth from counted grams; nothing is below them, so they stop there."""
    symbol, context = keys & np.uint64(255), keys >> np.uint64(8)
    nodes, bits = [], []
    for k in range(8):
        nodes.append((np.uint64(1) << np.uint64(k)) | (symbol >> np.uint64(8 - k)))
        bits.append((symbol >> np.uint64(7 - k)) & np.uint64(1))
    key, inverse = np.unique(np.concatenate([context << np.uint64(8) | u for u in nodes]), return_inverse=True)
    bit, n = np.concatenate(bits) == 1, np.tile(counts, 8)
    zeros = np.bincount(inverse, np.where(bit, 0, n), len(key)).astype(np.int64)
    ones = np.bincount(inverse, np.where(bit, n, 0), len(key)).astype(np.int64)
    return Level(depth, key >> np.uint64(8), key & np.uint64(255), zeros, ones, log_kt(zeros, ones), np.ones(len(key)))


def _whole_groups(batches: Iterator[pa.RecordBatch], names: list[str], by: str = "part") -> Iterator[dict[str, np.ndarray]]:
    """Sorted batches joined and cut where the column ``by`` changes, of some 200,000 rows each."""
    held: dict[str, list] = {c: [] for c in names}
    rows = 0
    for batch in batches:
        for c in names:
            held[c].append(batch.column(c).to_numpy())
        rows += batch.num_rows
        if rows > 200_000:
            joined = {c: np.concatenate(x) for c, x in held.items()}
            cut = np.flatnonzero(joined[by] != joined[by][-1])
            cut = cut[-1] + 1 if len(cut) else 0
            if cut:
                yield {c: x[:cut] for c, x in joined.items()}
            held, rows = {c: [x[cut:]] for c, x in joined.items()}, len(joined[by]) - cut
    if rows:
        yield {c: np.concatenate(x) for c, x in held.items()}


def _filled(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch with all columns of ``_LOWER``, null where not given."""
    n = len(next(iter(columns.values())))
    kinds = {"boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "float": pa.float32()}
    return pa.RecordBatch.from_pydict({name: columns.get(name, pa.nulls(n, kinds[kind])) for name, kind in (c.split() for c in _LOWER.split(", "))})


def _lower_tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts of ``_TOP`` bytes for those above, and every gram with the probabilities of its bits from ``_TOP`` bytes on."""
    for rows in _whole_groups(batches, ["part", "key", "n", "seen"]):
        keys, learned = rows["key"].view(np.uint64), rows["n"] > 0
        level = deepest(keys[learned], rows["n"][learned])
        bits = level.mixed(keys, np.zeros((8, len(keys))))
        while level.depth > _TOP:
            level = level.above()
            bits = level.mixed(keys, bits)
        top = level.rows(True)
        yield _filled({c: top.column(c) for c in top.schema.names})
        yield _filled({"key": pa.array(rows["key"]), "seen": pa.array(rows["seen"])} | {q: pa.array(x.astype(np.float32)) for q, x in zip(_BITS, bits, strict=True)})


def _upper_tree(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, ["by", "depth", "context", "node", "zeros", "n", "log_weighted"], "by"):
            level = Level(int(rows["depth"][0]), rows["context"].view(np.uint64), rows["node"].astype(np.uint64), rows["zeros"],
                          rows["n"] - rows["zeros"], rows["log_weighted"], np.ones(len(rows["n"])))
            while level.depth > top:
                level = level.above()
                yield level.rows(False)
            yield level.rows(True)

    return run


def _finished(shared):
    """key and log2 probability of grams, from the probabilities of their bits and the levels above."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = shared.value
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            bits = np.stack([batch.column(q).to_numpy().astype(np.float64) for q in _BITS])
            for level in upper:
                bits = level.mixed(keys, bits)
            value = np.log2(np.where(bits > 0, bits, 0.5)).sum(0)  # nothing seen: one half
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "value": pa.array(value)})

    return run


def _tree(counts: DataFrame) -> tuple[DataFrame, list[Level]]:
    """Every gram (key, seen, probabilities of its bits from contexts of ``_TOP`` bytes on) and the levels above, the deepest first.

    ``counts`` are counted grams (key, n, seen); those with n = 0 were not learned from and are only looked up. The subtrees
    below contexts of three bytes are built side by side; their roots (at most 2**24 contexts) go on to the subtrees below one
    byte, and those roots, at most 65,280 rows, to the root. The levels of up to two bytes, whose number the pairs
    of bytes bound, whatever the corpus holds, come to the driver.
    """
    grouped = counts.withColumn("part", F.expr("shiftright(key, 8) & 16777215")).repartition("part").sortWithinPartitions("part")
    lower = materialised(grouped.select("part", "key", "n", "seen").mapInArrow(_lower_tree, _LOWER), "ctw-lower")
    middle = lower.where("part").withColumn("by", F.expr("context & 255")).repartition("by").sortWithinPartitions("by")
    names = ["by", "depth", "context", "node", "zeros", "n", "log_weighted"]
    middle = materialised(middle.select(*names).mapInArrow(_upper_tree(1), _NODE), "ctw-middle")
    root = middle.where("part").withColumn("by", F.lit(0)).coalesce(1).select(*names).mapInArrow(_upper_tree(0), _NODE)
    rows = middle.union(root).where("not part").select("depth", "context", "node", "zeros", "n", F.col("log_weighted").alias("stop")).toArrow()
    columns = {c: rows[c].to_numpy() for c in rows.column_names}
    upper = []
    for depth in range(_TOP - 1, -1, -1):
        x = {c: v[columns["depth"] == depth] for c, v in columns.items()}
        context, node = x["context"].view(np.uint64), x["node"].astype(np.uint64)
        order = np.argsort(context << np.uint64(8) | node)
        upper.append(Level(depth, context[order], node[order], x["zeros"][order], (x["n"] - x["zeros"])[order], np.zeros(len(order)), x["stop"][order]))
    return lower.where("key is not null").select("key", "seen", *_BITS), upper


@dataclass
class Model:
    """The log2 probabilities of frequent grams, the frequent words by hash with their counts, and the corpus totals."""

    grams: np.ndarray
    log2s: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    tokens: int
    vocabulary: int
    n_texts: int

    def log2(self, keys: np.ndarray) -> np.ndarray:
        """Log2 probability of the byte of each frequent gram after its context, nan for others.

        Each bit's probability is the estimates of all contexts seen along its path, weighted by the tree's
        weights. Nothing seen: one half.
        """
        if not len(self.grams):
            return np.full(len(keys), np.nan)
        spot = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        return np.where(self.grams[spot] == keys, self.log2s[spot], np.nan)

    def known(self, words: np.ndarray) -> np.ndarray:
        """Counts of frequent words, -1 for others."""
        if not len(self.words):
            return np.full(len(words), -1)
        spot = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[spot] == words, self.counts[spot], -1)


class Remembered:
    """Log2 probabilities of grams by a table of 2**21 places, in which a gram overwrites another of its place."""

    def __init__(self, model: Model, bits: int = 21):
        self.model, self.shift = model, np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, 2**64 - 1, np.uint64), np.zeros(1 << bits)

    def log2(self, keys: np.ndarray) -> np.ndarray:
        place = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        out = self.values[place]
        missing = np.flatnonzero(self.keys[place] != keys)
        if len(missing):
            new, inverse = np.unique(keys[missing], return_inverse=True)
            values = self.model.log2(new)
            out[missing] = values[inverse]
            at = ((new * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
            self.keys[at], self.values[at] = new, values
        return out


def _least_frequent(grams: DataFrame, most: int) -> int:
    """A count that at most ``most`` rows of ``grams`` reach."""
    bucket = F.floor(F.log2("seen") * 8)
    held, least = 0, None
    for r in grams.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("rows"), F.min("seen").alias("least")).orderBy(F.desc("bucket")).collect():
        held += r.rows
        if held > most:
            break
        least = r.least
    return 2**62 if least is None else least


def learn(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the learned rows of ``docs`` (text, learned; a null text is empty), and (kind, key, value) of what is not
    frequent: the log2 probabilities of grams (kind 0) of all rows, and the counts of words (kind 1) of the learned rows."""
    counts = docs.select("text", "learned").mapInArrow(_count_corpus, "kind int, key bigint, n bigint, seen bigint")
    counts = materialised(counts.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")), "ctw-counts")
    totals = {r.kind: (r.n, r.different) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("different")).collect()}
    n_texts, n_words = totals.get(2, (0, 0))[0], totals.get(1, (0, 0))[0]
    words = counts.where("kind = 1").select("key", "n")
    tokens = n_texts + n_words
    least = -(-tokens // FREQUENT)
    frequent = words.where(F.col("n") >= least).toArrow()
    key = frequent["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    grams = counts.where("kind = 0").select("key", "n", "seen")
    least_seen = _least_frequent(grams, 1 << SLOT_BITS)
    tree, upper = _tree(grams)
    run = _finished(docs.sparkSession.sparkContext.broadcast(upper))
    held = tree.where(F.col("seen") >= least_seen).mapInArrow(run, "key bigint, value double").toArrow()  # 2**SLOT_BITS rows at most
    gram = held["key"].to_numpy().view(np.uint64)
    by_gram = np.argsort(gram)
    model = Model(gram[by_gram], held["value"].to_numpy()[by_gram], key[order], frequent["n"].to_numpy()[order], tokens,
                  totals.get(1, (0, 0))[1] + (n_texts > 0), n_texts)
    rare = tree.where(F.col("seen") < least_seen).mapInArrow(run, "key bigint, value double").select(F.lit(0).alias("kind"), "key", "value")
    return model, rare.union(words.where(F.col("n") < least).select(F.lit(1), "key", F.col("n").cast("double")))


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tree = Remembered(model)
        for batch in batches:
            data, offsets = texts.flat(batch.column("text"))
            for i, j in texts.slices(offsets, _SLICE, 1 << 30):
                n = j - i
                stream, at, words, text = token_stream(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                score = np.add.reduceat(np.nan_to_num(tree.log2(grams(stream, at))), at[:-1]) * np.log10(2)
                count = model.known(words)
                some = count >= 0
                base = np.bincount(text[some], np.log10(count[some] + 1), n) + np.log10(model.n_texts + 1)
                known = np.bincount(text[some], minlength=n) + (model.n_texts > 0)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, n) for c in ("doc_id", "row_key")), pa.array(np.bincount(text, minlength=n) + 1),
                     pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), pa.array(np.diff(at))],
                    names=["doc_id", "row_key", "n_tokens", "n_known", "base", "score", "n_bytes"])

    return run


def _rare(shared):
    """row_key, kind (0: gram, 1: word), key and times of what is not frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tree = Remembered(model)
        for batch in batches:
            data, offsets = texts.flat(batch.column("text"))
            row_key = batch.column("row_key").to_numpy()
            for i, j in texts.slices(offsets, _SLICE, 1 << 30):
                stream, at, words, text = token_stream(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                keys = grams(stream, at)
                unknown = np.flatnonzero(np.isnan(tree.log2(keys)))
                rare = model.known(words) < 0
                of_gram = np.searchsorted(at, unknown, "right") - 1
                for kind, key, owner in ((0, keys[unknown], of_gram), (1, words[rare], text[rare])):
                    order = np.lexsort((key, owner))
                    key, owner = key[order], owner[order]
                    if len(key):
                        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]))
                        yield pa.RecordBatch.from_pydict({
                            "row_key": pa.array(row_key[i + owner[first]]), "kind": pa.array(np.full(len(first), kind, np.int32)),
                            "key": pa.array(key[first].view(np.int64)), "times": pa.array(np.diff(np.append(first, len(key))).astype(np.int32))})

    return run


def score(docs: DataFrame, learned_from: Column) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text; others are ignored), learned from the rows where ``learned_from`` holds.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score (by token counts), score (the log10 probability of the whole
    token sequence under the context tree) and bits_per_byte. Texts are lower-cased (A-Z), words parted by one space, with
    one end each; a null text is empty and has the end alone. Each byte is eight binary decisions; each decision
    has a tree of contexts of 0 to ``DEPTH`` bytes, with a Krichevsky-Trofimov estimate in every node, whose
    mixture weights come from all counts of the corpus.

    The tree is built of counts in Spark over the whole corpus, and every distinct gram of ``docs`` (a byte and its ``DEPTH``
    predecessors) gets its exact probability there, from all contexts that were seen. What tasks hold is bounded: the
    probabilities of the 2**22 most frequent grams at most, and the words with at least 1 / 2**20 of all tokens (so there are no
    more than 2**20). The other grams and words are joined, so that nothing joined is a hot key. Rows that share
    doc_id and text are scored alike.
    """
    row_key = F.xxhash64("doc_id", "text")
    source = docs.select("doc_id", "text", row_key.alias("row_key"))
    model, rare_values = learn(docs.select("text", F.coalesce(learned_from, F.lit(False)).alias("learned")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType
    number = [T.StructField(c, T.LongType()) for c in ("row_key", "n_tokens", "n_known")]
    schema = T.StructType([T.StructField("doc_id", kind), *number, *(T.StructField(c, T.DoubleType()) for c in ("base", "score")), T.StructField("n_bytes", T.LongType())])
    rows = materialised(source.mapInArrow(_scores(shared), schema), "ctw-scores")
    rare = source.select("row_key", "text").mapInArrow(_rare(shared), "row_key bigint, kind int, key bigint, times int")
    word = F.col("kind") == 1
    rare = rare.join(rare_values, ["kind", "key"]).groupBy("row_key").agg(
        F.sum(F.when(word, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.when(word, F.col("times") * F.log10(F.col("value") + 1)).otherwise(0.0)).alias("more_base"),
        F.sum(F.when(word, 0.0).otherwise(F.col("times") * F.col("value"))).alias("more_log2"))
    # equal rows share a key: what was added up over them is parted again
    copies = rows.groupBy("row_key").agg(F.count("*").alias("copies"))
    rare = rare.join(copies, "row_key").select(
        "row_key", (F.col("more_known") / F.col("copies")).cast("bigint").alias("more_known"), (F.col("more_base") / F.col("copies")).alias("more_base"),
        (F.col("more_log2") / F.col("copies")).alias("more_log2"))
    out = rows.join(rare, "row_key", "left")
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(model.tokens + model.vocabulary + 1))
    score = F.col("score") + F.coalesce("more_log2", F.lit(0.0)) * float(np.log10(2))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                      F.lit(model.tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), score.alias("score"),
                      (-score / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"))
