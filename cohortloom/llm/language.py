"""Language of texts by rank-order profiles of their most frequent letter n-grams."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm import texts

UNDETERMINED = "und"
LONGEST = 3  # letters of an n-gram, counting the space before or after a word
PROFILE = 300  # n-grams of a profile
#: About as many documents of each language are learned from at most; scoring has no bound.
SAMPLE_ROWS = 1000
_SLICE = 1 << 18
_LOW = np.uint64((1 << 52) - 1)


@functools.cache
def _lower_letters() -> np.ndarray:
    """The lower case of each code point that is a letter, 0 for all others."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, n-gram (a 52-bit hash) and count of all distinct n-grams of each text.

    Words are runs of letters in lower case with a space at either end; an n-gram lies inside one word and its
    spaces, and is not a space alone.
    """
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    n = len(offsets) - 1
    spaced = np.zeros(len(points) + n + 1, np.uint32)  # a space before each text and after the last
    spaced[texts.runs(at[:-1] + np.arange(n) + 1, np.diff(at))] = _lower_letters()[points]
    text = np.repeat(np.arange(n + 1), np.append(np.diff(at) + 1, 1))
    some = spaced > 0
    keep = some.copy()
    keep[1:] |= some[:-1]
    keep[:-1] |= some[1:]
    spaced, text = spaced[keep].astype(np.uint64), text[keep]
    # between words one space is enough, but two may be left: none of the n-grams reaches over a space
    letter = spaced > 0
    keys = []
    for size in range(1, LONGEST + 1):
        m = len(spaced) - size + 1
        if m <= 0:
            break
        code, inside = np.full(m, size, np.uint64), np.ones(m, bool)
        for k in range(size):
            code = code * np.uint64(0x110001) + spaced[k : k + m]
            if 0 < k < size - 1:
                inside &= letter[k : k + m]
        if size == 1:
            inside = letter
        elif size == 2:
            inside = letter[:m] | letter[1:]
        owner = text[:m] if size == 1 else text[1 : m + 1]  # the first letter's or a middle one's text
        if size == 2:
            owner = np.where(letter[:m], text[:m], text[1:])
        keys.append((owner[inside].astype(np.uint64) << np.uint64(52)) | (texts.mixed(code[inside]) >> np.uint64(12)))
    keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.append(first, len(keys)))
    return (keys[first] >> np.uint64(52)).astype(np.int64), keys[first] & _LOW, count


@dataclass
class Profiles:
    """Languages, the n-grams that any of their profiles holds, sorted, and the rank of each in each language."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest language of each text (-1: none) and how clear the choice is, 0 to 1.

        Out-of-place distance: over the text's most frequent n-grams, by how many ranks each stands elsewhere in the
        profile, or the length of a profile where it is missing. Equal counts rank by the n-gram, equal
        distances by the language's name.
        """
        n = len(offsets) - 1
        best, clear = np.full(n, -1), np.zeros(n)
        text, gram, count = ngrams(data, offsets)
        if not len(text) or not self.languages:
            return best, clear
        order = np.lexsort((gram, -count, text))
        size = np.bincount(text, minlength=n)
        rank = np.empty(len(text), np.int64)
        rank[order] = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
        top = rank < PROFILE
        text, gram, rank = text[top], gram[top], rank[top]
        spot = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        known = self.grams[spot] == gram
        missing = np.bincount(text[~known], minlength=n) * PROFILE
        far = np.empty((n, len(self.languages)))
        for k in range(len(self.languages)):
            place = self.ranks[spot[known], k]
            apart = np.where(place < PROFILE, np.abs(place - rank[known]), PROFILE)
            far[:, k] = missing + np.bincount(text[known], apart, n)
        some = size > 0
        best[some] = far[some].argmin(axis=1)
        near = np.sort(far, axis=1)
        if len(self.languages) > 1:
            total = near[:, 0] + near[:, 1]
            clear[some] = np.where(total[some] > 0, near[some, 1] / np.maximum(total[some], 1), 0.5)
        else:
            clear[some] = 1.0
        return best, clear


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = texts.flat(batch.column("text"))
        for i, j in texts.slices(offsets, _SLICE):
            text, gram, count = ngrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            lang = batch.column("lang").slice(i, j - i).take(pa.array(text))
            yield pa.RecordBatch.from_pydict({"lang": lang, "gram": pa.array(gram.view(np.int64)), "n": pa.array(count)})


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Profiles:
    """Profiles of every non-null lang of ``docs`` (doc_id, text, lang), from about ``rows`` documents of each.

    A language with more rows is learned from those whose hash of the id is under a bound that leaves ``rows``
    of them; their whole texts count. The driver gets ``PROFILE`` n-grams a language.
    """
    known = docs.where("lang is not null").select("doc_id", "text", "lang")
    shares = known.groupBy("lang").agg(F.least(F.lit(1.0), rows / F.count("*")).alias("share"))
    place = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1_000_000)) / 1e6
    # one row for each language, as many as the driver gets profiles
    sample = known.join(F.broadcast(shares), "lang").where(place < F.col("share")).select("lang", "text")
    grams = sample.mapInArrow(_counts, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    found = grams.withColumn("rank", rank).where(F.col("rank") < PROFILE).select("lang", "gram", "rank").collect()
    languages = sorted({r.lang for r in found})
    union = np.array(sorted({r.gram for r in found}), np.uint64)
    ranks = np.full((len(union), len(languages)), PROFILE, np.int64)
    place_of = {int(g): i for i, g in enumerate(union)}
    for r in found:
        ranks[place_of[r.gram], languages.index(r.lang)] = r.rank
    return Profiles(languages, union, ranks)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs`` (doc_id, text; other columns are ignored).

    The whole text counts. lang_pred is ``und``, with score 0, for a null text, one without letters, or if no language
    was learned. The score is the share of the second-nearest distance in the two nearest ones; 1 if there is
    one language only. Rows that repeat are judged alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*profiles.languages, UNDETERMINED], object)
        for batch in batches:
            data, offsets = texts.flat(batch.column("text"))
            for i, j in texts.slices(offsets, _SLICE):
                best, clear = profiles.predict(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(names[best], pa.string()), pa.array(clear)],
                    names=["doc_id", "lang_pred", "score"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)
