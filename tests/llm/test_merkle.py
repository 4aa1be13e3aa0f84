"""Merkle manifests against a plain tree, built list by list."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from cohortloom.llm.merkle import FIELDS, audit
from cohortloom.llm.shared import fold

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS])


def plain_tree(leaves):
    """The root, and for each leaf its siblings as (place, hash or None)."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            j = i ^ 1
            path.append((j < i, level[j] if j < len(level) else None))
            i >>= 1
        paths.append(path)
    return levels[-1][0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, plain_leaf(r)))
        trees[g] = plain_tree([plain_leaf(r) for r in groups[g]])
    root, upper = plain_tree([trees[g][0] for g in names])
    out = []
    for g, up in zip(names, upper, strict=True):
        subroot, paths = trees[g]
        for r, path in zip(groups[g], paths, strict=True):
            way = path + up
            changed = dict(r)
            shown = "" if r["doc_id"] is None else str(r["doc_id"])  # as in every fold, a null id is the empty text
            if zlib.crc32(shown.encode()) % 7 == 0 and r["n_chars"] is not None:
                changed["n_chars"] += 1
            x = plain_leaf(changed)
            for left, other in way:
                x = h(other or "", x) if left else h(x, other or "")
            out.append((r["doc_id"], plain_leaf(r), subroot, root, h(*[s or "" for _, s in way]), x, x == root))
    return sorted(out, key=str)


def checked(spark, rows, schema=SCHEMA, extra=()):
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], schema)
    for c in extra:
        df = df.withColumn(c, F.lit("clash"))
    got = audit(df.repartition(3), fold("doc_id", 7) == 0).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)
    return got


@pytest.mark.parametrize("n", [1, 2, 3, 17, 259])
def test_proofs_match_a_plain_tree(spark, n):
    rng = random.Random(n)
    langs = [None, "", "de", "en", "éa", "zz"][: max(1, n)]
    rows = [dict(doc_id=i * 3 - 5, text=rng.choice(["a", "", None, "é\n:1", "x" * 9]), lang=rng.choice(langs) if n > 3 else langs[i % 2],
                 source=rng.choice([None, "s"]), n_chars=rng.choice([None, 0, 12])) for i in range(n)]
    got = checked(spark, rows, extra=("tree", "pos", "hash", "item", "key", "all", "leaf"))
    tampered = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None]
    assert sum(not r.verified for r in got) == len(tampered)


def test_nulls_repeated_rows_and_long_texts(spark):
    same = dict(doc_id=7, text="t", lang="en", source="s", n_chars=1)
    rows = [dict(same) for _ in range(5)] + [dict(same, doc_id=None), dict(same, doc_id=None, text="y" * 3_000_000), dict(same, text=None)]
    checked(spark, rows)


def test_an_empty_table_has_no_rows(spark):
    assert audit(spark.createDataFrame([], SCHEMA), fold("doc_id", 7) == 0).collect() == []
