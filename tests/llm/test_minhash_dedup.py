"""MinHash groups against brute force over all pairs."""

import random
import re

from cohortloom.llm.minhash_dedup import near_duplicates
from cohortloom.llm.shared import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]) and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = find(rows[i][0]), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def sample():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for base in range(12):
        words = [word() for _ in range(rng.choice([3, 5, 60, 200]))]
        for copy in range(rng.choice([1, 3, 15])):
            edited = list(words)
            for _ in range(rng.choice([0, 1, 2, 3])):
                edited[rng.randrange(len(edited))] = word()
            rows.append((len(rows) * 7 % 97 + 1000 * base, " ".join(edited)))
    long = " ".join(word() for _ in range(30_000))
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "One TWO three"), (5, "one\ttwo three"), (6, "É a"), (7, "é a"),
             (8, long), (9, long + " tail"), (None, "one two"), (10, "one two"), (10, "one two"), (11, rows[0][1]), (11, rows[-1][1])]
    rng.shuffle(rows)
    return rows


def test_groups_match_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n_shingles", "'x' as component_id", "2 as rep")
    got = near_duplicates(df.repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (None if r.doc_id is None else r.doc_id == r.component_id) for r in got)


def test_rows_that_repeat_an_id_lose_no_pair_of_the_last_step(spark):
    # a text and a copy with rare edits, 60 times over; all share their keys with too many others for two centres
    rng = random.Random(3)
    base, rows = [f"w{i}" for i in range(404)], []
    for pair in range(60):
        edits = rng.sample(range(10, 395, 5), 11)
        for n in (5, 11):
            words = list(base)
            for at in edits[:n]:
                words[at] = f"e{pair}-{at}"
            rows.append((len(rows), " ".join(words)))
    got = near_duplicates(spark.createDataFrame(rows * 2, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(brute(rows) * 2, key=str)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 30)] + [(5, 5), (None, 3), (30, 29)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 1 for i in range(1, 31)}
