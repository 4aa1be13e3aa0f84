"""Line dedup against brute force with an edit distance."""

import random

from cohortloom.llm.line_dedup import dedup_lines


def near(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < 20 or abs(len(a) - len(b)) > 1:
        return False
    front = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    back = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1], strict=False)) if x != y), min(len(a), len(b)))
    return front + back >= max(len(a), len(b)) - 1


def brute(rows):
    lines = sorted((i, k, x.strip(" ")) for i, t in rows if t is not None for k, x in enumerate(t.split("\n")))
    gone = {(i, k) for n, (i, k, x) in enumerate(lines) if x.strip() and any(
        y.strip() and (j, m) < (i, k) and near(x, y) for j, m, y in lines[:n])}
    return sorted((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in rows)


def edited(rng, line):
    at = rng.randrange(len(line) + 1)
    return rng.choice([line[:at] + "é" + line[at:], line[:at] + line[at + 1 :], line[:at] + "x" + line[at + 1 :]])


def test_matches_brute_force(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abc é") for _ in range(n))
    pool = ["\t", "\r"] + [text(n) for n in (1, 2, 5, 9, 10, 15, 19, 20, 21, 31, 32, 33, 63, 64, 65, 66, 100, 330, 2047, 2048, 2049, 2050, 9000) for _ in range(2)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(8)):
            line = rng.choice(pool)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                line = edited(rng, line) if line else line
            lines.append(rng.choice(["", " "]) + line)
        rows.append((i * 31 % 60, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, rows[0][1]), (104, "item number 12345678 of\nitem number 12345679 of")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n_lines", "'a' as line", "2 as n_chars")
    out = dedup_lines(df.repartition(3))
    assert out.columns == ["doc_id", "text", "n_lines", "line", "n_chars", "n_dropped"]
    got = out.collect()
    assert sorted((r.doc_id, r.text) for r in got) == brute(rows)
    assert all(r.n_chars == len(r.text or "") for r in got)


def test_repeated_rows_null_ids_and_empty_table(spark):
    long = "the same line of more than twenty characters"
    rows = [(1, long), (1, long), (None, long), (2, long + "."), (3, "short one")]
    got = sorted(((r.doc_id, r.text, r.n_dropped) for r in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == sorted([(None, long, 0), (1, "", 1), (1, "", 1), (2, "", 1), (3, "short one", 0)], key=str)
    assert dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
