"""Context-tree scores against a plain recursion, and token counts against a plain count."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortloom.llm import context_tree
from cohortloom.llm.queries import op4_context_tree

DEPTH = context_tree.DEPTH


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def coded(text):
    return " ".join(tokens(text)).encode() + b"\n"


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)


class Plain:
    """The tree as nested lookups: (context bytes, nearest last; bits of the byte so far) -> counts."""

    def __init__(self, rows):
        self.counts, self.children = {}, {}
        for text in rows:
            padded = b"\n" * DEPTH + coded(text)
            for i in range(DEPTH, len(padded)):
                bits = f"{padded[i]:08b}"
                for d in range(DEPTH + 1):
                    for k in range(8):
                        node = (padded[i - d : i], bits[:k])
                        self.counts.setdefault(node, [0, 0])[int(bits[k])] += 1
                        if d < DEPTH:
                            self.children.setdefault(node, set()).add((padded[i - d - 1 : i], bits[:k]))
        self.memo = {}

    def weighted(self, node):
        if node not in self.memo:
            own = log_kt(*self.counts[node])
            if len(node[0]) < DEPTH:
                below = sum(self.weighted(c) for c in self.children[node])
                own, high = math.log(0.5) + own, max(own, below)
                self.memo[node] = math.log(0.5) + high + math.log(math.exp(own - math.log(0.5) - high) + math.exp(below - high))
            else:
                self.memo[node] = own
        return self.memo[node]

    def log10(self, text):
        padded, total = b"\n" * DEPTH + coded(text), 0.0
        for i in range(DEPTH, len(padded)):
            bits = f"{padded[i]:08b}"
            for k in range(8):
                p, rest, last, stop = 0.0, 1.0, 0.5, 0.0
                for d in range(DEPTH + 1):
                    node = (padded[i - d : i], bits[:k])
                    a, b = self.counts.get(node, (0, 0))
                    if a + b < context_tree.LEAST_COUNT:
                        break
                    p, rest = p + rest * stop * last, rest * (1 - stop)
                    last = (b + 0.5) / (a + b + 1)
                    stop = 1.0 if d == DEPTH else math.exp(math.log(0.5) + log_kt(a, b) - self.weighted(node))
                p += rest * last
                total += math.log10(p if bits[k] == "1" else 1 - p)
        return total


def sum_log10(plain, text):
    """As ``Plain.log10``, but with every context that was seen."""
    def bit(node, d, padded, i):
        a, b = plain.counts.get(node(d), (0, 0)) if d <= DEPTH else (0, 0)
        if not a + b:
            return None
        deeper = bit(node, d + 1, padded, i)
        stop = 1.0 if d == DEPTH else math.exp(math.log(0.5) + log_kt(a, b) - plain.weighted(node(d)))
        own = (b + 0.5) / (a + b + 1)
        return own if deeper is None else stop * own + (1 - stop) * deeper

    padded, total = b"\n" * DEPTH + coded(text), 0.0
    for i in range(DEPTH, len(padded)):
        bits = f"{padded[i]:08b}"
        for k in range(8):
            p = bit(lambda d, i=i, bits=bits, k=k: (padded[i - d : i], bits[:k]), 0, padded, i)
            p = 0.5 if p is None else p
            total += math.log10(p if bits[k] == "1" else 1 - p)
    return total


def test_matches_plain_recursion(spark):
    rows = [(i, t) for i, t in enumerate(["The cat sat", "the  CAT\tsat on the mat", None, "", " \n", "été là-bas", "a", "the cat", "cat " * 40, "Zebra"])] * 2
    rows += [(None, "the mat"), (20, "x" * 300)]
    train = [t for i, t in rows if i is not None and i % 3 != 2]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as score", "'x' as row_key", "2 as key")
    got = context_tree.score(df.repartition(3), F.col("doc_id") % 3 != 2).collect()
    plain, counts = Plain(train), Counter(w for t in train for w in tokens(t))
    ends, total = len(train), len(train) + sum(counts.values())
    want = []
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 2)) for w in own) + math.log10((ends + 1) / (total + len(counts) + 2))
        want.append((str(i), len(own) + 1, sum(counts[w] > 0 for w in own) + 1, total, base, plain.log10(t)))
    found = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for a, b in zip(found, sorted(want), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4]) and a[5] == pytest.approx(b[5], abs=1e-3, rel=1e-4)


def test_rare_words_are_joined(spark, monkeypatch):
    rows = [(i, f"common common word{i % 7} only{i}") for i in range(50)] + [(3, "common common word3 only3")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(map(tuple, context_tree.score(df, F.col("doc_id") > 4).collect()))
    monkeypatch.setattr(context_tree, "FREQUENT", 4)
    got = sorted(map(tuple, context_tree.score(df, F.col("doc_id") > 4).collect()))
    assert [r[:4] for r in got] == [r[:4] for r in want] and all(a[4:] == pytest.approx(b[4:]) for a, b in zip(got, want, strict=True))


def test_scores_do_not_depend_on_what_tasks_hold(spark, monkeypatch):
    rows = [(i, f"the cat {i} sat on mat {i * i} once{i}") for i in range(60)] + [(3, "the cat 3 sat on mat 9 once3"), (61, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    plain = Plain([t for i, t in rows if i % 3 != 2])
    for bits in (22, 4):
        monkeypatch.setattr(context_tree, "SLOT_BITS", bits)
        got = context_tree.score(df.repartition(3), F.col("doc_id") % 3 != 2).collect()
        want = dict(rows)
        assert len(got) == len(rows)
        for r in got:
            score = plain.log10(want[r.doc_id])
            assert r.score == pytest.approx(score, rel=1e-5) and r.bits_per_byte == pytest.approx(-score / math.log10(2) / len(coded(want[r.doc_id])), rel=1e-5)


def test_contexts_seen_once_count(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abd")], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in context_tree.score(df, F.col("doc_id") == 1).collect()}
    plain = Plain(["abc"])
    plain_once = {i: sum_log10(plain, t) for i, t in ((1, "abc"), (2, "abd"))}
    assert got == {i: pytest.approx(x, rel=1e-5) for i, x in plain_once.items()}


def test_nothing_to_learn_and_empty_table(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in context_tree.score(df, F.lit(False)).collect()}
    assert got[1].score == pytest.approx(3 * 8 * math.log10(0.5)) and got[1].train_tokens == 0 and got[2].n_known == 0
    assert context_tree.score(df.limit(0), F.lit(True)).collect() == []


def test_held_out_texts_cost_less_than_by_token_counts(spark):
    rows = op4_context_tree(spark, "/root/testdata/sf0.1").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
