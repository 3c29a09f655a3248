"""The n-gram Jaccard join against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from lamina.llm import jaccard, queries
from lamina.llm.common import Scratch
from lamina.llm.components import components


def plain(rows, percent=90, width=3):
    """(n, component) of each (id, text) row, by all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * min(len(sets[i]), len(sets[j])) >= percent * max(len(sets[i]), len(sets[j])):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[k][0] for k in range(len(rows)) if root(k) == root(i) and rows[k][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids, default=None)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def made(seed=5):
    """Chains of copies with a few words changed, around the limit, and the odd cases."""
    r = random.Random(seed)
    words = ["of", "the", "and", *("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 9))) for _ in range(400))]
    rows, i = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "One"), (1005, "one two"), (1006, "two one"), (1007, "a b c d e f g h i j k l"), (1008, "a b c d e f g h i j k"), (1007, "other text here"), (None, "one two")], 0
    passage = [r.choice(words) for _ in range(60)]
    for _ in range(25):
        text = [r.choice(words) for _ in range(r.choice([12, 30, 60, 200, 900]))] + passage * r.randint(0, 1)
        for _ in range(r.choice([1, 2, 3, 14])):
            rows.append((i, " ".join(text)))
            i += 1
            for _ in range(r.choice([0, 1, max(1, len(text) // 80), max(1, len(text) // 60)])):
                text[r.randrange(len(text))] = r.choice(words)
    return rows


@pytest.mark.parametrize("block", [4096, 3])
def test_made(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = made()
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, n int, node string")
    assert found(jaccard.link(df)) == plain(rows)
    if block == 3:
        assert found(jaccard.link(df, percent=70)) == plain(rows, 70)
        assert jaccard.link(df.limit(0)).count() == 0


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(queries.op5_ngram_jaccard(spark, sf)) == plain(rows)


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_probes_stop_early_and_right():
    r = np.random.default_rng(9)
    for _ in range(300):
        t = np.unique(r.integers(0, 4000, r.integers(1, 3000)).astype(np.uint64))
        s = np.unique(np.concatenate([t[r.random(len(t)) < r.choice([0.5, 0.9, 0.97, 1])], r.integers(0, 4000, r.integers(0, 60)).astype(np.uint64)]))
        if len(s):
            s, t = sorted((s, t), key=len)
            both = len(np.intersect1d(s, t))
            assert jaccard.reaches(s, t, 90) == (100 * both >= 90 * (len(s) + len(t) - both))
