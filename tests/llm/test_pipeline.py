"""The pipeline against plain Python, stage by stage."""

import re

import corpus_pipeline
import pytest
from lamina.llm import quality
from test_jaccard import plain
from test_native import base_spans, stats
from test_tokens_packing import check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage hands on."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    repeated = docs.limit(3)
    odd = spark.createDataFrame([(None, "A row without an id has words, too, and stays where it is.", "en", "x", 5), (10**6, None, "en", "x", None)], docs.schema)
    docs = docs.unionByName(repeated).unionByName(odd)
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        out.append(docs.collect())
    return out


def test_quality(steps):
    before, after = steps[0], steps[1]
    kept = {r["doc_id"] for r in after}
    for r in before:
        n = stats(r["text"] or "")
        if n[0] < quality.MIN_WORDS or 100 * n[4] > quality.MAX_REPEAT_PERCENT * n[0]:
            assert r["doc_id"] not in kept
    assert after and all(r["n_chars"] == len(r["text"]) for r in after if r["doc_id"] not in {x["doc_id"] for x in before if x["text"] == r["text"]})


def test_near_duplicates(steps):
    rows = [(r["doc_id"], r["text"]) for r in steps[1] if r["doc_id"] is not None]
    want = {c for _, n, c in plain(rows, 80, 5)}
    after = [r["doc_id"] for r in steps[2]]
    assert sorted(x for x in after if x is not None) == sorted(want) and None in after


def test_leaks(steps, spark):
    norm = lambda t: f" {' '.join(t.lower().split())} "
    items = [norm(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r["doc_id"] for r in steps[3]}
    assert not any(x in norm(r["text"]) for r in steps[3] for x in items)
    windows = {w for x in items for k in range(len(x.split()) - 5) for w in [" ".join(x.split()[k : k + 6])]}
    for r in steps[2]:
        if r["doc_id"] not in left:
            assert any(w in norm(r["text"]) for w in windows)


def test_secrets(steps):
    assert len(steps[4]) == len(steps[3])
    assert not any(base_spans(r["text"]) for r in steps[4])
    text = {r["doc_id"]: r["text"] for r in steps[3]}
    for r in steps[4]:
        assert r["text"] == text[r["doc_id"]] or "[SECRET]" in r["text"]


def test_packing(steps):
    check_packing(steps[5], {r["doc_id"]: r["text"] for r in steps[4]})


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())
    assert len({r["doc_id"] for r in rows}) < 200 and re.fullmatch(r"\w+", corpus_pipeline.STAGES[0][0])


def test_stages_with_odd_rows_and_columns(spark):
    """Every stage on nulls, repeated rows and ids, columns whose names clash or have dots, and on an empty table."""
    good = "A clean line of words that ends well and says a thing.\nAnother clean line of other words follows here."
    rows = [(1, good, "x", 1, 2), (1, good, "x", 1, 2), (2, good, "y", 1, 2), (2, "An other text of the same id which has enough words of its own.", "y", 1, 2), (None, good, "z", 1, 2), (3, None, None, None, None), (4, "", "", 0, 0), (5, good.replace("thing", "user=alice password: hunter22 thing"), "x", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, quality int, rows int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        found = out.collect()
        if name == "near_duplicates":
            kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in found)
            assert [k[1] for k in kept if not k[0]].count(1) == 1 and any(k[0] for k in kept)
            assert {r["a.b"] for r in found if r["doc_id"] == 2} <= {"y"}
        if name == "secret_scan":
            assert len(found) == len(rows) and any("[SECRET]" in (r["text"] or "") for r in found)
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


def test_a_lean_task_gives_its_memory_back():
    import subprocess
    import sys

    script = """
import os, sys
sys.path.insert(0, sys.argv[1])
from lamina.llm import common
resident = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
last = []
def run(batches):
    blocks = [bytearray(b"x" * 100_000) for _ in range(2000)]
    last.append(bytearray(100_000))  # stands above them, so that they are not the end of the heap
    yield from batches
before = resident()
assert list((common.lean(run) if sys.argv[2] == "lean" else run)(iter([1, 2]))) == [1, 2]
print(resident() - before)
"""
    root = str(__import__("pathlib").Path(__file__).resolve().parents[2])
    grown = [int(subprocess.run([sys.executable, "-c", script, root, how], capture_output=True, text=True, check=True).stdout) for how in ("plain", "lean")]
    assert grown[1] < 40 < grown[0]


def test_batches_are_bounded_by_bytes(spark):
    import pyarrow as pa
    from lamina.llm.common import Scratch
    from pyspark.sql import functions as F

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    found = Scratch(spark).save(rows.mapInArrow(sizes, "rows long, bytes long")).collect()
    assert sum(r["rows"] for r in found) == 3000 and max(r["bytes"] for r in found) < 5 << 20
    assert spark.conf.get(key) == before
