"""Token attribution and packing against direct encodings."""

import functools
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lamina.llm import packing, queries, tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "\n", "one", "a\n\n\n\nb. \n c", "é😀\nü, ß\n", "word " * 5000, "x" * 3000, "ΑΣ. ΑΣ,x <|endoftext|>, <|ENDOFTEXT|> a…. don't! it's, 12. ½! ́x \xa0 \xa0.y"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, 2) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1, 2), (None, "no id", 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, id int, length int")


def plain_sections(text, rule):
    enc = tokens.ByteTokens.shared(BYTES, public_tokenizers.PATTERN).encoding
    raw, out, spans, at = text.encode(), [], [], 0
    for line in raw.splitlines(keepends=True) if b"\r" not in raw else []:
        spans.append((at, at + len(line)))
        at += len(line)
    n, at = [0] * len(spans), 0
    for t in enc.encode_ordinary(text):
        size = len(enc.decode_single_token_bytes(t))
        held = [max(0, min(e, at + size) - max(s, at)) for s, e in spans]
        if rule == "majority":
            n[held.index(max(held))] += 1
        elif rule == "start":
            n[next(k for k, h in enumerate(held) if h)] += 1
        else:
            n[max(k for k, h in enumerate(held) if h)] += 1
        at += size
    return n, out


@pytest.mark.parametrize("rule", tokens.RULES)
def test_sections(spark, sf, docs, rule):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    text = {r["doc_id"]: r["text"] for r in table.collect()}
    for df, of in ((docs, lambda r: "no id" if r["doc_id"] is None else TEXTS[r["doc_id"]]), (table, lambda r: text[r["doc_id"]])):
        rows = tokens.count_documents(df, BYTES, public_tokenizers.PATTERN, rule).collect()
        assert len(rows) == df.count()
        for r in rows:
            want, _ = plain_sections((of(r) or "").replace("\x85", ""), rule)
            assert r["section_tokens"] == want and r["n_tokens"] == sum(want) and r["n_sections"] == len(want)
    rows = tokens.count_sections(docs, BYTES, public_tokenizers.PATTERN, rule).collect()
    for r in rows:
        t = "no id" if r["doc_id"] is None else TEXTS[r["doc_id"]]
        assert t[r["start"] : r["end"]] == t.splitlines(keepends=True)[r["section"]] and r["doc_rest"] == 0
    assert tokens.count_sections(docs.limit(0), BYTES, public_tokenizers.PATTERN).count() == 0


@given(st.lists(st.integers(1, 5), min_size=1, max_size=20), st.lists(st.integers(1, 7), min_size=1, max_size=20), st.sampled_from(tokens.RULES))
def test_attribution_keeps_the_sum(token_sizes, steps, rule):
    token_ends, cuts = np.cumsum(token_sizes), np.cumsum(steps)
    starts, ends = cuts[:-1][::2], cuts[1:][::2]  # sections with gaps between them
    n, rest = tokens.attribute(token_ends, starts, ends, rule)
    assert n.sum() + rest == len(token_ends)


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert set(by) == set(texts)
    for d, found in by.items():
        ids = [*tok.encode(texts[d] or "", add_special_tokens=False).ids, 0]
        want = [ids[at : at + 2048] for at in range(0, len(ids), 2048)]
        found.sort(key=lambda r: (r["piece"], r["sequence_id"]))
        assert {r["piece"] for r in found} == set(range(len(want)))
        for r in found:
            part = np.array(want[r["piece"]], "<u4").tobytes()
            assert (r["start"], r["length"], r["ids_crc32"]) == (2048 * r["piece"], len(part) // 4, zlib.crc32(part))
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins), -(-sum(r["length"] for r in rows) // 2048)


def test_packing(spark, docs):
    rows = packing.pack(docs, WORDS).collect()
    check_packing(rows, {**dict(enumerate(TEXTS)), None: "no id"})
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_packing_table(spark, sf):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n, least = check_packing(queries.op9_best_fit_packing(spark, sf).collect(), text)
    assert n <= least + 1


def test_evolution_saves_a_bin():
    r = np.random.default_rng(5)
    saved = 0
    for _ in range(6):
        cuts = np.sort(r.integers(400, 1248, (60, 1)), axis=1)
        half = r.integers(300, 2048 - cuts - 300)
        sizes = -np.sort(-np.concatenate([cuts, half, 2048 - cuts - half], axis=1).ravel())  # 60 bins would do
        e = packing.Evolution(sizes, 2048, 3)
        first = e.decreasing()
        best = e.generations(e.population(first, 0), 300)[0]
        assert e.score(best) >= e.score(first)
        assert (np.bincount(best, sizes) <= 2048).all() and (np.bincount(best) > 0).all()
        saved += first.max() - best.max()
    assert saved > 0


def test_islands_exchange_their_best(spark, monkeypatch):
    """Pieces of which best-fit-decreasing leaves bins above the bound, evolved as rows of islands."""
    r = np.random.default_rng(5)
    sizes = r.integers(520, 900, 900)
    rows = spark.createDataFrame([(k % 3, k, int(s)) for k, s in enumerate(sizes)], "cell long, uid long, length long")
    monkeypatch.setattr(packing, "EPOCHS", 3)
    got = packing._pack_cells(rows, 3, 2048, 1, packing.Scratch(spark)).collect()
    assert sorted((x["uid"], x["length"]) for x in got) == sorted(enumerate(sizes.tolist()))
    fill = defaultdict(int)
    for x in got:
        assert x["cell"] == x["uid"] % 3
        fill[x["cell"], x["bin"]] += x["length"]
    assert all(x["fill"] == fill[x["cell"], x["bin"]] <= 2048 for x in got)
    plain = [packing.Evolution(-np.sort(-sizes[c::3]), 2048, 0) for c in range(3)]
    assert len(fill) <= sum(e.decreasing().max() + 1 for e in plain) and any(e.decreasing().max() + 1 > e.least for e in plain)


CHARS = st.sampled_from([*"iIsSt1.,!|'<>%$#-x\u0130\u00df\u0307\u0338\u03a3\u03c3\u01c5\u1112\u1161\u00bd\u02bc \n\t\x85\xa0\x1f", "<|endoftext|>", "\u0130.", "I\u0307."])


@settings(deadline=None)
@given(st.lists(st.lists(CHARS, max_size=12).map("".join), min_size=1, max_size=30))
def test_ids_are_the_tokenizers(texts):
    from tokenizers import Tokenizer

    tok = kept_tokenizer(Tokenizer)
    got = packing.Encoder.shared(WORDS)(pa.array(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@functools.cache
def kept_tokenizer(kind):
    return kind.from_file(WORDS)


@settings(deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "\t", "\xa0", "\x1c", "\x85", "\r", "a", "1", "'s", "!", "\u3000"]), max_size=30).map("".join))
def test_long_runs_are_split_alike(text):
    enc = tokens.ByteTokens.shared(BYTES, public_tokenizers.PATTERN)
    before, tokens.LONG_RUN = tokens.LONG_RUN, re.compile("")
    try:
        assert enc.ids(text) == enc.encoding.encode_ordinary(text)
    finally:
        tokens.LONG_RUN = before


def test_very_long_runs():
    enc = tokens.ByteTokens.shared(BYTES, public_tokenizers.PATTERN)
    for text in (" " * 1_000_000, "\n " * 400_000 + "x", "a" + "\t" * 900_000 + " b"):
        assert enc.ends(text)[-1] == len(text)
