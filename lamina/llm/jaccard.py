"""N-gram Jaccard join by T-occurrence search with long lists set apart (DivideSkip).

Two documents of n and m shingles reach the wanted Jaccard similarity only when one occurs in at least T of the
other's inverted lists, T = ceil(90% of n). Of a document's n lists the T - 1 longest are set apart, the most that
DivideSkip can: a partner must then occur in at least one of the n - T + 1 short lists. Short lists are merged by sorting
them by shingle, where one common list makes a candidate; candidates are probed by binary search in the larger one's
sorted set, block by block, until the overlap is reached or out of reach.

1. One pass gives every document its set size, a fingerprint and a bit sketch of its set, and counts the shingles that
   are frequent inside blocks. Documents with one fingerprint are one node from then on.
2. The second pass emits each node's short lists. Rank decides what is short: frequent shingles last by count (their
   number is bounded and fixed, so they fit every task), before them long words first. Any rank gives the same links; a
   good one makes lists short.
3. Lists are merged. Sketches differ in at most as many bits as sets differ in shingles, so most pairs fall without a
   look at the sets. Of the survivors each node first probes only the nearest; the links found are merged to
   components, and then every survivor between different components is probed. So a group of copies costs as many
   probes as it has members, and no link between components is missed. Wider sketches, made only of the nodes that got
   this far, spare most of the remaining vain probes. Lists above BLOCK nodes are cut into a grid of
   block pairs, so a task's memory is bounded.

Sets hold 64-bit hashes of shingles (48 bits of them when pairs are probed), nodes are 64-bit fingerprints of sets; of N
different sets some two share one with a probability of about N * N / 2^65.

Defined results: a null, empty or blank text has no shingles and is linked with nothing, so its component is its own id;
texts with fewer words than a shingle have one, of all their words; repeated rows are linked with each other; rows
without an id get a row, and component null unless linked with one that has an id; shingles of equal rank are ordered by
their hashes; a very long text is one row of its task, and its set one of the next ones; only the id and text columns are
read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import Scratch, attach, lean
from lamina.llm.components import components

#: Frequent shingles that are sent to every task: at most this many, 16 bytes each.
FREQUENT = 1 << 17
#: Shingles among which occurrences are counted at once, and occurrences from which a shingle is reported.
COUNTED, REPORTED = 1 << 21, 4
#: Nodes of a list that are compared in one block.
BLOCK = 4096
SKETCH_BITS = 512
#: Shingles that are probed at once.
PROBED = 512
#: Bits of the filter by which documents whose sets are wanted are told before their sets are made.
FILTER_BITS = 1 << 24
MASK = (1 << 64) - 1


class WordHashes:
    """64-bit hashes of words, remembered while the task runs, up to a bound."""

    def __init__(self, most: int = 500_000):
        self.known, self.most = {}, most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if missing := set(words).difference(self.known):
            if len(self.known) + len(missing) > self.most:
                self.known, missing = {}, set(words)
            self.known.update((w, xxhash.xxh3_64_intdigest(w)) for w in missing)
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, width: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of a text's shingles, and the bytes of each one's words."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, size = hashes(words), np.fromiter(map(len, words), np.int64, len(words))
    k = min(width, len(words))
    out, total = np.full(len(words) - k + 1, k, np.uint64), np.zeros(len(words) - k + 1, np.int64)
    for i in range(k):
        out = mixed(out * np.uint64(0xD1342543DE82EF95) + h[i : i + len(out)])
        total += size[i : i + len(out)]
    out, at = np.unique(out, return_index=True)
    return out, total[at]


def fingerprint(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def sketch(shingles: np.ndarray) -> bytes:
    """A bit for each bucket that an odd number of shingles fall into."""
    n = np.bincount((shingles >> np.uint64(17)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS)
    return np.packbits(n & 1).tobytes()


def wide_sketch(shingles: np.ndarray) -> bytes:
    """A sketch of four bits and more for each shingle; a power of two, so that a wider one can be folded to it."""
    size = max(SKETCH_BITS, 1 << (4 * len(shingles) - 1).bit_length())
    n = np.bincount(((shingles >> np.uint64(13)) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits(n & 1).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two wide sketches differ, the wider one folded: no more than the shingles in which the sets do."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def packed(shingles: np.ndarray) -> bytes:
    """The upper six bytes of each hash, in order."""
    return shingles.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(">u8").ravel().astype(np.uint64)


def most_apart(total: np.ndarray | int, percent: int):
    """Shingles in which two sets of so many shingles together may differ: what is not shared, twice over."""
    union = total * 100 // (100 + percent)
    return total - 2 * (total - union)


def needed(n: np.ndarray | int, percent: int):
    """The least overlap with any partner that a set of n can have."""
    return (percent * n + 99) // 100


def _texts(b: pa.RecordBatch, step: int = 512) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for lo in range(0, b.num_rows, step):
        part = b.slice(lo, step)
        yield part, part["text"].cast(pa.binary()).to_pylist()


def _describe(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, and rows (without node) for shingles that are frequent inside a block of documents."""
    hashes, kept, n_kept = WordHashes(), [], 0

    def frequent() -> pa.RecordBatch | None:
        if not kept:
            return None
        s, n = np.unique(np.concatenate(kept), return_counts=True)
        s, n = s[n >= REPORTED], n[n >= REPORTED]
        if len(s) > FREQUENT:
            top = np.argpartition(-n, FREQUENT)[:FREQUENT]
            s, n = s[top], n[top]
        return pa.RecordBatch.from_arrays([pa.nulls(len(s), id_type), pa.nulls(len(s), pa.int64()), pa.nulls(len(s), pa.binary()), pa.array(n), pa.array(s.view(np.int64))], names=["id", "node", "bits", "n", "shingle"])

    for big in batches:
        id_type = big["id"].type
        for b, texts in _texts(big):
            sets = [shingle_set(t, width, hashes)[0] for t in texts]
            n = pa.array([len(s) for s in sets], pa.int64())
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets]), n, none], names=["id", "node", "bits", "n", "shingle"])
            for s in sets:
                kept.append(s)
                n_kept += len(s)
            if n_kept >= COUNTED:
                yield frequent()
                kept, n_kept = [], 0
    if kept:
        yield frequent()


def _short_lists(batches: Iterator[pa.RecordBatch], width: int, percent: int, frequent) -> Iterator[pa.RecordBatch]:
    """shingle and node of the short lists; nodes seen before in this task are left out."""
    hashes, seen = WordHashes(), set()
    common, count = frequent.value
    least = 1
    while needed(least + 1, percent) > least:  # sets too small to have a partner other than their like
        least += 1
    for big in batches:
        for _, texts in _texts(big):
            shingles, nodes, sizes = [], [], []
            for t in texts:
                s, size = shingle_set(t, width, hashes)
                if len(s) < least:
                    continue
                node = fingerprint(s)
                if node in seen:
                    continue
                seen.add(node)
                rank = np.zeros(len(s), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    rank = np.where(common[at] == s, count[at], 0)
                short = len(s) - needed(len(s), percent) + 1
                order = np.lexsort((s, -size, rank))[:short]
                shingles.append(s[order])
                nodes.append(node)
                sizes.append(short)
            if len(seen) > 1_000_000:
                seen = set()
            s = np.concatenate([np.empty(0, np.uint64), *shingles]).view(np.int64)
            at = pa.array(np.repeat(np.arange(len(nodes)), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(nodes, pa.int64()).take(at)], names=["shingle", "node"])


def _blocks(batches: Iterator[pa.RecordBatch], columns: list[str], least: int = 1 << 16) -> Iterator[pa.Table]:
    """Sorted rows in blocks that end where columns change."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) < least:
            continue
        t = pa.Table.from_batches(held)
        cut = _starts(t, columns)[-1]
        if cut:
            yield t.slice(0, cut).combine_chunks()
            held = t.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(t: pa.Table, columns: list[str]) -> np.ndarray:
    """Rows at which a new group begins."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in columns:
        x = t[c].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _bytes(t: pa.Table, column: str, width: int) -> np.ndarray:
    """A column of byte strings of one width as rows of 64-bit words."""
    whole = b"".join(t[column].to_pylist())
    return np.frombuffer(whole, np.uint64).reshape(-1, width // 8)


def _drop_single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle and node: each once, those of shingles with two nodes and more, and the list's size."""
    for t in _blocks(batches, ["shingle"]):
        node, shingle = t["node"].to_numpy(), t["shingle"].to_numpy()
        first = np.ones(len(shingle), bool)
        first[1:] = (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])
        t = t.filter(pa.array(first))
        starts = _starts(t, ["shingle"])
        sizes = np.diff(np.append(starts, t.num_rows))
        size = np.repeat(sizes, sizes)
        yield from t.append_column("size", pa.array(size)).filter(pa.array(size > 1)).to_batches()


def _survivors(batches: Iterator[pa.RecordBatch], percent: int, nearest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs inside the cells whose sizes and sketches allow the similarity. nearest: for each node only the one with
    the nearest sketch, and a pair of a node with itself where it is near to others only as their partner; else all
    pairs of nodes with different roots."""
    for t in _blocks(batches, ["shingle", "i", "j"], 1 << 15):
        starts = _starts(t, ["shingle", "i", "j"])
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
        n, block, bits = t["n"].to_numpy(), t["block"].to_numpy(), _bytes(t, "bits", SKETCH_BITS // 8)
        across = t["i"].to_numpy() != t["j"].to_numpy()
        root = t["root"].to_numpy()
        best, partner = np.full(len(n), 1 << 30), np.full(len(n), -1)
        near = np.zeros(len(n), bool)
        low, high = [], []
        at = np.arange(len(n))
        for shift in range(1, len(n)):
            at = at[at + shift < len(n)]
            at = at[group[at] == group[at + shift]]
            if not len(at):
                break
            other = at + shift
            small, large = np.minimum(n[at], n[other]), np.maximum(n[at], n[other])
            ok = (100 * small >= percent * large) & (~across[at] | (block[at] != block[other]))
            if not nearest:
                ok &= root[at] != root[other]
            x, y = at[ok], other[ok]
            differ = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            ok = differ <= most_apart(n[x] + n[y], percent)
            x, y, differ = x[ok], y[ok], differ[ok]
            if nearest:
                near[x] = near[y] = True
                closer = differ < best[y]
                best[y[closer]], partner[y[closer]] = differ[closer], x[closer]
            else:
                low.append(x)
                high.append(y)
        if nearest:
            y = np.flatnonzero(partner >= 0)
            x = partner[y]
            near[x] = near[y] = False
            rest = np.flatnonzero(near)
            x, y = np.concatenate([x, rest]), np.concatenate([y, rest])
        else:
            x, y = (np.concatenate([np.empty(0, np.int64), *p]).astype(np.int64) for p in (low, high))
        a, b = (t["node"].take(pa.array(p)).combine_chunks() for p in (x, y))
        yield from pa.table({"a": a, "b": b}).to_batches()


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose wide sketches allow the similarity."""
    for b in batches:
        total = (b["n_a"].to_numpy() + b["n_b"].to_numpy()).tolist()
        keep = [apart(x, y) <= most_apart(t, percent) for x, y, t in zip(b["wide_a"].to_pylist(), b["wide_b"].to_pylist(), total, strict=True)]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def reaches(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether the smaller set s and t reach the similarity: binary probes of s in t, until enough are met or too few are
    left."""
    wanted, both = -(-percent * (len(s) + len(t)) // (100 + percent)), 0
    for lo in range(0, len(s), PROBED):
        part = s[lo : lo + PROBED]
        at = np.minimum(np.searchsorted(t, part), len(t) - 1)
        both += int((t[at] == part).sum())
        if both >= wanted or both + len(s) - lo - len(part) < wanted:
            break
    return both >= wanted


def _probe(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs that reach the similarity."""
    for b in batches:
        keep = []
        for x, y in zip(b["set_a"], b["set_b"], strict=True):  # two sets at a time are unpacked
            s, t = sorted((unpacked(x.as_py()), unpacked(y.as_py())), key=len)
            keep.append(reaches(s, t, percent))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch], width: int, wanted) -> Iterator[pa.RecordBatch]:
    """node, set size, wide sketch and set of the documents that pass the filter."""
    hashes, bits, seen = WordHashes(), wanted.value, set()
    for big in batches:
        places = [big[c].to_numpy() for c in ("p0", "p1", "p2")]
        ok = np.logical_and.reduce([bits[p >> 3] >> (p & 7) & 1 for p in places]).astype(bool)
        for _, texts in _texts(big.filter(pa.array(ok)), 64):
            sets = {fingerprint(s): s for s in (shingle_set(t, width, hashes)[0] for t in texts)}
            sets = [s for k, s in sets.items() if k not in seen]
            seen.update(map(fingerprint, sets))
            yield pa.RecordBatch.from_arrays(
                [pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([wide_sketch(s) for s in sets], pa.binary()), pa.array([packed(s) for s in sets], pa.binary())],
                names=["node", "n", "wide", "set"],
            )


def _filter_places(column: str) -> list:
    """Three places of a value in the filter, null included."""
    value = F.coalesce(F.col(column).cast("string"), F.lit("\0"))
    return [F.pmod(F.xxhash64(value, F.lit(k)), F.lit(FILTER_BITS)).alias(f"p{k}") for k in range(3)]


def _filter_of(rows: DataFrame, column: str) -> np.ndarray:
    """The filter's bits; FILTER_BITS / 64 words at most reach the driver."""
    place = rows.select(F.explode(F.array(*_filter_places(column))).alias("p"))
    words = place.groupBy(F.expr("p div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def link(docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, n_equal (rows with the same set, itself included) and component_id, the smallest id
    that links reach."""
    spark = docs.sparkSession
    attach(spark)
    scratch = Scratch(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    described = scratch.save(source.mapInArrow(lean(partial(_describe, width=width)), f"id {kind}, node long, bits binary, n long, shingle long"))
    rows = described.filter("node is not null")
    nodes = rows.filter("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.min("bits").alias("bits"), F.min("n").alias("n"), F.count("*").alias("n_equal"))
    nodes = scratch.save(nodes)
    top = described.filter("node is null").groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    common, count = top["shingle"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(common)
    frequent = spark.sparkContext.broadcast((common[order], count[order]))

    short = source.select("text").mapInArrow(lean(partial(_short_lists, width=width, percent=percent, frequent=frequent)), "shingle long, node long")
    lists = short.repartition("shingle").sortWithinPartitions("shingle", "node").mapInArrow(lean(_drop_single), "shingle long, node long, size long")
    lists = scratch.save(lists.join(nodes.select("node", "n", "bits"), "node"))

    def cells(rows: DataFrame) -> DataFrame:
        blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
        block = F.pmod(F.xxhash64("node"), blocks).cast("int")
        grid = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        grid = grid.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        return grid.select("shingle", "i", "j", "block", "n", "node", "bits", "root").repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j", "n", "node")

    def pairs(rows: DataFrame, nearest: bool) -> DataFrame:
        found = cells(rows).mapInArrow(lean(partial(_survivors, percent=percent, nearest=nearest)), "a long, b long")
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    tried = scratch.save(pairs(lists.withColumn("root", F.col("node")), True))
    wanted = tried.select(F.col("a").alias("node")).union(tried.select("b")).distinct().join(nodes.select("node", "least"), "node")
    bits = spark.sparkContext.broadcast(_filter_of(wanted, "least"))
    made = source.select("text", *_filter_places("id")).mapInArrow(lean(partial(_sets, width=width, wanted=bits)), "node long, n long, wide binary, set binary")
    sets = scratch.save(made)  # a set that two tasks made, of rows that repeat an id, only repeats pairs

    def links(pairs: DataFrame) -> DataFrame:
        def both(pairs: DataFrame, *columns: str) -> DataFrame:
            for c in ("a", "b"):
                pairs = pairs.join(sets.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in columns]), c)
            return pairs

        near = scratch.save(both(pairs.filter("a <> b"), "n", "wide").mapInArrow(lean(partial(_near, percent=percent)), "a long, b long").distinct())
        return both(near, "set").mapInArrow(lean(partial(_probe, percent=percent)), "a long, b long")

    first = scratch.save(links(tried))
    roots = scratch.save(components(first, scratch))
    marked = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed_lists = marked.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("shingle")
    others = pairs(marked.join(mixed_lists, "shingle", "left_semi"), False)
    second = links(others.join(tried, ["a", "b"], "left_anti"))
    between = second.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    between = scratch.save(between.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct())
    merged = components(between, scratch).select(F.col("node").alias("root"), F.col("root").alias("top"))
    top_of = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(merged, "root", "left").withColumn("top", F.coalesce("top", "root"))
    least = top_of.groupBy("top").agg(F.min("least").alias("component_id"))
    linked = top_of.join(least, "top").select("node", "n_equal", "component_id")
    out = rows.select("id", "node", "n").join(linked, "node", "left")
    alone = F.col("n") == 0
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(alone, F.lit(1)).otherwise(F.col("n_equal")).cast("long").alias("n_equal"),
        F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
