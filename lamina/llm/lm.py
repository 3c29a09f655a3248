"""Language-model scoring by online logistic context mixing.

A text is the sequence of its lower-cased words and one end. Every token is coded by bits: words of a bounded dictionary
(the LEAVES - BUCKETS most frequent) have a Huffman code each, other known words share the codes of buckets, where the
bucket's counts tell the word, and words not met in training (with half of those met once) share one code and are then
spelled byte by byte. Where three words in a row occurred in another training document, what followed them there is expected here: one bit
tells whether it comes, predicted from how long the match has held, from the expected word and from the word before. If
not, all bits of the code follow, each predicted from its node by the node's frequency, and by the hashed contexts node
with the word before and node with the two words before. The predictions are mixed and refined as in mixing.py, by gates
of the bit's place and of which contexts were met. Spelled bytes have a mixer of their own, with contexts of one to three symbols and of the word so far.

What is gathered grows with the corpus and stays on the cluster: the vocabulary with its counts, and for matches the
words that followed each anchor (a context of three words whose hash says so, one in ANCHOR), of two documents each, so
that no document is matched with itself. Only models of fixed size are sent to tasks.

The model learns online, in blocks of BLOCK words, inside shards of about SHARD words. Which documents a shard has, and
in which order, depends on their ids and texts alone, and shards are merged by integer sums: so the result does not
depend on partitions.

Defined results: a null or blank text is the end alone; rows without an id are training rows; repeated rows count as
often as they occur and are not matched with each other; without training rows the base score is 0; an empty table
gives no rows; only the id and text columns are read. A very long text is one row of its shard and is held in memory
there. Of equally frequent words those of smaller hash come into the dictionary first.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import Scratch, attach, freed, lean
from lamina.llm.jaccard import mixed as mixed_hash
from lamina.llm.mixing import Block, Mixer, parts, summed

#: Codes; of them, those that words outside the dictionary share; the last code is that of words to spell.
LEAVES = 65535
BUCKETS = 16384
TOP = LEAVES - BUCKETS - 1
NONE = 65535
#: Places of a code's bits that have gates of their own; bits behind them share the last one's.
CODED = 32
#: Slots of the tables of word contexts; of matches: by how long one has held (DEEP at most), word expected, word before.
WORD_SLOTS = (1 << 20, 1 << 20)
DEEP = 16
MATCH_SLOTS = (DEEP * 16, 1 << 16, 1 << 16)
#: Slots of the tables of spelling contexts.
LETTER_SLOTS = (1 << 16, 1 << 18, 1 << 18, 1 << 20)
#: Text bytes whose words share a dictionary while they are counted.
CHUNK = 24 << 20
#: Words, and spelled words, of a shard; of a block.
SHARD, SPELLED_SHARD = 4_000_000, 500_000
BLOCK, SPELLED_BLOCK = 8192, 4096
#: One context in so many is an anchor; it holds so many words that followed.
ANCHOR, FOLLOWING = 16, 16
SPACE = 0x20
#: Of the number that stands for a word.
BASE = 0x9E3779B97F4A7C15


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as places in their chunk's dictionary (the most frequent first: places below 65535 take two bytes, the
    others follow in four), and the dictionary's rows."""
    part = TaskContext.get().partitionId() << 32
    n_chunks = 0
    numbers, docs = defaultdict(count(1).__next__, {b"": 0}), []
    held: list[pa.RecordBatch] = []

    def take(b: pa.RecordBatch) -> None:
        """Keeps a batch as copies of its short columns and the numbers of its words, not as text."""
        held.append(b.select(["id", "key", "held_out", "n_bytes"]).take(pa.array(range(b.num_rows))))
        for t in b["text"].cast(pa.binary()).to_pylist():
            words = (t or b"").lower().split()
            words.append(b"")
            docs.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal numbers, docs
        ids = pa.Table.from_batches(held).combine_chunks()
        words = list(numbers)
        numbers = defaultdict(count(1).__next__, {b"": 0})
        held.clear()
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        flat = np.concatenate(docs)
        n = np.bincount(flat, minlength=len(words))
        train = np.bincount(flat[np.repeat(~ids["held_out"].to_numpy(zero_copy_only=False), sizes)], minlength=len(words))
        del flat
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        short, long = [], []
        for p in docs:
            p = rank[p]
            short.append(np.minimum(p, 65535).astype("<u2").tobytes())
            long.append(p[p >= 65535].astype("<u4").tobytes())
        rows, docs = len(docs), []
        chunk = part + n_chunks
        for lo in range(0, rows, 2000):
            hi = min(rows, lo + 2000)
            given = {c: ids[c].slice(lo, hi - lo).combine_chunks() for c in ids.column_names}
            yield _rows(hi - lo, kind, chunk=np.full(hi - lo, chunk), **given, n_tokens=sizes[lo:hi], short=pa.array(short[lo:hi], pa.binary()), long=pa.array(long[lo:hi], pa.binary()))
        for lo in range(0, len(order), 50_000):
            c = order[lo : lo + 50_000]
            word = pa.array([words[k] for k in c.tolist()], pa.binary())
            yield _rows(len(c), kind, chunk=np.full(len(c), chunk), place=np.arange(lo, lo + len(c), dtype=np.int32), word=word, n_train=train[c])

    size = 0
    for big in batches:
        kind = big["id"].type
        for lo in range(0, big.num_rows, 64):
            b = big.slice(lo, 64)
            take(b)
            size += b["text"].nbytes
            if size >= CHUNK:
                yield from flush()
                n_chunks, size = n_chunks + 1, 0
    if held:
        yield from flush()


def _rows(n: int, id_type: pa.DataType, **given) -> pa.RecordBatch:
    kinds = {"chunk": pa.int64(), "id": id_type, "key": pa.int64(), "held_out": pa.bool_(), "n_bytes": pa.int64(), "n_tokens": pa.int64(), "short": pa.binary(), "long": pa.binary(), "place": pa.int32(), "word": pa.binary(), "n_train": pa.int64()}
    columns = []
    for name, kind in kinds.items():
        x = given.get(name)
        columns.append(pa.nulls(n, kind) if x is None else x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, kind))
    return pa.RecordBatch.from_arrays(columns, names=list(kinds))


class Code:
    """A Huffman code of weighted leaves, and for each bit on the way to a leaf its node. Ties are broken by number."""

    def __init__(self, weights: dict[int, int]):
        heap = [(w, k) for k, w in weights.items()]
        heapq.heapify(heap)
        up: dict[int, tuple[int, int]] = {}
        share: list[tuple[int, int]] = []
        while len(heap) > 1:
            (w0, a), (w1, b) = heapq.heappop(heap), heapq.heappop(heap)
            new = LEAVES + len(share)
            up[a], up[b] = (new, 0), (new, 1)
            share.append((w0, w1))
            heapq.heappush(heap, (w0 + w1, new))
        self.depth, self.start = np.zeros(LEAVES, np.int64), np.zeros(LEAVES, np.int64)
        node, bit, place = [], [], []
        for leaf in weights:
            path, at = [], leaf
            while at in up:
                at, side = up[at]
                path.append((at - LEAVES, side))
            path = path[::-1]
            self.start[leaf], self.depth[leaf] = len(node), len(path)
            node += [n for n, _ in path]
            bit += [side for _, side in path]
            place += [min(k, CODED - 1) for k in range(len(path))]
        self.node, self.bit, self.place = np.array(node, np.uint32), np.array(bit, np.uint8), np.array(place, np.uint8)
        w = np.array(share, np.float64).reshape(-1, 2)
        self.frequency = np.log(w[:, 1] / w[:, 0]).astype(np.float32)


class WordBits:
    """The tokens of a run of documents, with the words that matches let expect and the bits that code them."""

    def __init__(self, code: Code, leaves: list[bytes], expected: list[bytes]):
        self.code = code
        self.leaf = np.frombuffer(b"".join(leaves), "<u2").astype(np.int64)
        self.expected = np.frombuffer(b"".join(expected), "<u2").astype(np.int64)
        n = len(self.leaf)
        self.ends = np.cumsum([len(x) // 2 for x in leaves])
        first = np.zeros(n, bool)
        first[0] = True
        first[self.ends[:-1]] = True
        self.back = []
        before = self.leaf
        for _ in range(2):
            before = np.concatenate([[NONE], before[:-1]])
            before[first] = NONE
            self.back.append(before.astype(np.uint32))
        place = np.arange(n)
        broken = np.maximum.accumulate(np.where(self.leaf != self.expected, place, np.where(first, place - 1, -1)))
        self.run = np.minimum(place - 1 - np.concatenate([[-1], broken[:-1]]), DEEP - 1)
        self.run[first] = 0

    def matches(self, lo: int, hi: int) -> tuple[np.ndarray, Block]:
        """Of the tokens from lo to hi those where a word is expected, and whether it comes."""
        at = np.flatnonzero(self.expected[lo:hi] != NONE) + lo
        want, run = self.expected[at], self.run[at]
        before = (self.back[0][at] * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int64)
        starts = np.cumsum((0, *MATCH_SLOTS))
        slots = [run * 16 + np.minimum(self.code.depth[want], 15), want + starts[1], before + starts[2]]
        return at, Block((want == self.leaf[at]).astype(np.uint8), slots, run, run)

    def codes(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, Block]:
        """The bits of the tokens from lo to hi that did not come as expected; these tokens and how many each has."""
        c, mix = self.code, np.uint32(0x9E3779B1)
        tokens = np.flatnonzero(self.expected[lo:hi] != self.leaf[lo:hi]) + lo
        leaf = self.leaf[tokens]
        n = c.depth[leaf]
        at = np.repeat(c.start[leaf] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        node, k = c.node.take(at), c.place.take(at).astype(np.int64)
        one = (self.back[0][tokens] + np.uint32(1)) * np.uint32(0x85EBCA6B)
        two = (one ^ (self.back[1][tokens] + np.uint32(7)) * np.uint32(0xC2B2AE35)) * mix
        slots, start = [], 0
        for context, n_slots in zip((one, two), WORD_SLOTS, strict=True):
            h = np.repeat(context, n)
            h ^= node
            h *= mix
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h >>= np.uint32(33 - n_slots.bit_length())
            slots.append(h.astype(np.int64) + start)
            start += n_slots
        return tokens, n, Block(c.bit.take(at), slots, k, k, [c.frequency.take(node)])


class WordMixers:
    """The model of tokens: whether the expected word comes, and the bits of those that do not."""

    def __init__(self):
        self.matches, self.codes = Mixer(MATCH_SLOTS, 0, DEEP, DEEP), Mixer(WORD_SLOTS, 1, CODED, CODED, met=True)

    def learn(self, words: WordBits) -> None:
        for lo in range(0, len(words.leaf), BLOCK):
            self.matches.learn(words.matches(lo, lo + BLOCK)[1])
            self.codes.learn(words.codes(lo, lo + BLOCK)[2])

    def log10(self, words: WordBits) -> np.ndarray:
        """log10 probability of each token's code."""
        out = np.zeros(len(words.leaf))
        for lo in range(0, len(out), BLOCK):
            at, block = words.matches(lo, lo + BLOCK)
            out[at] += self.matches.log10(block)
            tokens, n, block = words.codes(lo, lo + BLOCK)
            out[tokens] += np.bincount(np.repeat(np.arange(len(n)), n), self.codes.log10(block), len(n))
        return out

    def numbers(self) -> list[np.ndarray]:
        return self.matches.numbers() + self.codes.numbers()

    def learnt(self) -> np.ndarray:
        return np.concatenate(self.numbers(), dtype=np.int64)

    def size(self) -> int:
        return self.matches.size() + self.codes.size()

    def merged(self, sums: np.ndarray) -> WordMixers:
        cut = self.matches.size()
        self.matches.merged(sums[:cut])
        self.codes.merged(sums[cut:])
        return self


class LetterBits:
    """The bits of a block of words to spell, each with its closing space, with the slots of their contexts."""

    def __init__(self, words: list[bytes]):
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.symbol = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.uint32)
        self.word = np.repeat(np.arange(len(words)), sizes)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.arange(len(self.symbol)) - first
        back = []  # the symbol k places back: of the word, then the space before it
        for k in range(1, 4):
            shifted = np.concatenate([np.zeros(k, np.uint32), self.symbol[:-k]])[: len(self.symbol)]
            back.append(np.where(place >= k, shifted, np.where(place == k - 1, np.uint32(SPACE), np.uint32(0))))
        # The word so far, as a number whose digits are its symbols: of the block's number the part behind the word's start.
        digit, inverse = (np.full(len(self.symbol), b, np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))
        digit[0] = inverse[0] = 1
        whole = np.cumsum((self.symbol.astype(np.uint64) + np.uint64(1)) * np.cumprod(digit))
        before = np.concatenate([np.zeros(1, np.uint64), whole[:-1]])
        so_far = (before - before[first]) * np.cumprod(inverse)[first] + place.astype(np.uint64)
        mix = np.uint32(0x9E3779B1)
        self.contexts = [back[0]]
        for k in range(1, 3):
            self.contexts.append(self.contexts[-1] * mix + back[k] + np.uint32(k))
        self.contexts.append((mixed_hash(so_far) >> np.uint64(32)).astype(np.uint32))

    @staticmethod
    def mixer() -> Mixer:
        return Mixer(LETTER_SLOTS, 0, 256, 256, met=True)

    def steps(self) -> Iterator[Block]:
        """Each of the eight bits of all symbols."""
        starts = np.cumsum((0, *LETTER_SLOTS))
        for k in range(8):
            so_far = (np.uint32(1) << np.uint32(k)) | (self.symbol >> np.uint32(8 - k))
            bit = ((self.symbol >> np.uint32(7 - k)) & np.uint32(1)).astype(np.uint8)
            salt, slots = so_far * np.uint32(0xC2B2AE35), []
            for c, n_slots, start in zip(self.contexts, LETTER_SLOTS, starts, strict=False):
                h = (c ^ salt) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(16)
                slots.append(((h * np.uint32(0x85EBCA6B)) >> np.uint32(33 - n_slots.bit_length())).astype(np.int64) + start)
            row = so_far.astype(np.int64)
            yield Block(bit, slots, row, row)


def spelled(mixer: Mixer, words: list[bytes]) -> np.ndarray:
    """log10 probability of spelling each word."""
    out = [np.empty(0)]
    for lo in range(0, len(words), SPELLED_BLOCK):
        bits = LetterBits(words[lo : lo + SPELLED_BLOCK])
        total = np.zeros(len(bits.symbol))
        for step in bits.steps():
            total += mixer.log10(step)
        out.append(np.bincount(bits.word, total))
    return np.concatenate(out)


def _learn_letters(key: tuple, words: pa.Table) -> pa.Table:
    """What a shard's words teach the speller, in their order."""
    m, words = LetterBits.mixer(), sorted(words["word"].to_pylist())
    order = np.random.default_rng(0).permutation(len(words))
    words = [words[k] for k in order]
    for lo in range(0, len(words), SPELLED_BLOCK):
        for step in LetterBits(words[lo : lo + SPELLED_BLOCK]).steps():
            m.learn(step)
    at, numbers = parts(m.numbers())
    return pa.table({"shard": pa.array([key[0].as_py()] * len(at), pa.int64()), "part": pa.array(at, pa.int32()), "numbers": pa.array(numbers, pa.binary())})


def leaf_of(h: np.ndarray, seen: np.ndarray, top: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The code of words by hash and count; top: the dictionary's hashes in order, with their codes."""
    leaf = TOP + ((h >> 20) & (BUCKETS - 1))
    leaf[(seen == 0) | ((seen == 1) & (h & 1 == 1))] = LEAVES - 1
    if len(top):
        at = np.minimum(np.searchsorted(top, h), len(top) - 1)
        leaf = np.where((top[at] == h) & (seen > 0), numbers[at], leaf)
    return leaf


def _code_documents(key: tuple, docs: pa.Table, words: pa.Table, shared) -> pa.Table:
    """A chunk's documents in codes, with the scores that do not depend on contexts: the base, and the rest that tells a
    word among those of its code."""
    top, numbers, totals, n_once, base, letters = shared.value
    words = words.take(np.argsort(words["place"].to_numpy()))
    seen, h = words["seen"].to_numpy(), words["h"].to_numpy()
    leaf = leaf_of(h, seen, top, numbers)
    rest = np.zeros(len(leaf))
    common = (leaf >= TOP) & (leaf < LEAVES - 1)
    rest[common] = np.log10(seen[common] / totals[leaf[common] - TOP])
    rare = leaf == LEAVES - 1
    rest[rare & (seen > 0)] = math.log10(0.5 / max(1, n_once))
    new = np.flatnonzero(seen == 0)
    rest[new] = spelled(letters, words["word"].take(new).to_pylist()) + math.log10(0.5)
    known, log = (seen > 0).astype(np.int64), np.log10(seen + 0.5) - base
    leaf = leaf.astype("<u2")
    out: dict[str, list] = {"n_known": [], "base_score": [], "rest": [], "leaves": []}
    for short, long in zip(docs["short"].to_pylist(), docs["long"].to_pylist(), strict=True):
        p = np.frombuffer(short, "<u2").astype(np.int64)
        p[p == 65535] = np.frombuffer(long, "<u4")
        out["n_known"].append(int(known[p].sum()))
        out["base_score"].append(float(log[p].sum()))
        out["rest"].append(float(rest[p].sum()))
        out["leaves"].append(leaf[p].tobytes())
    return pa.table({**{c: docs[c] for c in ("id", "key", "held_out", "n_bytes", "n_tokens")}, **out})


def _anchors(batches: Iterator[pa.RecordBatch], following: bool) -> Iterator[pa.RecordBatch]:
    """Anchors of each document: the context's hash, the document's key, and the words that follow or the place."""
    for b in batches:
        at, keys, places, after = [], [], [], []
        for key, raw in zip(b["key"].to_pylist(), b["leaves"].to_pylist(), strict=True):
            leaf = np.frombuffer(raw, "<u2").astype(np.uint64)
            if len(leaf) < 4:
                continue
            h = mixed_hash(leaf[:-3] << np.uint64(32) | leaf[1:-2] << np.uint64(16) | leaf[2:-1])
            p = np.flatnonzero(h % np.uint64(ANCHOR) == 0)
            at.append(h[p])
            keys.append(np.full(len(p), key))
            places.append(p + 3)
            if following:
                padded = np.concatenate([leaf, np.full(FOLLOWING, NONE, np.uint64)]).astype("<u2")
                after.append(padded[(p + 3)[:, None] + np.arange(FOLLOWING)])
        none = np.empty(0, np.int64)
        columns = [pa.array(np.concatenate([none.view(np.uint64), *at]).view(np.int64)), pa.array(np.concatenate([none, *keys]).astype(np.int64))]
        if following:
            data = np.concatenate([np.empty((0, FOLLOWING), "<u2"), *after])
            columns.append(pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * FOLLOWING), len(data), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary()))
        else:
            columns.append(pa.array(np.concatenate([none, *places]).astype(np.int32)))
        yield pa.RecordBatch.from_arrays(columns, names=["anchor", "key", "after" if following else "place"])


DOC_COLUMNS = ("id", "held_out", "n_bytes", "n_tokens", "n_known", "base_score", "rest", "leaves")


def _learn_words(key: tuple, docs: pa.Table, matches: pa.Table, shared) -> pa.Table:
    """A shard's documents with the words that matches let expect, and what its training documents teach."""
    code: Code = shared.value
    docs = docs.take(pa.array(np.argsort(docs["key"].to_numpy(), kind="stable")))
    leaves = docs["leaves"].to_pylist()
    keys, sizes = docs["key"].to_numpy(), np.fromiter((len(x) // 2 for x in leaves), np.int64, len(leaves))
    starts = np.cumsum(sizes) - sizes
    expected = np.full(int(sizes.sum()), NONE, "<u2")
    if matches.num_rows:
        found = matches.sort_by([("key", "ascending"), ("place", "ascending")])
        del matches
        for some in found.to_batches(max_chunksize=1 << 15):
            after = np.frombuffer(b"".join(some["after"].to_pylist()), "<u2").reshape(-1, FOLLOWING)
            lo, hi = (np.searchsorted(keys, some["key"].to_numpy(), side) for side in ("left", "right"))
            for copy in range(int((hi - lo).max())):  # rows that repeat id and text share a key
                has = np.flatnonzero(lo + copy < hi)
                doc = (lo + copy)[has]
                to = some["place"].to_numpy()[has][:, None] + np.arange(FOLLOWING)
                ok = (after[has] != NONE) & (to < sizes[doc][:, None])
                expected[(to + starts[doc][:, None])[ok]] = after[has][ok]
        del found, some, after
    expected = [expected[s : s + n].tobytes() for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    m = WordMixers()
    training = np.flatnonzero(~docs["held_out"].to_numpy(zero_copy_only=False)).tolist()
    for part in _slabs(training, sizes):
        m.learn(WordBits(code, [leaves[k] for k in part], [expected[k] for k in part]))
    at, numbers = parts(m.numbers())
    del m, leaves
    schema = pa.schema([*[(c, docs.schema.field(c).type) for c in DOC_COLUMNS], ("expected", pa.binary()), ("shard", pa.int64()), ("part", pa.int32()), ("numbers", pa.binary())])
    given = {c: docs[c] for c in DOC_COLUMNS} | {"expected": expected}
    more = {"shard": [key[0].as_py()] * len(at), "part": at, "numbers": numbers}
    rows = lambda found, n: pa.table({f.name: found[f.name] if isinstance(found.get(f.name), pa.ChunkedArray) else pa.array(found.get(f.name, [None] * n), f.type) for f in schema}, schema=schema)
    return pa.concat_tables([rows(given, docs.num_rows), rows(more, len(at))])


def _slabs(docs: list[int], sizes: np.ndarray, most: int = 64 * BLOCK) -> Iterator[list[int]]:
    """Documents in turn, in parts of about so many words."""
    part, n = [], 0
    for k in docs:
        part.append(k)
        n += int(sizes[k])
        if n >= most:
            yield part
            part, n = [], 0
    if part:
        yield part


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    code, m = shared.value
    for big in batches:
        leaves, expected = big["leaves"].to_pylist(), big["expected"].to_pylist()
        total = np.zeros(len(leaves))
        for part in _slabs(list(range(len(leaves))), np.fromiter((len(x) // 2 for x in leaves), np.int64, len(leaves))):
            bits = WordBits(code, [leaves[k] for k in part], [expected[k] for k in part])
            total[part] = np.add.reduceat(m.log10(bits), np.concatenate([[0], bits.ends[:-1]]))
        score = total + big["rest"].to_numpy()
        yield pa.RecordBatch.from_arrays([*[big[c] for c in DOC_COLUMNS[:6]], pa.array(score)], names=[*DOC_COLUMNS[:6], "score"])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities), and
    bits_per_byte (of the text's bytes and one for its end)."""
    spark = docs.sparkSession
    attach(spark)
    scratch, context = Scratch(spark), spark.sparkContext
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))
    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out.alias("held_out"), n_bytes.alias("n_bytes"), F.xxhash64(id_col, text_col).alias("key"))
    kind = source.schema["id"].dataType.simpleString()
    chunks = scratch.save(source.mapInArrow(lean(_chunks), f"chunk long, id {kind}, key long, held_out boolean, n_bytes long, n_tokens long, short binary, long binary, place int, word binary, n_train long"))
    texts = chunks.filter("n_tokens is not null").select("chunk", "id", "key", "held_out", "n_bytes", "n_tokens", "short", "long")

    # A word's rows are at most as many as chunks, so that no word is a burden to one task.
    rows = chunks.filter("place is not null").select("chunk", "place", "word", "n_train", F.xxhash64("word").alias("h"))
    whole = Window.partitionBy("h", "word")
    first = whole.orderBy("chunk")
    counted = rows.withColumn("first", F.row_number().over(first) == 1).withColumn("seen", F.sum("n_train").over(whole))
    needed = F.when(F.col("first") | (F.col("seen") == 0), F.col("word"))
    words = scratch.save(counted.select("chunk", "place", "seen", "h", "first", needed.alias("word")))
    vocabulary = words.filter("first and seen > 0")
    once = (F.col("seen") == 1) & (F.col("h").bitwiseAND(F.lit(1)) == 1)
    known = vocabulary.agg(F.sum("seen"), F.count("*"), F.count_if(once)).first()
    total, distinct, n_once = known[0] or 0, known[1], known[2]
    base = math.log10(total + 0.5 * (distinct + 1))
    top = vocabulary.filter("seen > 1").orderBy(F.desc("seen"), "h").limit(TOP).select("h", "seen").toArrow()
    bucket = F.shiftright("h", 20).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    filled = vocabulary.filter(~once).groupBy(bucket.alias("bucket")).agg(F.sum("seen").alias("n")).toArrow()
    h, n = top["h"].to_numpy().astype(np.int64), top["seen"].to_numpy().astype(np.int64)
    totals = np.zeros(BUCKETS, np.int64)
    totals[filled["bucket"].to_numpy().astype(np.int64)] = filled["n"].to_numpy()
    np.subtract.at(totals, (h >> 20) & (BUCKETS - 1), n)
    weights = dict(enumerate(n.tolist())) | {TOP + k: int(totals[k]) for k in np.flatnonzero(totals).tolist()} | {LEAVES - 1: max(1, n_once)}
    code = Code(weights)

    n_shards = max(1, -(-distinct // SPELLED_SHARD))
    spelling = vocabulary.select(F.pmod(F.shiftright("h", 8), F.lit(n_shards)).alias("shard"), "word").groupBy("shard").applyInArrow(lambda k, a: freed(_learn_letters(k, a)), "shard long, part int, numbers binary")
    letters = LetterBits.mixer()
    letters.merged(summed(spelling, n_shards, letters.size()))
    order = np.argsort(h)
    shared = context.broadcast((h[order], order, totals, n_once, base, letters))
    fields = f"id {kind}, key long, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, rest double, leaves binary"
    # cogroup's functions take no keywords
    coded = texts.groupBy("chunk").cogroup(words.select("chunk", "place", "seen", "h", "word").groupBy("chunk")).applyInArrow(lambda k, a, b: freed(_code_documents(k, a, b, shared)), fields)
    coded = scratch.save(coded)
    shared.destroy()
    scratch.drop(words)
    scratch.drop(chunks)

    size = coded.agg(F.sum("n_tokens")).first()[0] or 0
    n_shards = max(1, -(-size // SHARD))
    shard = F.pmod("key", F.lit(n_shards)).alias("shard")
    found = coded.filter("not held_out").select("key", "leaves").mapInArrow(lean(partial(_anchors, following=True)), "anchor long, key long, after binary")
    ends = [f(F.struct("key", "after")).alias(f"{c}") for c, f in (("low", F.min), ("high", F.max))]
    found = found.groupBy("anchor").agg(*ends)
    asked = coded.select("key", "leaves").mapInArrow(lean(partial(_anchors, following=False)), "anchor long, key long, place int")
    other = F.when(F.col("low.key") != F.col("key"), F.col("low.after")).when(F.col("high.key") != F.col("key"), F.col("high.after"))
    matches = asked.join(found, "anchor").select(shard, "key", "place", other.alias("after")).filter("after is not null")
    shared = context.broadcast(code)
    learnt = coded.select(shard, "key", *DOC_COLUMNS).groupBy("shard").cogroup(matches.groupBy("shard")).applyInArrow(lambda k, a, b: freed(_learn_words(k, a, b, shared)), fields.replace("key long, ", "") + ", expected binary, shard long, part int, numbers binary")
    learnt = scratch.save(learnt)
    shared.destroy()
    scratch.drop(coded)
    model = WordMixers()
    model.merged(summed(learnt.filter("part is not null").select("shard", "part", "numbers"), n_shards, model.size()))
    shared = context.broadcast((code, model))
    scored = learnt.filter("part is null").select(*DOC_COLUMNS, "expected").mapInArrow(lean(partial(_score, shared=shared)), f"id {kind}, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double")
    bits = (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte")
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.when(F.lit(total) > 0, F.col("base_score")).otherwise(0.0).alias("base_score"), "score", bits)
