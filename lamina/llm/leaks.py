"""Benchmark decontamination by template canonicalisation.

Texts become template tokens: numbers, units after numbers and names inside sentences give way to typed placeholders,
other words are lower-cased without their outer signs. Windows of WINDOW template tokens (with at least LITERAL words
among them) of every document are hash-joined to those of the benchmark; the words of one name are one token. Hits on
one diagonal (place in the document less place in the item) are compared token by token; runs of agreement around hits
that follow each other in document and item are chained, so that inserted and left out words do no harm. A match covers
COVERAGE of the item, and the slots inside its windows must be consistent, that is, one value of the item stands for one
value of the document and the other way round, in each type; or it has a run of EXACT tokens word for word. So questions
with other numbers or names are caught, and chance templates are not.

The benchmark's windows stay a table. Documents are searched in one pass for windows that pass a filter of fixed size,
those windows are hash-joined with the benchmark's, and the pairs so found are compared by their texts. So neither the
driver nor a task holds the benchmark, whatever its size.

Items that windows cannot find are found as a whole: an item shorter than a window by one window of its own width, one
with fewer literal words than LITERAL in each of its windows by all of its template. An item too short or too dense for
a window past its first two words (at a sentence's start a name is not told from a word), or with hardly a literal word
at all, is also or only found word for word, since the template of "12 + 7 = 19" is that of every sum.

Defined results: null or empty texts on either side match nothing; equal items match each for itself; repeated rows are
judged each on its own; of equally good matches of an item the one with more slots counts; a very long text is one row of
its task; an empty benchmark leaves all documents clean, and an empty table stays empty. find_leaks reads ids and texts
alone; drop_leaks passes on all columns, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from lamina.llm.common import Scratch, attach, column, fresh, kept, lean
from lamina.llm.jaccard import mixed

WINDOW = 8
LITERAL = 5
#: Share of an item's tokens that a match must cover, in percent.
COVERAGE = 50
#: Tokens that match by themselves if they agree word for word.
EXACT = 13
#: Bits of the filter of the benchmark's windows that every task gets: when it fills up, more windows are joined.
FILTER_BITS = 1 << 24
#: Fixed unit words.
UNITS = frozenset(
    "km m cm mm mi mile miles ft feet foot inch inches yard yards kg g mg lb lbs pound pounds oz ton tons l ml litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents "
    "percent % $ € £ mph kmh kb mb gb tb hz khz mhz ghz w kw mw v a °c °f degree degrees".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th)?%?", re.I)
OUTER = re.compile(r"^[^\w+$€£%°-]+|[^\w%$€£°]+$")
END = (".", "!", "?", ":", "…", "。")
LITERAL_KIND, NUM, UNIT, NAME = range(4)
#: What a hit on an entry of the index tells: a window of an item, all of its template, or all of its words.
PART, TEMPLATE, WORDS = range(3)
#: Told from the widths of template windows in hashes.
WORDS_SEED = 1000


class Words:
    """What each word can be, by a number for each word; remembered up to a bound."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self.clear()

    @classmethod
    def shared(cls) -> Words:
        """One memory for all tasks of a worker."""
        return kept(("template words",), cls)

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.hash, self.flags = np.empty(1 << 12, np.uint64), np.empty(1 << 12, np.uint8)

    def learn(self, words: set[str]) -> None:
        n = len(self.known)
        if n + len(words) > len(self.hash):
            self.hash, self.flags = (np.concatenate([x, np.empty(len(x) + len(words), x.dtype)]) for x in (self.hash, self.flags))
        for k, w in enumerate(words, n):
            self.known[w] = k
            self.hash[k], self.flags[k] = self.of(w)

    @staticmethod
    def of(word: str) -> tuple[int, int]:
        """Hash, and flags: 1 a number, 2 a unit, 4 capitalised, 8 ends a sentence, 16 a sign follows."""
        bare = word if word.isalpha() else OUTER.sub("", word) or word
        low = bare.lower()
        flags = 2 * (low in UNITS) + 4 * (bare[:1].isupper() and bare[1:2].islower())
        if bare is not word:
            flags += 16 * (not word.endswith(bare))
            flags += 8 * word.endswith(END) or 8 * word.rstrip("\"')]»”’").endswith(END)
        if not bare.isalpha() and NUMBER.fullmatch(bare):
            flags += 1
        return xxhash.xxh3_64_intdigest(low.encode()), flags

    def __call__(self, text: str) -> Template:
        parts = [line.split() for line in text.split("\n")]
        words = list(chain.from_iterable(parts))
        if not words:
            none = np.empty(0, np.uint64)
            return Template(none, np.empty(0, np.int8), none, none)
        if new := set(words).difference(self.known):
            if len(self.known) + len(new) > self.most:
                self.clear()
                new = set(words)
            self.learn(new)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        h, flags = self.hash[at], self.flags[at]
        number, unit, capital = (flags & k > 0 for k in (1, 2, 4))
        after = np.concatenate([[True], flags[:-1] & 8 > 0])
        starts = np.cumsum([len(p) for p in parts[:-1]], dtype=np.int64)
        after[starts[starts < len(words)]] = True
        kind = (capital & ~after) * np.int8(NAME)
        kind[1:][unit[1:] & number[:-1]] = UNIT
        kind[number] = NUM
        raw, name = h, kind == NAME
        goes_on = np.concatenate([[False], name[1:] & name[:-1] & (flags[:-1] & 16 == 0)])
        if goes_on.any():  # the words of one name become one token
            first = np.flatnonzero(~goes_on)
            place = np.arange(len(h)) - first[np.cumsum(~goes_on) - 1]
            h = np.add.reduceat(np.where(goes_on, mixed(h + place.astype(np.uint64)), h), first)
            kind = kind[first]
        return Template(raw, kind, h, np.where(kind == LITERAL_KIND, h, kind.astype(np.uint64)))


@dataclass
class Template:
    """raw: the values of all words; the kind and value of each token, and codes: the value of literals, the kind of slots."""

    raw: np.ndarray
    kind: np.ndarray
    value: np.ndarray
    code: np.ndarray

    def literals(self, width: int) -> np.ndarray:
        """Literal words in each window of width."""
        literal = np.concatenate([[0], np.cumsum(self.kind == LITERAL_KIND)])
        return literal[width:] - literal[:-width]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows with enough literal words."""
        n = len(self.code)
        width = min(WINDOW, n)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        ok = np.flatnonzero(self.literals(width) >= min(LITERAL, width))
        return ok, hashes(self.code, width)[ok]

    def whole(self, doc: Template, shift: int, tells: int) -> tuple[bool, int, int, int] | None:
        """Like compare, if all of this item's template or words lie in doc from shift on."""
        n, slots = len(self.code), self.kind != LITERAL_KIND
        a, b = (self.raw, doc.raw) if tells == WORDS else (self.value, doc.value)
        if shift < 0 or shift + len(a) > len(b):
            return None
        same = a == b[shift : shift + len(a)]
        if tells == WORDS:
            return (True, n, int(slots.sum()), 0) if same.all() else None
        alike = self.code == doc.code[shift : shift + n]
        if not (same | alike).all():
            return None
        at = np.flatnonzero(slots & alike)
        return consistent(pairs(self, doc, shift, at)), n, len(at), int((~same[at]).sum())

    def entries(self) -> list[tuple[int, int, int, int]]:
        """Hash, start, what a hit tells and width of what the index holds of an item."""
        n = len(self.code)
        if not n:
            return []
        width = min(WINDOW, n)
        at, h = self.windows()
        out = [(x, k, PART if n >= WINDOW else TEMPLATE, width) for k, x in zip(at.tolist(), h.tolist(), strict=True)]
        literal = self.literals(width)
        if n >= WINDOW and not out and literal.max() > 0:
            k = int(literal.argmax())
            out.append((int(hashes(self.code, width)[k]), k, TEMPLATE, width))
        if not (at >= 2).any():
            out.append((int(hashes(self.raw, min(WINDOW, len(self.raw)), WORDS_SEED)[0]), 0, WORDS, min(WINDOW, len(self.raw))))
        return out


def hashes(of: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hashes of all windows of width."""
    m = len(of) - width + 1
    h = np.full(m, width + seed, np.uint64)
    for k in range(width):
        h = mixed(h * np.uint64(0xD1342543DE82EF95) + of[k : k + m])
    return h


@dataclass
class Widths:
    """Which windows of documents the benchmark's entries can meet: dense ones of WINDOW tokens, shorter ones, words."""

    dense: bool
    short: list[int]
    words: list[int]

    @classmethod
    def of(cls, found: set[tuple[int, int]]) -> Widths:
        """By what entries tell and their width."""
        return cls((TEMPLATE, WINDOW) in found, sorted({w for tells, w in found if tells != WORDS and w < WINDOW}), sorted({w for tells, w in found if tells == WORDS}))

    def windows(self, doc: Template) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts and hashes."""
        n = len(doc.code)
        if n >= WINDOW:
            if self.dense:
                yield np.arange(n - WINDOW + 1), hashes(doc.code, WINDOW)
            else:
                yield doc.windows()
        for of, widths, seed in ((doc.code, self.short, 0), (doc.raw, self.words, WORDS_SEED)):
            for width in widths:
                if width <= len(of):
                    yield np.arange(len(of) - width + 1), hashes(of, width, seed)


class Index:
    """The same search in memory, for a few items and single texts."""

    def __init__(self, items: list[tuple[int, str]]):
        words = Words()
        self.items = [(i, words(t or "")) for i, t in items]
        found = [(h, k, at, tells, width) for k, (_, t) in enumerate(self.items) for h, at, tells, width in t.entries()]
        self.entries: dict[int, list[tuple[int, int, int]]] = {}
        for h, k, at, tells, _ in found:
            self.entries.setdefault(h, []).append((k, at, tells))
        self.widths = Widths.of({(tells, width) for *_, tells, width in found})

    def matches(self, doc: Template) -> list[tuple[int, int, int, int, int, bool]]:
        """(item id, tokens covered, item's tokens, slots, slots changed, consistent) of each item that doc matches."""
        hits: dict[int, list[tuple[int, int, int]]] = {}
        for starts, h in self.widths.windows(doc):
            for start, x in zip(starts.tolist(), h.tolist(), strict=True):
                for item, at, tells in self.entries.get(x, ()):
                    hits.setdefault(item, []).append((start, at, tells))
        found = [(i, judged(self.items[i][1], doc, h)) for i, h in sorted(hits.items())]
        return [(self.items[i][0], f[1], len(self.items[i][1].code), f[2], f[3], f[0]) for i, f in found if f]


def judged(item: Template, doc: Template, hits: list[tuple[int, int, int]]) -> tuple[bool, int, int, int] | None:
    """Whether slots are consistent, tokens covered, slots and changed slots of the best match of an item, given where
    its entries hit: (start in the document, place in the item, what it tells)."""
    best, diagonals = None, {}
    for start, at, tells in sorted(set(hits)):
        if tells == PART:
            diagonals.setdefault(start - at, set()).add(at)
        elif found := item.whole(doc, start - at, tells):
            best = max(best or (False,), found)
    found = compare(item, doc, diagonals) if diagonals else None
    return max(best or (False,), found) if found else best


def compare(item: Template, doc: Template, diagonals: dict[int, set[int]]) -> tuple[bool, int, int, int] | None:
    """Whether slots are consistent, tokens covered, slots and changed slots of the best match of an item whose
    windows hit at places by diagonal."""
    n, best, runs = len(item.code), None, []
    for shift, places in diagonals.items():
        lo, hi = max(0, -shift), min(n, len(doc.code) - shift)
        a, b = slice(lo, hi), slice(lo + shift, hi + shift)
        equal, slot, same, window = (np.zeros(n, bool) for _ in range(4))
        equal[a] = item.value[a] == doc.value[b]
        slot[a] = (item.code[a] == doc.code[b]) & (item.kind[a] != LITERAL_KIND)
        # A name at a sentence's start is a literal there; where only one side took it for a name, equal words still agree.
        same[a] = (item.code[a] == doc.code[b]) | equal[a]
        for k in places:
            window[k : k + WINDOW] = True
        here = []
        for s, e in stretches(same):
            if not window[s:e].any():
                continue
            while s < e and slot[s] and not equal[s]:  # what stands at the edge can be there by chance
                s += 1
            while s < e and slot[e - 1] and not equal[e - 1]:
                e -= 1
            at = np.flatnonzero(slot[s:e] & window[s:e]) + s
            here.append(Run(e - s, s, e, shift, pairs(item, doc, shift, at), len(at), int((~equal[at]).sum())))
            for x, y in stretches(equal[s:e]):
                if y - x >= EXACT:
                    best = max(best or (False,), (True, y - x, int(slot[s + x : s + y].sum()), 0))
        runs += here
        covered = int(same.sum())
        if 100 * covered >= COVERAGE * n:
            fits = consistent(set().union(*[r.pairs for r in here]))
            best = max(best or (False,), (fits, covered, sum(r.slots for r in here), sum(r.changed for r in here)))
    if len(runs) > 1 and not (best and best[0] and best[1] == n):
        found = chained(runs, n)
        best = max(best or (False,), found) if found else best
    return best


@dataclass
class Run:
    """Agreement around hits: tokens, where it begins and ends in the item, its diagonal, pairs of values, slots."""

    size: int
    start: int
    end: int
    shift: int
    pairs: set[tuple[int, int, int]]
    slots: int
    changed: int


def chained(runs: list[Run], n: int) -> tuple[bool, int, int, int] | None:
    """The first chain of consistent runs, from the longest run on, that covers enough of an item of n tokens. Runs of a
    chain follow each other in item and document, and lie within the document as near as a few items' length."""
    runs = sorted((r for r in runs if consistent(r.pairs)), key=lambda r: r.start + r.shift)
    places = [r.start + r.shift for r in runs]
    for k in sorted(range(len(runs)), key=lambda k: -runs[k].size):
        near = runs[bisect_left(places, places[k] - 2 * n - WINDOW) : bisect_right(places, places[k] + 2 * n + WINDOW)]
        if 100 * sum(r.size for r in near) < COVERAGE * n:
            continue
        chain, held = [runs[k]], runs[k].pairs
        for r in sorted(near, key=lambda r: -r.size):
            if all(follows(r, c) or follows(c, r) for c in chain) and (r.pairs <= held or consistent(held | r.pairs)):
                chain.append(r)
                held = held | r.pairs
        chain.sort(key=lambda r: r.start)
        covered, end, doc_end = 0, 0, 0
        for r in chain:
            covered += max(0, min(r.end - max(r.start, end), r.end + r.shift - max(r.start + r.shift, doc_end)))
            end, doc_end = r.end, r.end + r.shift
        if 100 * covered >= COVERAGE * n:
            return True, covered, sum(r.slots for r in chain), sum(r.changed for r in chain)
    return None


def follows(a: Run, b: Run) -> bool:
    """Whether a begins and ends after b, in item and document."""
    return a.start > b.start and a.end > b.end and a.start + a.shift > b.start + b.shift and a.end + a.shift > b.end + b.shift


def pairs(item: Template, doc: Template, shift: int, at: np.ndarray) -> set[tuple[int, int, int]]:
    """Kind, value in the item and value in the document of the slots at these places of the item."""
    return set(zip(item.kind[at].tolist(), item.value[at].tolist(), doc.value[at + shift].tolist(), strict=True))


def consistent(found: set[tuple[int, int, int]]) -> bool:
    return len({(k, x) for k, x, _ in found}) == len({(k, y) for k, _, y in found}) == len(found)


def stretches(of: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], of, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _bits(h: np.ndarray) -> list[np.ndarray]:
    """The filter's bits of hashes."""
    return [((h >> np.uint64(k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64) for k in (0, 20, 40)]


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words.shared()
    for b in batches:
        found = [(h, item, at, tells, width) for item, text in zip(b["item"].to_pylist(), b["text"].to_pylist(), strict=True) for h, at, tells, width in words(text or "").entries()]
        h = np.array([f[0] for f in found], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h), *(pa.array([f[c] for f in found], t) for c, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()), (4, pa.int32())))], names=["hash", "item", "at", "tells", "width"])


def _words_of_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    for b in batches:
        for p in _bits(b["hash"].to_numpy().view(np.uint64)):
            np.bitwise_or.at(bits, p >> 6, np.uint64(1) << (p & 63).astype(np.uint64))
    at = np.flatnonzero(bits)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view(np.int64))], names=["word", "bits"])


class Benchmark:
    """Items with a number each, their entries as a table to join with, and what documents are searched by: a filter of
    fixed size and the widths of windows."""

    def __init__(self, benchmark: DataFrame, id_col: str, text_col: str, scratch: Scratch):
        attach(benchmark.sparkSession)
        self.items = scratch.save(benchmark.select(F.monotonically_increasing_id().alias("item"), column(id_col).alias("item_id"), column(text_col).alias("text")))
        self.entries = scratch.save(self.items.select("item", "text").mapInArrow(lean(_entries), "hash long, item long, at int, tells int, width int"))
        self.widths = Widths.of({(r["tells"], r["width"]) for r in self.entries.select("tells", "width").distinct().collect()})  # a few kinds
        found = self.entries.select("hash").mapInArrow(lean(_words_of_filter), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        self.bits = np.zeros(FILTER_BITS // 64, np.int64)
        self.bits[found["word"].to_numpy()] = found["bits"].to_numpy()

    def search(self, docs: DataFrame, text_col: str, all_docs: bool) -> tuple[DataFrame, list[str]]:
        """Rows of docs (all, or those that pass the filter) with a number and whether they pass; and a row for each
        window that does: the document's number, its start and hash. Returns also the names of these four columns."""
        names = fresh(docs, "uid", "passes", "start", "hash")
        shared = docs.sparkSession.sparkContext.broadcast((self.bits.view(np.uint64), self.widths))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, (bits, widths) = Words.shared(), shared.value
            uid = TaskContext.get().partitionId() << 33
            for b in batches:
                uids, passes, rows = np.arange(uid, uid + b.num_rows), np.zeros(b.num_rows, bool), []
                uid += b.num_rows
                for k, text in enumerate(b[text_col].to_pylist()):
                    for starts, h in widths.windows(words(text or "")) if text else ():
                        ok = np.logical_and.reduce([bits[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1) for p in _bits(h)]).astype(bool)
                        if ok.any():
                            passes[k] = True
                            rows.append((np.full(int(ok.sum()), uids[k]), starts[ok], h[ok].view(np.int64)))
                whole = pa.RecordBatch.from_arrays([*b.columns, pa.array(uids), pa.array(passes), pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.int64())], names=[*b.schema.names, *names])
                yield whole if all_docs else whole.filter(pa.array(passes))
                if rows:
                    at, starts, h = (np.concatenate(x) for x in zip(*rows, strict=True))
                    none = [pa.nulls(len(at), t) for t in b.schema.types]
                    yield pa.RecordBatch.from_arrays([*none, pa.array(at), pa.nulls(len(at), pa.bool_()), pa.array(starts.astype(np.int32)), pa.array(h)], names=[*b.schema.names, *names])

        fields = [StructField(f.name, f.dataType) for f in docs.schema] + [StructField(n, t) for n, t in zip(names, (LongType(), BooleanType(), IntegerType(), LongType()), strict=True)]
        return docs.mapInArrow(lean(run), StructType(fields)), names

    def found(self, searched: DataFrame, text_col: str, names: list[str]) -> DataFrame:
        """uid, item and the numbers of judged() of each document and item that match. Windows are hash-joined with the
        entries; a pair's hits then meet both texts."""
        uid, passes, start, h = map(F.col, names)
        hits = searched.filter(start.isNotNull()).select(uid.alias("uid"), start.alias("start"), h.alias("hash"))
        pairs = hits.join(self.entries, "hash").groupBy("uid", "item").agg(F.collect_list(F.struct("start", "at", "tells")).alias("hits"))
        texts = searched.filter(passes).select(uid.alias("uid"), column(text_col).alias("doc_text"))
        pairs = pairs.join(texts, "uid").join(self.items.select("item", "text"), "item").select("uid", "item", "hits", "doc_text", "text")
        return pairs.mapInArrow(lean(_judge), "uid long, item long, n_covered long, n_item_tokens long, n_slots long, n_changed long")


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, names = Words.shared(), ["uid", "item", "n_covered", "n_item_tokens", "n_slots", "n_changed"]
    for b in batches:
        out, last, doc = [], None, None
        for uid, item, hits, doc_text, text in zip(*(b[c].to_pylist() for c in ("uid", "item", "hits", "doc_text", "text")), strict=True):
            if uid != last:
                last, doc = uid, words(doc_text)
            template = words(text)
            found = judged(template, doc, [(h["start"], h["at"], h["tells"]) for h in hits])
            if found and found[0]:
                out.append((uid, item, found[1], len(template.code), found[2], found[3]))
        yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(6)], names=names)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Per document and item that leaked into it: ids, tokens covered, the item's tokens, slots, changed slots and kind
    ("verbatim", or "changed" where slots hold other values)."""
    scratch = Scratch(docs.sparkSession)
    bench = Benchmark(benchmark, item_col, text_col, scratch)
    searched, names = bench.search(docs.select(column(id_col).alias("id"), column(text_col).alias("text")), "text", all_docs=False)
    searched = scratch.save(searched)
    changed = F.when(F.col("n_changed") > 0, "changed").otherwise("verbatim").alias("kind")
    out = bench.found(searched, "text", names).join(searched.filter(names[1]).select(F.col(names[0]).alias("uid"), "id"), "uid").join(bench.items.select("item", "item_id"), "item")
    return out.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "n_covered", "n_item_tokens", "n_slots", "n_changed", changed)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without those into which an item leaked. Columns stay as they are."""
    scratch = Scratch(docs.sparkSession)
    bench = Benchmark(benchmark, "item_id", "text", scratch)
    given, docs = docs.columns, docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names with dots do not reach Arrow
    text_col = docs.columns[given.index(text_col)]
    searched, names = bench.search(docs, text_col, all_docs=True)
    searched = scratch.save(searched)
    uid, passes = names[:2]
    bad = bench.found(searched, text_col, names).select(F.col("uid").alias(uid)).distinct()
    kept = searched.filter(~F.col(passes)).unionByName(searched.filter(passes).join(bad, uid, "left_anti"))
    return kept.select(*docs.columns).toDF(*given)
