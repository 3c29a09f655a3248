"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents become token ids and one closing id; only documents longer than a sequence are cut. Pieces that fill a whole
sequence stand alone. The others are dealt by hash into cells of about CELL pieces. Best-fit-decreasing starts a cell, and
where it needs no more bins than a lower bound says (or, in the first round, one more, whose pieces go on to the second),
the cell is done: evolution has nothing to gain. The other cells evolve: each has several populations (islands), which
are rows of a table and so tasks of their own. Crossover injects whole well-filled bins of one parent into the other,
drops the bins that would hold a piece twice, and best-fits the displaced pieces; mutation empties some bins. After each
epoch every island's best packing migrates to the next island through that table, until the bound is reached or epochs
bring no gain. Bins that stay under-filled are opened, and their pieces migrate to cells of a second round. A task holds
one cell or island, whatever the input.

Of equally large pieces the one read first comes first; of bins with equal room the one that got it last. Very long texts
are tokenized whole, alone in their part of a batch.

Defined results: a null or empty text is one piece with the closing id alone; repeated rows are packed each on its own;
an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import itertools
import unicodedata
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.common import Scratch, attach, freed, kept, lean

CAPACITY = 2048
CELL = 4096
#: Islands of a cell, members of each; epochs at most, and without a gain; children of an epoch.
ISLANDS, POPULATION = 4, 5
EPOCHS, PATIENCE = 6, 2
GENERATIONS = 12
#: Bins below this share of the capacity give their pieces to the second round.
WELL_FILLED = 0.985
#: Stems whose ids a worker remembers; the memory is emptied when full.
REMEMBERED = 500_000
SIGNS = ".,!?;:%$&#*|"


class Encoder:
    """Ids of texts. The tokenizer splits at white space and between letters and signs, and ignores case, so a text's
    ids are those of its words in turn, and a word's are those of its stem and of its closing signs. Words of many texts
    are told apart in Arrow; each distinct stem is encoded once and remembered for as long as its worker lives."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.stems = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True

    @classmethod
    def shared(cls, path: str) -> Encoder:
        return kept(("word encoder", path), lambda: cls(path))

    def encode_all(self, words: list[str]) -> list[bytes]:
        """Ids of each word, from one call: a word of letters ends with the token that ends a word; of other words the
        tokens' places tell."""
        found = self.tokenizer.encode("\n".join(words), add_special_tokens=False)
        ids = np.asarray(found.ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(words) and all(map(str.isalpha, words)):
            cuts = np.concatenate([[0], cuts])
        else:
            starts = np.cumsum([0] + [len(t) + 1 for t in words])
            cuts = np.searchsorted(np.fromiter((o[0] for o in found.offsets), np.int64, len(ids)), starts)
        raw, cuts = ids.tobytes(), (4 * cuts).tolist()
        return [raw[lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False)]

    def of_stems(self, stems: list[str]) -> list[bytes]:
        if new := set(stems).difference(self.stems):
            if len(self.stems) + len(new) > REMEMBERED:
                self.stems, new = {}, set(stems)
            for words in ([w for w in new if w.isalpha()], [w for w in new if not w.isalpha()]):
                for lo in range(0, len(words), 4000):
                    part = words[lo : lo + 4000]
                    self.stems.update(zip(part, self.encode_all(part), strict=True))
        return list(map(self.stems.__getitem__, stems))

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after the other, and how many each has."""
        special = pc.match_substring(words, "<|")  # may be a special token, which heeds case
        ascii = pc.equal(pc.binary_length(words), pc.utf8_length(words))  # else lower-casing comes after composing
        low = pc.if_else(pc.and_not(ascii, special), pc.ascii_lower(words), words)
        stem = pc.ascii_rtrim(low, SIGNS)
        ends, data = buffers(low)
        n_signs = pc.subtract(pc.binary_length(low), pc.binary_length(stem)).to_numpy()
        left = pc.binary_length(stem).to_numpy()
        cut = np.flatnonzero((n_signs > 0) & (n_signs <= 8) & (left > 0) & ~special.to_numpy(zero_copy_only=False))
        last = data[ends[cut] - n_signs[cut] - 1]
        fits = LETTER_OR_DIGIT[last]
        other = np.flatnonzero(last >= 128)
        fits[other] = [splits(x[-1]) for x in stem.take(pa.array(cut[other])).to_pylist()]
        cut = cut[fits]
        parted = np.zeros(len(words), bool)
        parted[cut] = True
        stems = pc.if_else(pa.array(parted), stem, low).dictionary_encode()
        ids = self.of_stems(stems.dictionary.to_pylist())
        signs = np.zeros(len(cut), np.uint64)
        for k in range(8):
            at = ends[cut] - 1 - k
            signs = np.where(k < n_signs[cut], signs << np.uint64(8) | data[np.maximum(at, 0)], signs)
        distinct, place = np.unique(signs, return_inverse=True)
        tail = np.full(len(words), len(ids) + len(distinct))
        tail[cut] = len(ids) + place
        ids += self.of_stems([x.tobytes().rstrip(b"\0").decode() for x in distinct.astype("<u8")])
        ids.append(b"")
        # The parts of each word follow each other.
        parts = np.stack([stems.indices.to_numpy(), tail], axis=1)
        flat, n = runs(ids, parts.ravel())
        return flat, n.reshape(-1, 2).sum(axis=1)

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit numbers."""
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        flat = words.flatten().dictionary_encode()
        ids, n = self.of_words(flat.dictionary)
        at = flat.indices.to_numpy()
        ends = np.cumsum(n)
        sizes = n[at]
        out = ids[np.repeat((ends - n)[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())].tobytes()
        bounds = 4 * np.concatenate([[0], np.cumsum(sizes)])[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return [out[lo:hi] for lo, hi in itertools.pairwise(bounds.tolist())]


def buffers(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each string ends in the bytes of all, and these."""
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int32)[words.offset + 1 : words.offset + 1 + len(words)].astype(np.int64)
    return ends, np.frombuffer(data or b"\0", np.uint8)


LETTER_OR_DIGIT = np.array([chr(k).isalnum() and k < 128 for k in range(256)])


def splits(last: str) -> bool:
    """Whether signs behind a stem that ends with this character are a token of their own: if it stays one letter or
    digit when lower-cased (some leave a mark behind, which goes with the signs)."""
    low = last.lower()
    return len(low) == 1 and unicodedata.category(low)[0] in "LN"


def runs(ids: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ids[k] for each k of at, one after the other, and how many each has."""
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    start, n = (np.cumsum(size) - size)[at], size[at]
    whole = np.frombuffer(b"".join(ids), "<u4")
    return whole[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def slices(b: pa.RecordBatch, most: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of text."""
    size = pc.binary_length(b["text"]).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // most
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [b.num_rows]]).tolist()
    for lo, hi in itertools.pairwise(cuts):
        if hi > lo:
            yield b.slice(lo, hi - lo)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length and crc32 of its ids."""
    attach(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.shared(tokenizer)
        for big in batches:
            for b in slices(big):
                rows, nos, starts, lengths, sums = [], [], [], [], []
                for k, ids in enumerate(encode(b["text"])):
                    ids += b"\0\0\0\0"
                    for no, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append(k)
                        nos.append(no)
                        starts.append(at // 4)
                        lengths.append(len(part) // 4)
                        sums.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [b["id"].take(pa.array(rows, pa.int64())), pa.array(nos, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(lean(cut), f"id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(order: np.ndarray, sizes: list[int], rooms: list[int], capacity: int) -> list[int]:
    """Puts items in the given order each into the tightest of the open bins (rooms, extended in place) or a new one;
    returns their bins. Bins of equal room share a stack, and a bit for each room tells which stacks hold any."""
    stacks: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(rooms):
        stacks.setdefault(r, []).append(b)
        mask |= 1 << r
    place = []
    for i in order:
        s = sizes[i]
        if m := mask >> s:
            r = s + (m & -m).bit_length() - 1
            stack = stacks[r]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << r)
        else:
            r, b = capacity, len(rooms)
            rooms.append(capacity)
        place.append(b)
        rooms[b] = left = r - s
        if left:
            stacks.setdefault(left, []).append(b)
            mask |= 1 << left
    return place


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """Martello and Toth's lower bound: for each k, pieces above capacity - k have a bin each, those above half of the
    capacity too, and of the pieces from k on the rest must go to what these leave or to further bins."""
    if not len(sizes):
        return 0
    s = np.sort(sizes)
    total = np.concatenate([[0], np.cumsum(s)])
    k = np.unique(np.concatenate([[0], s[s <= capacity // 2]]))
    half, above = np.searchsorted(s, capacity // 2, "right"), np.searchsorted(s, capacity - k, "right")
    above = np.maximum(above, half)
    room = (above - half) * capacity - (total[above] - total[half])
    rest = total[half] - total[np.searchsorted(s, k, "left")]
    return int((len(s) - half + np.maximum(0, -(-(rest - room) // capacity))).max())


class Evolution:
    """Populations of packings of one cell; a packing is the bin of each item, numbered without gaps."""

    def __init__(self, sizes: np.ndarray, capacity: int, seed: int):
        self.sizes, self.list, self.capacity, self.random = sizes, sizes.tolist(), capacity, np.random.default_rng(seed)
        self.least = least_bins(sizes, capacity)

    def decreasing(self, noise: float = 0.0) -> np.ndarray:
        key = -self.sizes * (1 + noise * self.random.standard_normal(len(self.sizes)))
        order = np.argsort(key, kind="stable")
        out = np.empty(len(order), np.int64)
        out[order] = best_fit(order, self.list, [], self.capacity)
        return out

    def score(self, packing: np.ndarray) -> tuple[int, float]:
        """Fewer bins first; then Falkenauer's measure, which favours full bins beside nearly empty ones."""
        fill = np.bincount(packing, self.sizes)
        return -len(fill), float(((fill / self.capacity) ** 2).sum() / len(fill))

    def repaired(self, packing: np.ndarray, out: np.ndarray) -> np.ndarray:
        """packing, with the items of out taken from their bins and best-fitted in again, largest first."""
        keep = np.ones(len(packing), bool)
        keep[out] = False
        bins, new = np.unique(packing[keep], return_inverse=True)
        rooms = (self.capacity - np.bincount(new, self.sizes[keep], len(bins)).astype(np.int64)).tolist()
        child = np.empty(len(packing), np.int64)
        child[keep] = new
        order = out[np.argsort(-self.sizes[out], kind="stable")]
        child[order] = best_fit(order, self.list, rooms, self.capacity)
        return child

    def crossed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a with a random half of b's well-filled bins injected whole."""
        fill = np.bincount(b, self.sizes)
        chosen = (fill >= np.quantile(fill, 0.5)) & (self.random.random(len(fill)) < 0.5)
        brought = chosen[b]
        if not brought.any():
            return a
        hit = np.zeros(a.max() + 1, bool)
        hit[a[brought]] = True
        child = np.where(brought, b + len(hit), a)
        return self.repaired(child, np.flatnonzero(hit[a] & ~brought))

    def mutated(self, a: np.ndarray) -> np.ndarray:
        """a without its emptiest bins and a few others, whose items are best-fitted in again."""
        fill = np.bincount(a, self.sizes)
        gone = (fill <= np.quantile(fill, 0.02)) | (self.random.random(len(fill)) < 0.03)
        return self.repaired(a, np.flatnonzero(gone[a]))

    def population(self, first: np.ndarray, island: int) -> list[np.ndarray]:
        """first, which every island has, and packings by sizes that noise has changed."""
        return [first, *(self.decreasing(0.05 * (1 + k + island)) for k in range(POPULATION - 1))]

    def generations(self, members: list[np.ndarray], n: int) -> list[np.ndarray]:
        """The members after so many children, each of which replaces the worst member if it is better; best first. A
        packing that meets the lower bound ends it."""
        members = sorted(members, key=self.score, reverse=True)
        scores = [self.score(m) for m in members]
        for _ in range(n):
            if -scores[0][0] <= self.least:
                break
            a, b = self.random.permutation(len(members))[:2]
            child = self.mutated(self.crossed(members[min(a, b)], members[max(a, b)]))
            score = self.score(child)
            if score > scores[-1] and score not in scores:
                at = next(k for k, s in enumerate(scores) if score > s)
                members = [*members[:at], child, *members[at:-1]]
                scores = [*scores[:at], score, *scores[at:-1]]
        return members


def _start(key: tuple, cell: pa.Table, capacity: int) -> pa.Table:
    """A cell's pieces, largest first, with their bins by best-fit-decreasing, as one row."""
    uid, size = cell["uid"].to_numpy(), cell["length"].to_numpy()
    order = np.lexsort((uid, -size))
    sizes = size[order]
    e = Evolution(sizes, capacity, 0)
    packing = e.decreasing()
    row = {"cell": [key[0].as_py()], "uids": [uid[order].astype("<i8").tobytes()], "sizes": [sizes.astype("<u4").tobytes()], "packing": [packing.astype("<u4").tobytes()], "n_bins": [int(packing.max()) + 1], "least": [e.least]}
    return pa.table(row, schema=_schema(CELL_FIELDS))


CELL_FIELDS = {"cell": pa.int64(), "uids": pa.binary(), "sizes": pa.binary(), "packing": pa.binary(), "n_bins": pa.int64(), "least": pa.int64()}
ISLAND_FIELDS = {"cell": pa.int64(), "island": pa.int32(), "sizes": pa.binary(), "members": pa.list_(pa.binary()), "n_bins": pa.int64(), "least": pa.int64()}


def _schema(fields: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(fields.items()))


def _evolve(batches: Iterator[pa.RecordBatch], capacity: int, seed: int) -> Iterator[pa.RecordBatch]:
    """One epoch of each island."""
    numbers = lambda raw: np.frombuffer(raw, "<u4").astype(np.int64)
    for b in batches:
        for row in b.to_pylist():
            e = Evolution(numbers(row["sizes"]), capacity, [seed, row["cell"], row["island"]])
            members = [numbers(m) for m in row["members"]]
            members = e.generations(members if len(members) > 1 else e.population(members[0], row["island"]), GENERATIONS)
            row |= {"members": [m.astype("<u4").tobytes() for m in members], "n_bins": int(members[0].max()) + 1}
            yield pa.RecordBatch.from_pylist([row], _schema(ISLAND_FIELDS))


def _evolved(hard: DataFrame, n_hard: int, capacity: int, seed: int, scratch: Scratch) -> DataFrame:
    """cell and packing of the cells that best-fit-decreasing left above the lower bound. Each island of each cell is a
    row and evolves on its own; after an epoch its best packing migrates to the next island of the cell, where it takes
    the place of the worst."""
    state = hard.select("cell", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "sizes", F.array("packing").alias("members"), "n_bins", "least")
    fields = "cell long, island int, sizes binary, members array<binary>, n_bins long, least long"
    bins, idle = None, 0
    for epoch in range(EPOCHS):
        now = scratch.save(state.repartition(spread(scratch.spark, n_hard * ISLANDS), "cell", "island").mapInArrow(lean(partial(_evolve, capacity=capacity, seed=seed + epoch)), fields))
        reached = now.groupBy("cell").agg(F.min("n_bins").alias("n"), F.min("least").alias("least")).agg(F.sum("n"), F.sum("least")).first()
        idle = idle + 1 if reached[0] == bins else 0
        bins = reached[0]
        if bins <= reached[1] or idle >= PATIENCE:
            break
        migrants = now.select("cell", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("members")[0].alias("migrant"))
        state = now.join(migrants, ["cell", "island"]).withColumn("members", F.concat(F.slice("members", 1, POPULATION - 1), F.array("migrant"))).drop("migrant").select(*ISLAND_FIELDS)
    return now.groupBy("cell").agg(F.min_by(F.col("members")[0], F.struct("n_bins", "island")).alias("packing"))


def _rows_of_cells(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            uid = np.frombuffer(row["uids"], "<i8")
            sizes, packing = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("sizes", "packing"))
            fill = np.bincount(packing, sizes).astype(np.int64)[packing]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(uid), row["cell"])), pa.array(uid), pa.array(sizes), pa.array(packing), pa.array(fill)], names=["cell", "uid", "length", "bin", "fill"])


def spread(spark: SparkSession, n: int) -> int:
    """Tasks for so many cells or islands, which are few bytes and much work."""
    return max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, n // 16)))


def _pack_cells(rows: DataFrame, n_cells: int, capacity: int, seed: int, scratch: Scratch, passed_on: int = 0) -> DataFrame:
    """Adds bin and fill to rows of cell, uid and length. passed_on: bins above the bound that need no evolution, since
    their pieces go on to another round."""
    start = lambda key, cell: freed(_start(key, cell, capacity))
    cells = scratch.save(rows.repartition(spread(scratch.spark, n_cells), "cell").groupBy("cell").applyInArrow(start, "cell long, uids binary, sizes binary, packing binary, n_bins long, least long"))
    hard = cells.filter(F.col("n_bins") > F.col("least") + passed_on)
    if n_hard := hard.count():
        better = _evolved(hard, n_hard, capacity, seed, scratch).withColumnRenamed("packing", "better")
        cells = cells.join(better, "cell", "left").withColumn("packing", F.coalesce("better", "packing"))
    return cells.select("cell", "uids", "sizes", "packing").mapInArrow(lean(partial(_rows_of_cells, capacity=capacity)), "cell long, uid long, length long, bin long, fill long")


def _dealt(rows: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """Rows with their cell, and the number of cells."""
    cells = max(1, -(-rows.count() // CELL))
    return rows.select(F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(cells)).alias("cell"), "uid", "length"), cells


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id and offset."""
    scratch = Scratch(docs.sparkSession)
    cut = scratch.save(pieces(docs, tokenizer, capacity, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()))
    short = cut.filter(F.col("length") < capacity).select("uid", "length")
    first = scratch.save(_pack_cells(*_dealt(short, 1), capacity, 1, scratch, 1))
    good = F.col("fill") >= int(WELL_FILLED * capacity)
    loose = first.filter(~good)
    second = _pack_cells(*_dealt(loose, 2), capacity, 1 << 20, scratch)
    # Bins are numbered by round, cell and bin; a cell has fewer bins than 2^20.
    number = lambda r: (F.col("cell") * F.lit(1 << 20) + F.col("bin")) * 4 + r
    placed = first.filter(good).withColumn("sequence_id", number(1)).unionByName(second.withColumn("sequence_id", number(2)))

    w = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.select("uid", "sequence_id", F.coalesce(F.sum("length").over(w), F.lit(0)).alias("offset"))
    full = cut.filter(F.col("length") == capacity).withColumn("sequence_id", F.col("uid") * 4).withColumn("offset", F.lit(0).cast("long"))
    some = cut.filter(F.col("length") < capacity).join(offsets, "uid")
    return full.unionByName(some).drop("uid").withColumnRenamed("id", id_col)
