"""Language-model scoring: the base by hand, the model bit by bit, by its probabilities and by held-out texts."""

import heapq
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from lamina.llm import lm, mixing, queries


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), ""]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def plain(rows):
    n = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    total, distinct = sum(n.values()), len(n)
    out = []
    for i, t in rows:
        ws = tokens(t)
        base = sum(math.log10((n[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws) if total else 0.0
        out.append((i, held(i), len(ws), sum(n[w] > 0 for w in ws), total, base))
    return out


def check(df, rows):
    got = sorted(df.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["base_score"]))
    want = sorted(plain(rows), key=lambda r: (r[0] is None, r[0], r[2], r[5]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert tuple(g[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")) == w[:5]
        assert g["base_score"] == pytest.approx(w[5], rel=1e-9) and g["score"] < 0 < g["bits_per_byte"]
    return got


def test_table(spark):
    sf = "/root/testdata/sf0.01"  # on less text the base's one constant for all unknown words beats any spelling
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = check(queries.op4_lm_scoring(spark, sf), rows)
    size = {i: len((t or "").encode()) + 1 for i, t in rows}
    for r in got:
        assert r["bits_per_byte"] == pytest.approx(-r["score"] / math.log10(2) / size[r["doc_id"]])
    known = [r for r in got if r["held_out"] and r["n_known"] == r["n_tokens"]]
    for part in ([r for r in got if not r["held_out"]], [r for r in got if r["held_out"]], known):
        assert sum(r["score"] for r in part) > sum(r["base_score"] for r in part)


def test_partitions_do_not_matter(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(120)
    found = [sorted(tuple(r) for r in lm.score(df.repartition(n)).collect()) for n in (1, 8, 61)]
    assert found[0] == found[1] == found[2]


ODD = [(1, None), (2, ""), (3, " \n"), (4, "A b a B c"), (4, "A b a B c"), (None, "x é y"), (5, "b " * 3000 + "z" * 30000), (9, "é b")]


def test_odd_rows(spark):
    df = spark.createDataFrame([(a, b, 1, "w") for a, b in ODD], "doc_id long, text string, chunk int, word string")
    check(lm.score(df), ODD)
    assert lm.score(df.limit(0)).count() == 0
    alone = lm.score(df.filter("doc_id = 9")).first()
    assert alone["score"] < 0 and alone["held_out"] == held(9)
    nobody = next(i for i in range(100) if held(i))
    row = lm.score(spark.createDataFrame([(nobody, "never trained")], "doc_id long, text string")).first()
    assert row["train_tokens"] == 0 and row["base_score"] == 0 and row["score"] < 0


def test_order_matters(spark):
    r = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(r.choice(words, 80)) for _ in range(40)]
    copies = [i for i in range(1000, 1200) if held(i)][:2]
    shuffled = texts[0].split()
    r.shuffle(shuffled)
    rows = [(i, t) for i, t in enumerate(texts) if not held(i)] + [(copies[0], texts[0]), (copies[1], " ".join(shuffled))]
    got = {x["doc_id"]: x for x in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[copies[0]]["base_score"] == pytest.approx(got[copies[1]]["base_score"])
    assert got[copies[0]]["score"] > 0.6 * got[copies[1]]["score"]


class PlainMixer:
    """mixing.Mixer bit by bit, with contexts in place of slots and in double precision."""

    def __init__(self, n_tables, n_given, met):
        self.n = [defaultdict(lambda: [0, 0]) for _ in range(n_tables)]
        self.width, self.met = n_tables + n_given, met
        self.w = defaultdict(lambda: [0.35] * self.width)
        self.squares = defaultdict(lambda: [1e-4] * self.width)
        self.came = defaultdict(lambda: [0, 0])
        self.refine = False

    @staticmethod
    def stretched(n0, n1):
        n = n0 + n1
        return math.log((n1 + 0.05) / (n0 + 0.05)) * n / (n + 0.5)

    def mixed(self, contexts, given, gate):
        x = [self.stretched(*t[c]) for t, c in zip(self.n, contexts, strict=True)]
        gate = (gate, sum(p != 0 for p in x)) if self.met else gate
        x += given
        return x, gate, min(12, max(-12, sum(w * p for w, p in zip(self.w[gate], x, strict=True))))

    @staticmethod
    def level(mix):
        return int((mix + 12) * (mixing.LEVELS - 1) / 24 + 0.5)

    def learn(self, block):
        made = [(bit, contexts, row, *self.mixed(contexts, given, gate)) for bit, contexts, given, gate, row in block]
        slope, seen = defaultdict(lambda: [0.0] * self.width), Counter()
        for bit, contexts, row, x, gate, mix in made:
            error = bit - 1 / (1 + math.exp(-mix))
            seen[gate] += 1
            self.came[row, self.level(mix)][bit] += 1
            for k, p in enumerate(x):
                slope[gate][k] += error * p
            for t, c in zip(self.n, contexts, strict=True):
                t[c][bit] += 1
        for gate, n in seen.items():
            for k in range(self.width):
                g = slope[gate][k] / n
                self.squares[gate][k] += g * g
                self.w[gate][k] += mixing.RATE * g / math.sqrt(self.squares[gate][k])

    def log10(self, block):
        total = 0.0
        for bit, contexts, given, gate, row in block:
            _, _, mix = self.mixed(contexts, given, gate)
            p = 1 / (1 + math.exp(-mix))
            n0, n1 = self.came[row, self.level(mix)]
            middle = 1 / (1 + math.exp(-(self.level(mix) * 24 / (mixing.LEVELS - 1) - 12)))
            p = 0.5 * (p + (n1 + 0.5 * middle) / (n0 + n1 + 0.5))
            p = min(1 - 1e-6, max(1e-6, p))
            total += math.log10(p if bit else 1 - p)
        return total


def spelling(word):
    """The bits of a word's bytes and closing space, in eight groups: the first bits of all symbols come first."""
    out = [[] for _ in range(8)]
    raw = word.encode() + b" "
    for i, c in enumerate(raw):
        back = [raw[i - k] if i >= k else 32 if i == k - 1 else 0 for k in (1, 2, 3)]
        for k in range(8):
            so_far = (1 << k) | (c >> (8 - k))
            contexts = [(back[0], so_far), (*back[:2], so_far), (*back, so_far), (raw[:i], so_far)]
            out[k].append((c >> (7 - k) & 1, contexts, [], so_far, so_far))
    return out


def plain_scores(rows):
    """The model on a table that is one shard and one block, by dictionaries."""
    n = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    h = {w: (x := xxhash.xxh64_intdigest(w.encode(), 42)) - (x >> 63 << 64) for _, t in rows for w in tokens(t)}
    top = sorted((w for w in n if n[w] > 1), key=lambda w: (-n[w], h[w]))
    assert len(top) <= lm.TOP
    once = {w for w in n if n[w] == 1 and h[w] & 1}
    leaf, totals = {}, Counter()
    for w in h:
        leaf[w] = top.index(w) if w in top else lm.LEAVES - 1 if w not in n or w in once else lm.TOP + (h[w] >> 20 & lm.BUCKETS - 1)
        totals[leaf[w]] += n[w]
    weights = {k: v for k, v in totals.items() if v and k < lm.LEAVES - 1} | {lm.LEAVES - 1: max(1, len(once))}
    heap = [(w, k, {k: ""}) for k, w in weights.items()]
    heapq.heapify(heap)
    share = {}
    for number in range(lm.LEAVES, lm.LEAVES + len(heap) - 1):
        (w0, _, low), (w1, _, high) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (w0 + w1, number, {k: "0" + c for k, c in low.items()} | {k: "1" + c for k, c in high.items()}))
    code = heap[0][2]
    mass = Counter()
    for k, c in code.items():
        for i in range(len(c) + 1):
            mass[c[:i]] += weights[k]

    letters = PlainMixer(4, 0, True)
    words = sorted(n, key=str.encode)
    words = [spelling(words[k]) for k in np.random.default_rng(0).permutation(len(words))]
    for k in range(8):
        letters.learn([b for w in words for b in w[k]])
    # What followed each anchor, of the documents with the least and the greatest key.
    key = lambda i, t: spark_hash(i, t)
    docs = sorted(((key(i, t), i, t, [leaf[w] for w in tokens(t)]) for i, t in rows), key=lambda d: d[0])
    found = defaultdict(dict)
    mixed = lambda ls: int(lm.mixed_hash(np.array([ls[0] << 32 | ls[1] << 16 | ls[2]], np.uint64))[0])
    for k, i, _, ls in docs:
        for at in range(len(ls) - 3):
            if not held(i):
                found[mixed(ls[at : at + 3])].setdefault(k, tuple(ls[at + 3 : at + 3 + lm.FOLLOWING]))
    steps = {}
    for k, _, t, ls in docs:
        want = [None] * len(ls)
        for at in range(len(ls) - 3):
            a = mixed(ls[at : at + 3])
            others = found[a] if a % lm.ANCHOR == 0 else {}
            pick = [x for x in (min(others, default=k), max(others, default=k)) if x != k]
            if pick:
                for j, x in enumerate(others[pick[0]][: len(ls) - at - 3]):
                    want[at + 3 + j] = x
        flags, bits, run = [], [], 0
        for at, x in enumerate(ls):
            before = [ls[at - 1] if at else None, ls[at - 2] if at > 1 else None]
            if want[at] is not None:
                flags.append((int(x == want[at]), [(run, min(15, len(code[want[at]]))), want[at], before[0]], [], run, run))
            if x != want[at]:
                for j in range(min(lm.CODED, len(code[x]))):
                    node = code[x][:j]
                    given = math.log(mass[node + "1"] / mass[node + "0"])
                    bits.append((int(code[x][j]), [(node, before[0]), (node, *before)], [given], j, j))
            run = min(run + 1, lm.DEEP - 1) if x == want[at] else 0
        rest = 0.0
        for at, w in enumerate(tokens(t)):
            if want[at] != leaf[w] and len(code[leaf[w]]) > lm.CODED:
                rest += math.log10(weights[leaf[w]] / mass[code[leaf[w]][: lm.CODED]])
            if leaf[w] == lm.LEAVES - 1:
                rest += math.log10(0.5 / max(1, len(once))) if w in n else math.log10(0.5) + sum(letters.log10(g) for g in spelling(w))
            elif leaf[w] >= lm.TOP:
                rest += math.log10(n[w] / totals[leaf[w]])
        steps[k] = flags, bits, rest
    first, second = PlainMixer(3, 0, False), PlainMixer(2, 1, True)
    train = [steps[k] for k, i, _, _ in docs if not held(i)]
    first.learn([b for f, _, _ in train for b in f])
    second.learn([b for _, c, _ in train for b in c])
    return {(i, t): first.log10(steps[k][0]) + second.log10(steps[k][1]) + steps[k][2] for k, i, t, _ in docs}


def spark_hash(i, t):
    """xxhash64 of a row of id and text."""
    seed = xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42)
    x = xxhash.xxh64_intdigest(t.encode(), seed)
    return x - (x >> 63 << 64)


def test_scores_bit_by_bit(spark):
    r = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("an", "be", "co", "du") for b in ("", "ri", "sté", "tor", "x1")] + ["."]
    texts = [" ".join(r.choice(words, 60, p=np.arange(1, 22) / 231)) for _ in range(30)]
    texts += [texts[3], texts[4] + " zu ende", "Only new letters here", "x" * 40, ""]
    rows = [(int(i), t) for i, t in enumerate(texts)]
    assert sum(len(tokens(t)) for _, t in rows) < lm.BLOCK and 0 < sum(held(i) for i, _ in rows) < 12
    want = plain_scores(rows)
    for x in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert x["score"] == pytest.approx(want[x["doc_id"], texts[x["doc_id"]]], rel=5e-3, abs=0.02), x


def test_probabilities_of_words_add_up():
    r = np.random.default_rng(1)
    leaves = list(range(40)) + [lm.LEAVES - 1]
    code = lm.Code({k: int(r.integers(1, 500)) for k in leaves})
    docs = [r.choice(leaves, 50).astype("<u2").tobytes() for _ in range(30)]
    none = np.full(50, lm.NONE, "<u2").tobytes()
    m = lm.WordMixers()
    m.learn(lm.WordBits(code, docs, [none if k % 2 else docs[k - 1] for k in range(30)]))
    m = lm.WordMixers().merged(m.learnt())
    for expected, most in ((lm.NONE, 1), (7, None)):
        texts = [np.array([3, 5, x], "<u2").tobytes() for x in leaves]
        want = [np.array([lm.NONE, lm.NONE, expected], "<u2").tobytes()] * len(texts)
        logs = m.log10(lm.WordBits(code, texts, want)).reshape(-1, 3)[:, 2]
        total = (10.0**logs).sum()
        assert total == pytest.approx(1, abs=1e-4) if most else 0.5 < total <= 1 + 1e-4


def test_probabilities_of_letters_add_up():
    m = lm.LetterBits.mixer()
    words = [b"the", b"thing", b"rather", b"\xc3\xa9t\xc3\xa9"] * 30
    for step in lm.LetterBits(words).steps():
        m.learn(step)
    m = lm.LetterBits.mixer().merged(m.learnt())
    total = 0
    for last in range(256):
        p = sum(m.log10(step).reshape(-1)[2] for step in lm.LetterBits([b"th" + bytes([last])]).steps())
        total += 10.0**p
    assert total == pytest.approx(1, abs=1e-3)


def test_parts_add_up(spark):
    r = np.random.default_rng(2)
    size, rows, total = 3 * mixing.PART + 5, [], 0
    for shard in range(70):
        x = r.integers(-5, 9, size) * (r.random(size) < 0.3)
        x[mixing.PART : 2 * mixing.PART] = 0
        total = total + x
        rows += [(shard, k, b) for k, b in zip(*mixing.parts(x), strict=True)]
    learnt = spark.createDataFrame(rows, "shard long, part int, numbers binary")
    assert (mixing.summed(learnt, 70, size) == total).all()
    assert (mixing.summed(learnt.limit(0), 1, size) == 0).all()


def test_parts_are_narrow():
    rng = np.random.default_rng(1)
    counts, sums = rng.integers(0, 100, 3 * mixing.PART + 7, dtype=np.uint32), rng.integers(-(1 << 40), 1 << 40, 50)
    at, found = mixing.parts([counts, sums])
    whole = np.concatenate([counts, sums], dtype=np.int64)
    assert at == [0, 1, 2, 3] and (np.concatenate([mixing.wide(x) for x in found]) == whole).all()
    assert [len(x) for x in found] == [mixing.PART + 1] * 3 + [57 * 8 + 1]
    for n in (127, 128, -128, -129, 1 << 15, -(1 << 15), 1 << 31, -(1 << 63), (1 << 63) - 1):
        assert mixing.wide(mixing.narrow(np.array([0, n]))).tolist() == [0, n]
    assert mixing.parts(np.zeros(mixing.PART + 1, np.int64)) == ([], [])


def test_contexts_predict_all_bits_of_a_code():
    """Of 4096 words, whose codes have 12 bits each, every one is always followed by the same other one."""
    size = 4096
    code = lm.Code(dict.fromkeys(range(size), 1))
    after = np.random.default_rng(8).permutation(size)
    text = np.stack([np.arange(size), after], axis=1)[np.random.default_rng(9).permutation(size)]
    none = np.full(2, lm.NONE, "<u2").tobytes()
    pairs = lm.WordBits(code, [x.astype("<u2").tobytes() for x in text], [none] * size)
    m = lm.WordMixers()
    for _ in range(8):
        m.learn(pairs)
    m = lm.WordMixers().merged(m.learnt())
    assert m.log10(pairs)[1::2].mean() > -0.2  # -1.2 where only eight of the bits have contexts
    wrong = lm.WordBits(code, [x.astype("<u2").tobytes() for x in np.column_stack([text[:, 0], np.roll(text[:, 1], 1)])], [none] * size)
    assert m.log10(wrong)[1::2].mean() < -4
