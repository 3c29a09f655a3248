"""Online logistic mixing of hashed-context bit predictors, in blocks of bits.

A predictor keeps, for each slot of its table, how many zeros and ones came after the contexts that hash there. Its
prediction in the logistic domain is the nearer to 0 the less it has seen. A gate chooses the weights that combine the
predictions; they are learnt by gradient steps while the bits go by, each block predicted by what came before it. The
mix is refined by an adaptive table of what came at each predicted level.

What was learnt apart is merged by integer sums: counts add up, weights are averaged by the bits that their gate saw.
So the merged model does not depend on the order of the parts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 48
#: Length of a gradient step.
RATE = 0.05
#: Weights are summed as integers of this fraction.
FRACTION = 1 << 10
#: Numbers of a row in which what was learnt is passed on; shards that are summed at once.
PART, FAN = 1 << 15, 32


def stretched(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The prediction from counts, as float32."""
    n0, n1 = n0.astype(np.float32), n1.astype(np.float32)
    n = n0 + n1
    return np.log((n1 + np.float32(0.05)) / (n0 + np.float32(0.05))) * (n / (n + np.float32(0.5)))


def level(mix: np.ndarray) -> np.ndarray:
    return ((mix + np.float32(12)) * np.float32((LEVELS - 1) / 24) + np.float32(0.5)).astype(np.int64)


def centre(at: np.ndarray) -> np.ndarray:
    """The probability in the middle of a level."""
    return 1 / (1 + np.exp(-((at % LEVELS) * (24 / (LEVELS - 1)) - 12)))


@dataclass
class Block:
    """Bits with the slots of their contexts by table, inputs that are given, and the numbers of gate and refinement."""

    bit: np.ndarray
    slots: list[np.ndarray]
    gate: np.ndarray
    row: np.ndarray
    given: list[np.ndarray] = field(default_factory=list)


class Mixer:
    """sizes: slots of each predictor's table; given: further inputs; gates and rows: sets of weights and of refinement;
    met: whether the number of tables with a prediction is part of the gate."""

    def __init__(self, sizes: tuple[int, ...], given: int, gates: int, rows: int, met: bool = False):
        self.dense, self.gates, self.rows, self.met = len(sizes), gates * (len(sizes) + 1 if met else 1), rows, gates if met else 0
        self.n = np.full(2 * sum(sizes), 0, np.uint32)  # zeros and ones of each slot beside each other
        self.width = len(sizes) + given
        self.weights = np.full((self.width, self.gates), 0.35, np.float32)
        self.squares, self.mass = np.full((self.width, self.gates), 1e-4), np.zeros(self.gates, np.int64)
        self.came = np.zeros(2 * rows * LEVELS, np.int64)
        self.full = self.refined = None

    def predicted(self, slots: np.ndarray) -> np.ndarray:
        if self.full is not None:
            if self.full.dtype != np.float32:  # sent in half precision
                self.full = self.full.astype(np.float32)
            return self.full.take(slots)
        both = self.n.view(np.uint64).take(slots).view(np.uint32)
        return stretched(both[0::2], both[1::2])

    def mixed(self, b: Block) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The inputs, the gates and the mix in the logistic domain."""
        x = [self.predicted(s) for s in b.slots] + b.given
        gate = b.gate
        if self.met:
            gate = gate + self.met * sum((p != 0).view(np.int8) for p in x[: self.dense]).astype(np.int64)
        total = self.weights[0].take(gate) * x[0]
        for k in range(1, self.width):
            total += self.weights[k].take(gate) * x[k]
        return x, gate, np.clip(total, -12, 12)

    def learn(self, b: Block) -> None:
        """One block: predicted by all blocks before, then learnt."""
        x, gate, mix = self.mixed(b)
        bit = b.bit.astype(np.int64)
        self.came += np.bincount((b.row * LEVELS + level(mix)) * 2 + bit, minlength=len(self.came))
        error = b.bit - 1 / (1 + np.exp(-mix))
        seen = np.bincount(gate, minlength=self.gates)
        self.mass += seen
        hit = np.flatnonzero(seen)
        for k in range(self.width):
            g = np.bincount(gate, error * x[k], self.gates)[hit] / seen[hit]
            self.squares[k, hit] += g * g
            self.weights[k, hit] += (RATE * g / np.sqrt(self.squares[k, hit])).astype(np.float32)
        ones = np.ones(len(bit), np.uint32)
        for s in b.slots:
            np.add.at(self.n, 2 * s + bit, ones)

    def log10(self, b: Block) -> np.ndarray:
        """log10 of the probability of each bit."""
        _, _, mix = self.mixed(b)
        sign = b.bit * np.float32(2) - np.float32(1)
        p = 1 / (1 + np.exp(-mix * sign))
        if self.refined is not None:
            refined = self.refined.take(b.row * LEVELS + level(mix))
            p = (p + (refined * sign + (1 - b.bit))) * np.float32(0.5)
        return np.log(np.clip(p, np.float32(1e-6), np.float32(1 - 1e-6))) * np.float32(np.log10(np.e))

    def numbers(self) -> list[np.ndarray]:
        """What was learnt, as numbers that add up: counts, weights with what their gates saw, the refinement."""
        fixed = np.rint(self.weights.astype(np.float64) * self.mass * FRACTION).astype(np.int64)
        return [self.n, fixed.ravel(), self.mass, self.came]

    def learnt(self) -> np.ndarray:
        return np.concatenate(self.numbers(), dtype=np.int64)

    def size(self) -> int:
        return len(self.n) + self.weights.size + len(self.mass) + len(self.came)

    def merged(self, sums: np.ndarray) -> Mixer:
        """The model from the sum of what was learnt; this one then only predicts."""
        counts, fixed, mass, came = np.split(sums, np.cumsum([len(self.n), self.weights.size, len(self.mass)]))
        self.full = stretched(counts[0::2], counts[1::2]).astype(np.float16)
        known = mass > 0
        self.weights[:, known] = fixed.reshape(self.weights.shape)[:, known] / (mass[known] * FRACTION)
        n0, n1 = came[0::2], came[1::2]
        self.refined = ((n1 + 0.5 * centre(np.arange(self.rows * LEVELS))) / (n0 + n1 + 0.5)).astype(np.float32)
        self.n = self.squares = self.mass = self.came = None
        return self


def narrow(x: np.ndarray) -> bytes:
    """Numbers in the fewest bytes that hold each of them, behind that width."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or (-(1 << (8 * w - 1)) <= x.min() and x.max() < 1 << (8 * w - 1)))
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)


def parts(numbers: np.ndarray | list[np.ndarray]) -> tuple[list[int], list[bytes]]:
    """Numbers (of several arrays: one behind the other) in parts of PART, without those that are all zero: the parts'
    places and bytes. A part at a time is widened, so that no whole copy is made."""
    arrays = numbers if isinstance(numbers, list) else [numbers]
    ends = np.cumsum([len(x) for x in arrays]).tolist()
    at, out = [], []
    for lo in range(0, ends[-1], PART):
        x = np.concatenate([a[max(0, lo - e + len(a)) : max(0, lo + PART - e + len(a))] for a, e in zip(arrays, ends, strict=True)], dtype=np.int64)
        if x.any():
            at.append(lo // PART)
            out.append(narrow(x))
    return at, out


def summed(learnt: DataFrame, n_shards: int, size: int) -> np.ndarray:
    """The sum over shards of rows (shard, part, numbers): of FAN shards at a time, so that a task holds that many."""

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(wide(x.as_py()) for x in rows["numbers"])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int32()), "numbers": [narrow(total)]})

    while n_shards > 1:
        learnt = learnt.withColumn("shard", F.expr(f"shard div {FAN}")).groupBy("shard", "part").applyInArrow(add, "shard long, part int, numbers binary")
        n_shards = -(-n_shards // FAN)
    out = np.zeros(size, np.int64)
    for part, numbers in zip(*(c.to_pylist() for c in learnt.select("part", "numbers").toArrow().columns), strict=True):
        x = wide(numbers)
        out[part * PART : part * PART + len(x)] += x
    return out
