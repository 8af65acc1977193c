"""Best-fit packing by a configuration linear program over the length histogram.

Documents become pieces of at most `most` tokens; only the histogram of piece lengths (one count for each length) comes
to the driver. There a covering program over configurations (multisets of lengths that fit a sequence) is solved by
multiplicative weights: each round prices configurations by knapsack dynamic programming over the lengths' weights and
takes the best one. Its solution is rounded down to whole sequences; what is left over is placed by best fit on counts.
The outcome is a bounded list of (configuration, how often), whatever the number of documents. Pieces are numbered
within their length, in slices so that a common length is no hot key, and look their place up by that number.

Null and empty texts are one piece of one token (the end id). Rows that repeat a doc_id are packed as rows of their
own. An empty table gives an empty result. Input columns named like an output are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import helpers, map_batches, stored, table, text_of, without

MODEL = "byte_bpe_50k.json"
END = 2
MOST = 1024
#: Words that a worker remembers, at most.
CACHE = 200_000
#: Steps of the program; a quarter of them when it goes on with what is left.
STEPS = 160
#: Share of the tokens that may lack cover while free tokens are made rarer.
EVEN = 0.03

# ---- tokens

_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
#: Texts of these characters are split into words here; the library encodes all others whole.
_PLAIN = re.compile(f"[\t-\r -~{_LETTERS}]*").fullmatch
_WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+").findall


class _Ids(dict):
    """Ids of words as little-endian unsigned 32-bit numbers."""

    def __init__(self, one):
        self.one = one

    def __missing__(self, word: str) -> bytes:
        got = np.array(self.one(word.encode()), "<u4").tobytes()
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = got
        return got


class Encoder:
    """The ids that the library gives a text, without added ones. Byte-level merges never reach over a word's end, so
    words are encoded one by one and remembered."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        back = {chr(c): b for b, c in _byte_letters().items()}
        vocab = self.whole.get_vocab(with_added_tokens=False)
        special = {x.content for x in self.whole.get_added_tokens_decoder().values()}
        ranks = {bytes(back[c] for c in tok): i for tok, i in vocab.items() if tok not in special}
        self.special = re.compile("|".join(map(re.escape, special))).search if special else lambda _: None
        words = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ids = _Ids(words._core_bpe.encode_single_piece)

    def __call__(self, text: str) -> bytes:
        if _PLAIN(text) and not self.special(text):
            return b"".join(map(self.ids.__getitem__, _WORDS(text)))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in same]
    return {b: b for b in same} | {b: 256 + k for k, b in enumerate(rest)}


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(df: DataFrame, text: str = "text", path: str | None = None, most: int = MOST, end: int = END) -> DataFrame:
    """df without its text, a row for each piece: piece, start, length and ids (little-endian unsigned 32-bit).

    A document of more than `most` tokens is cut so that all pieces but the first are full.
    """
    path = path or public_tokenizers.path(MODEL)
    new = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]
    kept = without(df, [text, *(f.name for f in new)])
    names = [*kept.columns, *(f.name for f in new)]
    tail = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                row, piece, start, ids = [], [], [], []
                for r, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                    x = encode(t) + tail
                    n = len(x) // 4
                    first = (n - 1) % most + 1
                    for p, a in enumerate([0, *range(first, n, most)]):
                        row.append(r)
                        piece.append(p)
                        start.append(a)
                        ids.append(x[4 * a : 4 * (a + most if a else first)])
                take = pa.array(row, pa.int32())
                out = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns[:-1]), *out], names)

    return map_batches(df.select(*kept.columns, text_of(text).alias(text)), run, [*kept.schema.fields, *new])


# ---- the program


class Program:
    """The configuration program, min sum x with every length covered as often as it occurs, by multiplicative weights.

    A length has a weight, a free token has `waste`; x of a configuration is proportional to the product of the weights of
    what is in it. `priced` is the knapsack's dynamic programming over all configurations at once: by capacity the sum of
    these products, whence how often each length is in a sequence. `step` multiplies a length's weight by what it lacks of its
    count to a power. As long as lengths are covered evenly, `waste` shrinks too, so that in the end tokens are free only where they must be. Any weights give a bound: their logarithms as prices, summed over all pieces and divided by the
    most valuable configuration.
    """

    def __init__(self, histogram: dict[int, int], most: int):
        self.most, self.lengths = most, np.array(sorted(histogram), np.int64)
        self.counts = np.array([histogram[k] for k in self.lengths], float)
        self.weights, self.waste = 0.02 * self.counts / self.counts.sum(), 0.98
        self.upto = np.searchsorted(self.lengths, np.arange(most + 1), "right")

    def left(self, counts: np.ndarray) -> None:
        """The same for what is left; lengths that are gone go."""
        on = counts > 0
        self.lengths, self.counts, self.weights = self.lengths[on], counts[on].astype(float), self.weights[on]
        self.upto = np.searchsorted(self.lengths, np.arange(self.most + 1), "right")

    def priced(self) -> None:
        with np.errstate(all="ignore"):  # what is out of range ends the program, in `plan`
            for _ in range(40):
                z = np.zeros(self.most + 1)
                z[0] = 1.0
                for c in range(1, self.most + 1):
                    n = self.upto[c]
                    z[c] = self.waste * z[c - 1] + (self.weights[:n] @ z[c - self.lengths[:n]] if n else 0.0)
                if 1e-99 < z[-1] < 1e99:
                    break
                # weights times s to the power of lengths say the same of full sequences
                s = 10.0 ** ((80 if z[-1] <= 1e-99 else -80) / self.most)
                self.weights, self.waste = self.weights * s**self.lengths, self.waste * s
            s = z[-1] ** (-1 / self.most)
            self.weights, self.waste, z = self.weights * s**self.lengths, self.waste * s, z * s ** np.arange(self.most + 1)
            both = np.convolve(z, z)[: self.most + 1]
            self.sums, self.often, self.free = z, self.weights * both[self.most - self.lengths], self.waste * both[self.most - 1]
            #: the value: so many sequences, if lengths come up as they occur
            self.value = float(self.counts @ self.lengths) / max(self.most - self.free, 1e-9)

    def solve(self, steps: int, eta: float = 0.4) -> None:
        tokens = float(self.counts @ self.lengths)
        for _ in range(steps):
            self.priced()
            covered = self.covered()
            lack = float(np.maximum(1 - covered, 0) * self.counts @ self.lengths) / tokens
            self.weights = self.weights * np.clip(1 / np.maximum(covered, 1e-300), 0.1, 10) ** eta
            if self.free > 1e-4 and lack < EVEN:
                self.waste *= 0.7
        self.priced()

    def covered(self) -> np.ndarray:
        return self.value * self.often / self.counts

    def covering(self) -> float:
        """The value of x with a sequence more for each few pieces that it doesn't cover: that covers all."""
        return self.value + float(np.maximum(1 - self.covered(), 0) * self.counts @ (1 / (self.most // self.lengths)))

    def bound(self) -> float:
        """No packing has fewer sequences."""
        price = np.maximum(np.log(np.maximum(self.weights, 1e-300)) - self.lengths * np.log(self.waste), 0)
        best = np.zeros(self.most + 1)
        for c in range(1, self.most + 1):
            n = self.upto[c]
            best[c] = max(best[c - 1], (price[:n] + best[c - self.lengths[:n]]).max() if n else 0.0)
        return max(float(self.counts @ self.lengths) / self.most, float(self.counts @ price) / max(best[-1], 1e-300))

    def drawn(self, n: int, rng: np.random.RandomState) -> Counter:
        """Configurations (lengths' numbers, ascending) drawn n times in proportion to x, traced back through the sums."""
        back = np.arange(self.most + 1)[:, None] - self.lengths[None, :]
        each = np.where(back >= 0, self.weights * self.sums[np.maximum(back, 0)], 0.0)
        upto = np.cumsum(np.column_stack([each, self.waste * np.append(0.0, self.sums[:-1])]), axis=1)
        out: Counter = Counter()
        size = np.append(self.lengths, 1)
        for a in range(0, n, 2000):
            room = np.full(min(2000, n - a), self.most)
            at, found = np.arange(len(room)), [[] for _ in range(len(room))]
            while len(at):
                r = rng.random_sample(len(at)) * upto[room, -1]
                k = np.minimum((upto[room] <= r[:, None]).sum(1), len(self.lengths))
                for i, j in zip(at.tolist(), k.tolist(), strict=True):
                    if j < len(self.lengths):
                        found[i].append(j)
                room = room - size[k]
                at, room = at[room > 0], room[room > 0]
            out.update(tuple(sorted(f)) for f in found)
        return out


@dataclass
class Plan:
    """entries: configurations as [(length, how often)] and the number of sequences of each; every piece is placed once.
    program: the tokens in sequences that are rounded configurations, of `tokens` in all. value: the program's. bound:
    no packing has fewer sequences."""

    entries: list[tuple[list[tuple[int, int]], int]]
    sequences: int
    tokens: int
    program: int
    value: float
    bound: float


def plan(histogram: dict[int, int], most: int = MOST, leave: float = 0.01, draws: int = 4000, part: float = 0.6, seed: int = 0) -> Plan:
    """The program is solved and rounded: configurations are drawn in proportion to x for `part` of its value, each taken
    a whole number of times as long as there are pieces for it; then it is solved again for what is left, from the weights
    it has. When `leave` of the tokens are left, best fit places these. Of all places where it could have stopped, not to
    have begun among them, the one with the fewest sequences counts, of equal ones the last."""
    histogram = {int(k): int(v) for k, v in histogram.items() if v}
    tokens = sum(k * v for k, v in histogram.items())
    full = histogram.pop(most, 0)
    start: list[tuple[list[tuple[int, int]], int]] = [([(most, 1)], full)] if full else []
    rest = best_fit(histogram, most)
    least = Plan(start + rest, full + sum(n for _, n in rest), tokens, full * most, float(full), float(full))
    if not histogram:
        return least
    rng, x = np.random.RandomState(seed), Program(histogram, most)
    x.solve(STEPS)
    value, bound = full + x.covering(), full + x.bound()
    taken: Counter = Counter()
    sequences, program = full, full * most
    while len(x.lengths) and x.counts @ x.lengths > leave * tokens and np.isfinite(x.value) and np.isfinite(x.weights).all():
        left, some = x.counts.astype(np.int64), 0
        wanted = part * x.value
        each = max(1, int(wanted / draws))
        for c, n in x.drawn(max(1, min(draws, int(wanted))), rng).most_common():
            need = Counter(c)
            n = min([n * each, *(int(left[j]) // m for j, m in need.items())]) if need else 0
            if n > 0:
                some += n
                taken[tuple(sorted(((int(x.lengths[j]), m) for j, m in need.items()), reverse=True))] += n
                for j, m in need.items():
                    left[j] -= n * m
                    program += n * m * int(x.lengths[j])
        if not some:
            break
        sequences += some
        rest = best_fit({int(k): int(n) for k, n in zip(x.lengths, left, strict=True) if n}, most)
        if (n := sequences + sum(n for _, n in rest)) <= least.sequences:
            least = Plan(start + [(list(c), m) for c, m in taken.items()] + rest, n, tokens, program, 0.0, 0.0)
        x.left(left)
        if len(x.lengths):
            x.solve(STEPS // 4)
    least.value, least.bound = value, bound
    return least


def best_fit(histogram: dict[int, int], most: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit, longest first, on counts: sequences that look alike are one entry."""
    open_: dict[int, list[list]] = {}  # by free space: [configuration, how many]
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                each = most // length
                whole, rest = divmod(n, each)
                for k, m in ((each, whole), (rest, 1 if rest else 0)):
                    if m:
                        open_.setdefault(most - k * length, []).append([[(length, k)], m])
                break
            config, m = open_[room].pop()
            if not open_[room]:
                del open_[room]
            each = min(room // length, n)
            take = min(m, n // each)
            if take < m:
                open_.setdefault(room, []).append([config, m - take])
            open_.setdefault(room - each * length, []).append([[*config, (length, each)], take])
            n -= take * each
    return [(c, m) for entries in open_.values() for c, m in entries]


def slots(planned: list[tuple[list[tuple[int, int]], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first number of each slot, its first sequence, its offset. Numbers from a slot's first on go to sequences from its first on."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for config, n in planned:
        offset = 0
        for length, k in config:
            for _ in range(k):
                at = taken.get(length, 0)
                by.setdefault(length, []).append((at, sequence, offset))
                taken[length] = at + n
                offset += length
        sequence += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in by.items()}


# ---- placing


def numbered(df: DataFrame, key: str, order: list[str], number: str, rows: int) -> DataFrame:
    """df with the rows of each key numbered from 0. A key's rows are cut into slices, numbered apart and shifted, so no task holds a whole common key."""
    n = max(1, -(-rows // 50_000))
    slice_, own_, key_, s_, shift_ = helpers(df, "slice", "own", "key", "s", "shift")
    cut = df.withColumn(slice_, F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    sums = cut.groupBy(F.col(key).alias(key_), F.col(slice_).alias(s_)).agg(F.count("*").alias("n"))
    before = Window.partitionBy(key_).orderBy(s_).rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(key_, s_, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(shift_))
    own = F.row_number().over(Window.partitionBy(key, slice_).orderBy(*order))
    out = cut.withColumn(own_, own).join(shift, (F.col(key) == F.col(key_)) & (F.col(slice_) == F.col(s_)))
    return out.select(*df.columns, (F.col(own_) - 1 + F.col(shift_)).cast("long").alias(number))


def pack(lengths: DataFrame, order: list[str], most: int = MOST) -> DataFrame:
    """lengths (with a column `length` from 1 to most; read several times) with sequence_id and offset."""
    names = [c for c in without(lengths, ["sequence_id", "offset"]).columns]
    lengths = lengths.select(*names)
    histogram = {r["length"]: r["count"] for r in lengths.groupBy("length").count().collect()}  # a row for each length
    where = slots(plan(histogram, most).entries)
    (number_,) = helpers(lengths, "number")
    new = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", number_))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            by = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[by])) + 1
            for rows in np.split(by, edges):
                if len(rows):
                    first, base, place = where[int(length[rows[0]])]
                    k = np.searchsorted(first, number[rows], "right") - 1
                    sequence[rows], offset[rows] = base[k] + number[rows] - first[k], place[k]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    ranked = numbered(lengths, "length", order, number_, sum(histogram.values()))
    return map_batches(ranked, run, [*lengths.schema.fields, *new])


def packed(docs: DataFrame) -> DataFrame:
    """The contract's columns for (doc_id, text)."""
    cut = pieces(docs.select("doc_id", "text"))
    # tokens are counted once: the thin table of pieces is written, histogram and placing read it
    thin = stored(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(thin, ["doc_id", "piece", "start", "ids_crc32"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
