"""Token counts by prefix dynamic programming over a byte-pair vocabulary.

A byte-pair encoding has this property: the encoding of a prefix is that of a shorter prefix and one more token, and
exactly one token is such that it and the one before it are encoded as these two. So the counts of all prefixes of a
piece of text follow one from another, without encoding each prefix. A piece is a run of word starts and what follows
it up to the next; no token of the vocabulary reaches over the end of a piece (this is checked when the vocabulary is
loaded), so the counts of a text's prefixes are sums over pieces, and pieces are cached.

`prefix_table` stores the counts as one signed byte for each code point, what it adds to the count of the prefix
before it; `count_at` and `fitting` answer budgets and truncations from that, without encoding again.

Null and empty texts have no tokens. A prefix ends at a code point. Input columns named like an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, table, text_of, without

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Entries in each of a worker's memories (pieces, prefixes, token pairs), at most.
CACHE = 500_000
#: Code points at the end of a prefix by which tokens that may end it are found.
TAIL = 3
#: The score of what isn't a token.
NEVER = float("-inf")


class PrefixCounter:
    """Counts for the prefixes of texts, as the library's encoding of each prefix would have them."""

    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.vocab_size()
        pieces = {self.sp.id_to_piece(i): i for i in range(n) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i))}
        if any(MARK in p.lstrip(MARK) for p in pieces) or any("\n" in p for p in pieces):
            raise ValueError("tokens reach over the ends of pieces")
        self.most = max(map(len, pieces))
        self.score = {p: self.sp.get_score(i) for p, i in pieces.items()}
        #: tokens that text can give, by number; 0 stands for a code point that is spelt in bytes and never merges
        self.vocab = {p: i for i, p in enumerate((p for p in pieces if self.merged(p) == [p]), 1)}
        self.names = ["", *self.vocab]
        #: lengths, longest first, of what may be the last token of a text, by the text's last TAIL code points
        ends: dict[str, set[int]] = {}
        for token in self.vocab:
            if len(token) >= TAIL:
                ends.setdefault(token[-TAIL:], set()).add(len(token))
        self.short = tuple(range(TAIL - 1, 0, -1))
        self.lengths = {tail: (*sorted(got, reverse=True), *self.short) for tail, got in ends.items()}
        self.pairs: dict[int, bool] = {}
        self.states: dict[str, tuple[int, int, bytes]] = {}
        self.cache = _Pieces(self)

    def merged(self, text: str) -> list[str]:
        """The tokens of a short piece, by the merges of the vocabulary: best score first, then leftmost."""
        out, score = list(text), self.score.get
        scores = [score(x + y, NEVER) for x, y in zip(out, out[1:], strict=False)]
        while scores and (best := max(scores)) > NEVER:
            at = scores.index(best)
            out[at : at + 2] = [out[at] + out[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(out[at - 1] + out[at], NEVER)
            if at < len(scores):
                scores[at] = score(out[at] + out[at + 1], NEVER)
        return out

    def joins(self, key: int) -> bool:
        """Whether two tokens (numbers a << 17 | b) next to each other stay the two tokens they are."""
        if len(self.pairs) >= CACHE:
            self.pairs.clear()
        a, b = key >> 17, key & 0x1FFFF
        left, right = self.names[a], self.names[b]
        # two tokens that make a token don't stay
        got = self.pairs[key] = not a or not b or (left + right not in self.score and self.merged(left + right) == [left, right])
        return got

    def state(self, piece: str) -> tuple[int, int, bytes]:
        """Count and last token of the piece, and what each code point adds to the count, as signed bytes.

        It depends on the piece alone, so pieces that begin alike share the states of their common prefixes.
        """
        states = self.states
        if len(states) >= CACHE:
            states.clear()
        n, done = len(piece), len(piece) - 1
        while done and piece[:done] not in states:
            done -= 1
        before, steps = (states[piece[:done]][0], states[piece[:done]][2]) if done else (0, b"")
        number, pairs, lengths, short = self.vocab.get, self.pairs.get, self.lengths.get, self.short
        for p in range(done + 1, n + 1):
            for k in lengths(piece[p - TAIL : p], short) if p >= TAIL else short:
                q = p - k
                if q < 0:
                    continue
                tok = number(piece[q:p])
                if tok is None:
                    if p - q > 1:
                        continue
                    tok = 0
                count = last = 0
                if q:
                    count, last, _ = states[piece[:q]]
                    key = last << 17 | tok
                    ok = pairs(key)
                    if not (self.joins(key) if ok is None else ok):
                        continue
                count += 1 if tok else len(piece[q].encode("utf-8", "surrogatepass"))
                steps += _BYTE[(count - before) & 255]
                states[piece[:p]] = (count, tok, steps)
                before = count
                break
        return states[piece]

    def long(self, piece: str) -> bytes:
        """The steps of a piece too long for its prefixes to be kept: the same, over positions."""
        n, vocab, most = len(piece), self.vocab, self.most
        count, last = [0] * (n + 1), [0] * (n + 1)
        for p in range(1, n + 1):
            for q in range(max(0, p - most), p):
                tok = vocab.get(piece[q:p], 0)
                if not tok and p - q > 1:
                    continue
                key = last[q] << 17 | tok
                if q == 0 or self.pairs.get(key) or (key not in self.pairs and self.joins(key)):
                    count[p], last[p] = count[q] + (1 if tok else len(piece[q].encode("utf-8", "surrogatepass"))), tok
                    break
        return bytes((b - a) & 255 for a, b in zip(count, count[1:], strict=False))

    def __call__(self, text: str) -> bytes:
        """The steps of a text; the mark that the library puts before it belongs to the first code point."""
        if not text:
            return b""
        out = b"".join(map(self.cache.__getitem__, _PIECES(MARK + text.replace(" ", MARK))))
        return _BYTE[(out[0] + out[1]) & 255] + out[2:]


class _Pieces(dict):
    """Steps by piece; what isn't known yet is computed."""

    def __init__(self, of: PrefixCounter):
        self.of = of

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > 48:
            return self.of.long(piece)
        if len(self) >= CACHE:
            self.clear()
        got = self[piece] = self.of.state(piece)[2]
        return got


_BYTE = [bytes([k]) for k in range(256)]
_PIECES = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n").findall

_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count_at(steps: bytes, prefix: int | None = None) -> int:
    """Tokens of the prefix of so many code points, or of the whole text."""
    return int(np.frombuffer(steps, np.int8)[:prefix].sum(dtype=np.int64))


def fitting(steps: bytes, budget: int) -> int:
    """Code points of the longest prefix that has at most `budget` tokens."""
    ok = np.flatnonzero(np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64) <= budget)
    return int(ok[-1]) + 1 if len(ok) else 0


def prefix_table(df: DataFrame, text: str = "text", path: str | None = None, budget: int = 4096, steps: bool = True) -> DataFrame:
    """df without its text, with n_tokens, fits (code points of the longest prefix within the budget) and token_steps."""
    path = path or public_tokenizers.path(MODEL)
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("fits", T.LongType())] + ([T.StructField("token_steps", T.BinaryType())] if steps else [])
    kept = without(df, [text, *(f.name for f in new)])
    names = [*kept.columns, *(f.name for f in new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in batches:
            got = [count(t) for t in b.column(b.num_columns - 1).to_pylist()]
            n = [count_at(s) for s in got]
            fits = [len(s) if k <= budget else fitting(s, budget) for s, k in zip(got, n, strict=True)]
            extra = [pa.array(n, pa.int64()), pa.array(fits, pa.int64())] + ([pa.array(got, pa.binary())] if steps else [])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *extra], names)

    return map_batches(df.select(*kept.columns, text_of(text).alias(text)), run, [*kept.schema.fields, *new])


def op9_tokens(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), "text")
    out = prefix_table(docs, budget=limit)
    # the count is read from the stored steps' last prefix
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.col("fits").alias("fits_chars"), F.octet_length("token_steps").cast("long").alias("n_prefixes"))
