"""Exact token counts of every prefix of a text, by dynamic programming.

The last token of a prefix and the count before it fix the prefix's count:
among the vocabulary entries that end at a position, exactly one may follow the
last token of the prefix before it (merging both by score gives back the two),
and count[i] = count[i - length] + 1. A text's counts are kept as one signed
byte for each character, the step from the prefix before: their running sum is
the count at any prefix, so truncation to a budget, the cost of any prefix and
over-limit questions need no second encoding.

What a step depends on recurs, so steps are taken for all different words of a
block side by side, one character after the other, and remembered as moves
between states (transducer.py); a move's step is count[i] - count[i - 1].

The model is a sentencepiece BPE with byte fallback, identity normalisation and
a dummy prefix; no entry holds the space mark after another character, so the
counts of a text are those of its words, one after the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from pulse.llm.common import claim, in_small_batches, lean, slices
from pulse.llm.transducer import MAX_STATES, Merges, Transducer, gather

SPACE = "▁"
BLOCK_CHARS = 1 << 20
_CHUNK = re.compile(" +[^ ]*")
_CUT = re.compile("(?<! ) ")


def read_model(path: str) -> dict[str, float]:
    """The ordinary pieces of a model file with their scores, after checks that the counts rely on."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    norm, train = m.normalizer_spec, m.trainer_spec
    if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or train.treat_whitespace_as_suffix:
        raise ValueError("a BPE model with byte fallback, dummy prefix and identity normalisation is needed")
    pieces = {p.piece: p.score for p in m.pieces if p.type == 1}
    if any(p.type in (4, 5) for p in m.pieces) or any(SPACE in p.lstrip(SPACE) or p.startswith(2 * SPACE) and p.strip(SPACE) for p in pieces):
        raise ValueError("user-defined pieces, or pieces across words, aren't supported")
    scores = [s for p, s in pieces.items() if len(p) > 1 and p.strip(SPACE)]
    if len(set(scores)) < len(scores):
        raise ValueError("pieces of equal score aren't supported")
    return pieces


class PrefixCounter:
    def __init__(self, pieces: dict[str, float], max_states: int = MAX_STATES):
        symbols = sorted({c for p in pieces for c in p})
        self.symbol = np.zeros(0x110000, np.int32)  # of each character; 0: none, raw bytes stand for it and never merge
        self.symbol[[ord(c) for c in symbols]] = np.arange(1, len(symbols) + 1)
        number = dict(zip(symbols, range(1, len(symbols) + 1)))
        single = [c for c in symbols if c in pieces]
        several = sorted((p for p in pieces if len(p) > 1 and not p.startswith(2 * SPACE)), key=lambda p: -pieces[p])
        self.symbol[[ord(c) for c in symbols if c not in pieces]] = 0
        self.fst = Transducer(Merges([tuple(number[c] for c in p) for p in (*single, *several)], len(symbols) + 1), max_states)
        self.mark = single.index(SPACE)
        # entries of marks alone: of equal score, so that blocks fill up from the left, in pairs
        self.blanks = {len(p) for p in pieces if not p.strip(SPACE)}
        self.runs: dict[int, int] = {}

    def run(self, n: int) -> int:
        """Tokens of n space marks, by the plain definition on what the longest entries leave over."""
        longest = max(self.blanks)
        blocks = max(0, n // longest - 2)
        rest = n - blocks * longest
        if rest not in self.runs:
            parts = [1] * rest
            while (at := next((i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.blanks), None)) is not None:
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.runs[rest] = len(parts)
        return blocks + self.runs[rest]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words with one leading mark each: every character's step and the last token of the prefix that it ends (-1: raw bytes), and the words' sizes."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbols = self.symbol[points]
        begins = np.zeros(len(symbols) + 1, bool)
        begins[np.cumsum(sizes) - sizes] = True
        begins[1:] |= np.append(symbols == 0, True)[: len(symbols)]
        known = np.flatnonzero(symbols)
        starts = np.flatnonzero(begins[known])
        pieces = np.diff(np.append(starts, len(known)))
        steps, last = np.empty(len(symbols), np.int8), np.full(len(symbols), -1, np.int32)
        if len(known):
            moves = self.fst.run(symbols[known], pieces)
            inside = np.ones(len(moves), bool)
            inside[np.cumsum(pieces + 1) - 1] = False
            steps[known], last[known] = self.fst.step[moves[inside]], self.fst.last[moves[inside]]
        raw = np.flatnonzero(symbols == 0)
        steps[raw] = 1 + (points[raw] >= 0x80) + (points[raw] >= 0x800) + (points[raw] >= 0x10000)
        return steps, last, sizes

    def after(self, marks: int, steps: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Steps of several marks and a word, from those of one mark and the word."""
        count = np.cumsum(steps, dtype=np.int64).tolist()
        bare = [False]  # whether the mark stands alone in a prefix
        for k, t in enumerate(last.tolist(), 1):
            n = int(self.fst.merges.length[t]) if t >= 0 else 1
            bare.append(t == self.mark if n == k else bare[k - n])
        counts = [self.run(k) for k in range(marks)] + [self.run(marks) - 1 + c if bare[k] else self.run(marks - 1) + c for k, c in enumerate(count, 1)]
        return np.diff(counts).astype(np.int8)

    def keys(self, text: str) -> list[str]:
        """The words of a text, each with all but one of the spaces before it; the dummy prefix is one."""
        text = text.replace(SPACE, " ")
        if "  " in text or text[:1] == " ":
            return [c[1:] for c in _CHUNK.findall(" " + text)]
        return text.split(" ") if text else []

    def cut(self, text: str) -> list[list[str]]:
        """The keys of a long text, some at a time."""
        text, out, a = text.replace(SPACE, " "), [], 0
        while at := _CUT.search(text, a + BLOCK_CHARS):
            out.append(self.keys(text[a : at.start()]))
            a = at.end()
        return [*out, self.keys(text[a:]) or [""]]

    def block(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of steps, and where those of each word are in it."""
        number = dict.fromkeys(keys)
        words = [SPACE + w.lstrip(" ") for w in number]
        pool, last, size = self.words(words)
        start = np.cumsum(size) - size
        more, n = [pool], len(pool)
        for i, w in enumerate(number):
            if w[:1] == " ":
                own = slice(int(start[i]), int(start[i] + size[i]))
                steps = self.after(len(w) - len(words[i]) + 2, pool[own], last[own])
                more.append(steps)
                start[i], size[i] = n, len(steps)
                n += len(steps)
        for i, w in enumerate(number):
            number[w] = i
        which = np.fromiter(map(number.__getitem__, keys), np.int64, len(keys))
        return np.concatenate(more), start[which], size[which]

    def texts(self, texts: list[str]) -> Iterator[tuple[int, Steps]]:
        """Of each text its tokens and a function that gives the steps."""
        keys: list[str] = []
        ends = []
        for t in texts:
            keys += self.keys(t) if len(t) <= 2 * BLOCK_CHARS else []
            ends.append(len(keys))
        pool, start, size = self.block(keys)
        total = np.concatenate(([0], np.cumsum(pool, dtype=np.int64)))
        count = np.concatenate(([0], np.cumsum(total[start + size] - total[start])))
        a = 0
        for t, b in zip(texts, ends, strict=True):
            if len(t) > 2 * BLOCK_CHARS:
                steps = Steps(np.concatenate([gather(*self.block(k)) for k in self.cut(t)]))
                yield steps.n, steps
            else:
                yield int(count[b] - count[a]), Steps(pool, start[a:b], size[a:b])
            a = b

    def text(self, text: str) -> bytes:
        return next(self.texts([text]))[1].bytes()


class Steps:
    """The steps of one text: put together when they are asked for. Entry 0 stands for the dummy prefix with the first character."""

    def __init__(self, pool: np.ndarray, start: np.ndarray | None = None, size: np.ndarray | None = None):
        self.pool, self.start, self.size = pool, start, size

    @property
    def n(self) -> int:
        return int(self.array().sum(dtype=np.int64))

    def array(self) -> np.ndarray:
        steps = self.pool if self.start is None else gather(self.pool, self.start, self.size)
        return np.concatenate((steps[:2].sum(dtype=np.int8, keepdims=True), steps[2:])) if len(steps) > 1 else steps[:0]

    def bytes(self) -> bytes:
        return self.array().tobytes()


def count_at(steps: bytes, n_chars: int) -> int:
    """Tokens of the first n_chars characters."""
    return int(np.frombuffer(steps[:n_chars], np.int8).sum(dtype=np.int64))


def longest_prefix(steps: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most budget tokens."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


_counter: dict[int, PrefixCounter] = {}


def counter(pieces: dict[str, float], key: int) -> PrefixCounter:
    if key not in _counter:
        claim("token_counts", _counter.clear)
        _counter.clear()
        _counter[key] = PrefixCounter(pieces)
    return _counter[key]


def count(docs: DataFrame, model_path: str, limit: int, text_col: str = "text", id_col: str = "doc_id", keep_steps: bool = True) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit, longest_within and, with keep_steps, prefix_steps.

    longest_within is the length in characters of the longest prefix within
    the limit. A null text counts as empty: zeros, not over the limit.
    Repeated rows are treated one by one, other columns are left out.
    """
    pieces = read_model(model_path)
    key = hash((model_path, len(pieces), sum(map(hash, pieces))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(pieces, key)
        for batch in batches:
            n_bytes, n_tokens, within, all_steps = [], [], [], []
            sizes = [k or 0 for k in pa.compute.binary_length(batch.column(1)).to_pylist()]
            n_bytes += sizes
            for a, b in slices(sizes, BLOCK_CHARS):
                texts = [x or "" for x in batch.column(1).slice(a, b - a).to_pylist()]
                for t, (n, steps) in zip(texts, c.texts(texts), strict=True):
                    n_tokens.append(n)
                    within.append(len(t) if n <= limit else longest_prefix(steps.bytes(), limit))
                    if keep_steps:
                        all_steps.append(steps.bytes())
            cols = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(within, pa.int64())]
            names = [id_col, "n_bytes", "n_tokens", "over_limit", "longest_within"]
            if keep_steps:
                cols.append(pa.array(all_steps, pa.binary()))
                names.append("prefix_steps")
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, longest_within bigint" + ", prefix_steps binary" * keep_steps
    return in_small_batches(docs).select(id_col, text_col).mapInArrow(lean(run), schema)
