"""Byte-level BPE encoding and decoding.

Encoding compiles the merges into a finite-state transducer over bytes
(transducer.py), whose states and transitions come into being when a text first
needs them and whose cold states leave. Every match of the pattern is one piece;
the different pieces of a block of texts are run through the table side by side,
and each occurrence takes its piece's tokens.

Decoding joins the tokens' bytes and runs them through an incremental UTF-8
state machine that holds back an unfinished sequence at a chunk's end; a chunk's
bytes take their step all at once, in arrays.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

from pulse.llm.common import claim, in_small_batches, lean, slices
from pulse.llm.transducer import MAX_STATES, Merges, Transducer, gather

BLOCK_CHARS = 1 << 20
BLOCK_PIECES = 1 << 18  # of a text longer than a block


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def merge_by_rank(ranks: dict[bytes, int], piece: bytes) -> list[bytes]:
    """The plain definition: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Encoder:
    """Texts -> ids: each match of the pattern (which has no groups) by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_states: int = MAX_STATES):
        entries = sorted(ranks, key=ranks.get)
        self.ids = np.array([ranks[b] for b in entries], np.int32)
        self.fst = Transducer(Merges(entries, 256), max_states)
        whole = np.flatnonzero(~self.fst.merges.alone(np.arange(len(entries))))
        self.whole = {entries[t]: t for t in whole.tolist()}  # entries that merging never makes: a piece that is one keeps it
        self.pieces = regex.compile(pattern)
        width = len(str(int(self.ids.max(initial=0)))) + 1
        self.names = np.frombuffer(b"".join((b"%d," % i).ljust(width, b"\0") for i in self.ids.tolist()), np.uint8).reshape(-1, width)
        self.name_size = (self.names > 0).sum(1)

    def tokens(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of pieces, one after the other, and where each piece's end."""
        number = dict.fromkeys(pieces)
        raw = [p.encode("utf-8") for p in number]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        found, n = self.fst.tokens(self.fst.run(np.frombuffer(b"".join(raw), np.uint8), sizes))
        ends = np.cumsum(n)[np.cumsum(sizes + 1) - 1] if raw else np.empty(0, np.int64)
        starts = np.concatenate(([0], ends))[:-1]
        size = ends - starts
        if self.whole and (odd := [(i, t) for i, p in enumerate(raw) if (t := self.whole.get(p)) is not None]):
            at, tokens = np.array(odd).T
            starts[at], size[at] = len(found) + np.arange(len(at)), 1
            found = np.concatenate((found, tokens.astype(np.int32)))
        for i, p in enumerate(number):
            number[p] = i
        which = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        own = size[which]
        return gather(found, starts[which], own), np.cumsum(own)

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of texts, one after the other, and where each text's end."""
        if len(texts) == 1 and len(texts[0]) > 2 * BLOCK_CHARS:
            found, parts = (m.group() for m in self.pieces.finditer(texts[0])), []
            while some := list(islice(found, BLOCK_PIECES)):
                parts.append(self.tokens(some)[0].astype(np.int32))
            out = np.concatenate(parts) if parts else np.empty(0, np.int32)
            return out, np.array([len(out)])
        pieces: list[str] = []
        counts = []
        for t in texts:
            pieces += self.pieces.findall(t)
            counts.append(len(pieces))
        out, ends = self.tokens(pieces)
        return out, np.concatenate(([0], ends))[np.array(counts, np.int64)]

    def written(self, tokens: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
        """The decimal ids of each text, joined by commas."""
        size = self.name_size[tokens]
        flat = self.names[tokens]
        flat = memoryview(flat[np.arange(flat.shape[1]) < size[:, None]])
        a = 0
        for b in np.concatenate(([0], np.cumsum(size)))[ends].tolist():
            yield flat[a : max(a, b - 1)]
            a = b

    def encode(self, text: str) -> list[int]:
        return self.ids[self.block([text])[0]].tolist()


# Fixed values of UTF-8: the first byte's range, how many bytes follow, and the range of the second byte.
UTF8_FORMS = (
    (0xC2, 0xDF, 1, 0x80, 0xBF),
    (0xE0, 0xE0, 2, 0xA0, 0xBF),
    (0xE1, 0xEC, 2, 0x80, 0xBF),
    (0xED, 0xED, 2, 0x80, 0x9F),
    (0xEE, 0xEF, 2, 0x80, 0xBF),
    (0xF0, 0xF0, 3, 0x90, 0xBF),
    (0xF1, 0xF3, 3, 0x80, 0xBF),
    (0xF4, 0xF4, 3, 0x80, 0x8F),
)
REPLACEMENT = np.frombuffer("\ufffd".encode(), np.uint8)


class Utf8Stream:
    """Bytes in chunks -> text; what can't be UTF-8 becomes U+FFFD, one for each longest valid beginning.

    The state between chunks is the unfinished sequence that is held back.
    """

    need, low, high = np.zeros(256, np.int64), np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    for a, b, *form in UTF8_FORMS:
        for kind, value in zip((need, low, high), form, strict=True):
            kind[a : b + 1] = value

    def __init__(self) -> None:
        self.held = b""

    @classmethod
    def scan(cls, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes that begin a sequence that stays unfinished or are in none, how many bytes each of them stands for, and whether a stream's end cut it."""
        high = np.flatnonzero(raw >= 0x80)
        if not len(high):
            return high, high, high.astype(bool)
        lead = high[cls.need[raw[high]] > 0]
        first = raw[lead]
        need = cls.need[first]
        end = ends[np.searchsorted(ends, lead, side="right")]
        padded = np.concatenate((raw, np.zeros(3, np.uint8)))
        good = np.ones(len(lead), np.int64)
        follows = (lead + 1 < end) & (padded[lead + 1] >= cls.low[first]) & (padded[lead + 1] <= cls.high[first])
        good += follows
        for k in (2, 3):
            follows = follows & (need >= k) & (lead + k < end) & (padded[lead + k] & 0xC0 == 0x80)
            good += follows
        short = good <= need
        cover = np.zeros(len(raw) + 1, np.int8)
        np.add.at(cover, lead, 1)
        np.add.at(cover, lead + good, -1)
        stray = high[np.cumsum(cover, dtype=np.int8)[high] == 0]
        at = np.concatenate((lead[short], stray))
        size = np.concatenate((good[short], np.ones(len(stray), np.int64)))
        cut = np.concatenate(((lead + good == end)[short], np.zeros(len(stray), bool)))
        order = np.argsort(at)
        return at[order], size[order], cut[order]

    @classmethod
    def replaced(cls, raw: np.ndarray, at: np.ndarray, size: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes with U+FFFD for those at ``at``, and where streams end in them."""
        if not len(at):
            return raw, ends
        n = np.ones(len(raw), np.int64)
        n[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = 0
        n[at] = 3
        total = np.cumsum(n)
        out = np.repeat(raw, n)
        for k in range(3):
            out[total[at] - 3 + k] = REPLACEMENT[k]
        return out, np.concatenate(([0], total))[ends]

    def feed(self, data: bytes) -> str:
        raw = np.frombuffer(self.held + data, np.uint8)
        end = np.array([len(raw)])
        at, size, cut = self.scan(raw, end)
        self.held = b""
        if len(at) and cut[-1]:
            self.held = raw[at[-1] :].tobytes()
            raw, at, size, end = raw[: at[-1]], at[:-1], size[:-1], at[-1:]
        return self.replaced(raw, at, size, end)[0].tobytes().decode("utf-8")

    def close(self) -> str:
        rest = "\ufffd" if self.held else ""
        self.held = b""
        return rest


class Decoder:
    CHUNK = 1 << 16

    def __init__(self, ranks: dict[bytes, int]):
        self.table = {i: b for b, i in ranks.items()}
        n = max(self.table) + 1 if self.table else 0
        self.length = np.zeros(n, np.int64)
        for i, b in self.table.items():
            self.length[i] = len(b)
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.pool = np.frombuffer(b"".join(self.table.get(i, b"") for i in range(n)), np.uint8)

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text piece by piece; ids that the vocabulary lacks raise KeyError."""
        machine, part = Utf8Stream(), []
        for i in ids:
            part.append(self.table[i])
            if len(part) == self.CHUNK:
                yield machine.feed(b"".join(part))
                part = []
        yield machine.feed(b"".join(part)) + machine.close()

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        if not n.all():
            raise KeyError("an id that the vocabulary lacks")
        return gather(self.pool, self.start[ids], n)

    def decode(self, ids) -> str:
        machine, ids = Utf8Stream(), np.asarray(ids, np.int64)
        out = [machine.feed(self.bytes_of(ids[i : i + self.CHUNK]).tobytes()) for i in range(0, len(ids), self.CHUNK)]
        return "".join([*out, machine.close()])

    def block(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[memoryview]:
        """The UTF-8 bytes of the texts of ids that end at ``ends``: one stream each, all run at once."""
        raw = self.bytes_of(ids)
        ends = np.concatenate(([0], np.cumsum(self.length[ids])))[ends]
        at, size, _ = Utf8Stream.scan(raw, ends)
        raw, ends = Utf8Stream.replaced(raw, at, size, ends)
        flat, a = memoryview(raw), 0
        for b in ends.tolist():
            yield flat[a:b]
            a = b


_built: dict[tuple[int, str], tuple[Encoder, Decoder]] = {}


def coder(data: bytes, pattern: str) -> tuple[Encoder, Decoder]:
    """The coder of a rank file's content, made once in each Python process."""
    key = (hash(data), pattern)
    if key not in _built:
        claim("bpe", _built.clear)
        _built.clear()
        ranks = read_ranks(data)
        _built[key] = Encoder(ranks, pattern), Decoder(ranks)
    return _built[key]


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, token_ids.

    A null or empty text gives no tokens and the hashes of empty strings.
    Rows and ids that repeat are treated one by one; other columns are left
    out. The driver reads the rank file and sends it along; a long text is
    held whole by one task but not copied per token.
    """
    data = read_file(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = coder(data, pattern)
        sha = hashlib.sha256
        for batch in batches:
            sizes = [k or 0 for k in pa.compute.binary_length(batch.column(1)).to_pylist()]
            for a, b in slices(sizes, BLOCK_CHARS):
                part = batch.slice(a, b - a)
                tokens, ends = enc.block([x or "" for x in part.column(1).to_pylist()])
                ids = enc.ids[tokens]
                ids_sha = [sha(x).hexdigest() for x in enc.written(tokens, ends)]
                text_sha = [sha(x).hexdigest() for x in dec.block(ids, ends)]
                cols = [part.column(0), pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids
    return in_small_batches(docs).select(id_col, text_col).mapInArrow(lean(run), schema)


def decode(tokens: DataFrame, ranks_path: str, ids_col: str = "token_ids", id_col: str = "doc_id") -> DataFrame:
    """id and text of token id lists; a null list gives the empty text."""
    data = read_file(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = coder(data, r"\s+|\S+")[1]
        for batch in batches:
            texts = ["".join(dec.stream(x.as_py() or [])) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return tokens.select(id_col, ids_col).mapInArrow(lean(run), f"`{id_col}` {tokens.schema[id_col].dataType.simpleString()}, text string")
