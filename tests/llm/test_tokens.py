"""BPE coding and prefix counts against the public libraries."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
import tiktoken  # noqa: E402

from pulse.llm import bpe, token_counts, transducer  # noqa: E402

RANKS, MODEL = P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model")
ATOMS = ["a", "the", "ing", " ", "  ", "\n", "\t", "é", "1", "23", "'s", "!!", "\u00a0", "▁", "中文", "🙂", "\x1c", "\u0301", "<s>", " " * 17, "x" * 40, "<|endoftext|>"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def coder():
    return bpe.coder(bpe.read_file(RANKS), P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.read_file(RANKS)), special_tokens={})


def test_encode_equals_library(coder, reference):
    for t in texts(800):
        ids = coder[0].encode(t)
        assert ids == reference.encode_ordinary(t)
        assert coder[1].decode(ids) == "".join(coder[1].stream(ids)) == t


def words_of(n, seed):
    return sorted({w.encode() for t in texts(n, seed) for w in t.split()})


def run(fst, words):
    tokens, n = fst.tokens(fst.run(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)))
    ends = np.cumsum(n)[np.cumsum([len(w) + 1 for w in words]) - 1]
    return [x.tolist() for x in np.split(tokens, ends[:-1])]


def test_transducer_equals_plain_merging_however_few_states_it_keeps(coder):
    ranks = bpe.read_ranks(bpe.read_file(RANKS))
    rng = random.Random(9)
    words = words_of(300, 5) + ["".join(rng.choice("thenaison") for _ in range(rng.randint(1, 30))).encode() for _ in range(400)] + [b"\0", b"\xff\0a"]
    want = [[ranks[p] for p in bpe.merge_by_rank(ranks, w)] for w in words]
    merges = coder[0].fst.merges
    for max_states in (0, 50, 1 << 18):
        fst = transducer.Transducer(merges, max_states)
        for a in range(0, len(words), 100):  # blocks in which the first words come back, and one word at a time
            some = words[a : a + 100]
            assert run(fst, some + words[:40]) == want[a : a + 100] + want[:40]
            assert run(fst, some[:1]) == want[a : a + 1]
        assert len(fst.states) <= max(max_states, 40 * 30 + 100 * 30)


def test_tokens_leave_the_transducer_before_the_piece_ends(coder):
    """The wait is bounded by the longest entry: all but the last moves' tokens are out long before the end."""
    fst = transducer.Transducer(coder[0].fst.merges)
    longest = int(fst.merges.length.max())
    word = "".join(random.Random(2).choice("thenaisor") for _ in range(3000)).encode()
    moves = fst.run(np.frombuffer(word, np.uint8), np.array([len(word)]))
    tokens, n = fst.tokens(moves)
    emitted = np.cumsum(np.repeat(0, len(n)))
    sizes, at = fst.merges.length[tokens], 0
    for k, count in enumerate(n.tolist()):
        at += int(sizes[: count].sum())
        sizes = sizes[count:]
        emitted[k] = at
    assert (np.arange(1, len(word) + 1) - emitted[:-1] < 2 * longest).all() and emitted[-1] == len(word)


def test_most_new_pieces_use_moves_that_are_there(coder):
    fst = transducer.Transducer(coder[0].fst.merges)
    rng = random.Random(3)
    for _ in range(10):
        run(fst, ["".join(rng.choice(["th", "in", "er", "on", "an"]) for _ in range(rng.randint(1, 5))).encode() for _ in range(2000)])
    assert fst.steps > 10 * fst.made


def test_a_piece_that_merging_never_makes_keeps_its_entry():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 258, b"xyz": 259, b"bc": 257}
    own = bpe.Encoder(ranks, r"\w+|\W+")
    library = tiktoken.Encoding("small", pat_str=r"\w+|\W+", mergeable_ranks=ranks, special_tokens={})
    for t in ("xyz", "xyzx xyz", "abc", "abcabc bc", "", " "):
        assert own.encode(t) == library.encode_ordinary(t)


def test_blocks_of_texts_equal_single_texts(coder, monkeypatch):
    some = [*texts(60, 11), "", "a" * 500, "", "word and " * 300]
    tokens, ends = coder[0].block(some)
    ids = coder[0].ids[tokens]
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [coder[0].encode(t) for t in some]
    assert [bytes(x).decode() for x in coder[0].written(tokens, ends)] == [",".join(map(str, coder[0].encode(t))) for t in some]
    assert [bytes(x).decode() for x in coder[1].block(ids, ends)] == some
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 100)
    monkeypatch.setattr(bpe, "BLOCK_PIECES", 7)
    assert coder[0].encode(some[-1]) == [i for i in coder[0].ids[coder[0].tokens(coder[0].pieces.findall(some[-1]))[0]].tolist()]


def test_utf8_machine_holds_back_unfinished_sequences():
    data = "a é 中 🙂".encode() + b"\xff\xe2\x82" + b"z\xc0\xaf\xed\xa0\x80" + b"\xf0\x9f"
    want = data.decode("utf-8", "replace")
    for size in (1, 2, 3, 7, 100):
        m = bpe.Utf8Stream()
        assert "".join([m.feed(data[i : i + size]) for i in range(0, len(data), size)]) + m.close() == want


def test_utf8_machine_on_any_bytes():
    rng = random.Random(6)
    pool = [0x41, 0x80, 0xBF, 0xC2, 0xC0, 0xE0, 0xA0, 0x9F, 0xE2, 0xED, 0xEF, 0xF0, 0x90, 0x8F, 0xF4, 0xF5, 0xFF]
    for _ in range(2000):
        data = bytes(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        m, cut = bpe.Utf8Stream(), rng.randint(0, len(data))
        assert m.feed(data[:cut]) + m.feed(data[cut:]) + m.close() == data.decode("utf-8", "replace"), data
        raw, ends = np.frombuffer(data, np.uint8), np.array([cut, len(data)])
        at, size, _ = bpe.Utf8Stream.scan(raw, ends)
        raw, ends = bpe.Utf8Stream.replaced(raw, at, size, ends)
        assert [raw[: ends[0]].tobytes().decode(), raw[ends[0] :].tobytes().decode()] == [data[:cut].decode("utf-8", "replace"), data[cut:].decode("utf-8", "replace")]


def test_unknown_id_is_an_error(coder):
    with pytest.raises((KeyError, IndexError)):
        list(coder[1].stream([10**6]))


def test_counts_of_every_prefix_equal_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    c = token_counts.PrefixCounter(token_counts.read_model(MODEL))
    for t in texts(250, 3):
        steps = c.text(t)
        counts = [token_counts.count_at(steps, i) for i in range(len(t) + 1)]
        assert counts == [len(sp.encode(t[:i])) for i in range(len(t) + 1)]
        for budget in (0, 1, 5):
            best = max(i for i, n in enumerate(counts) if n <= budget)
            assert token_counts.longest_prefix(steps, budget) == best


def test_counts_of_long_texts_and_blocks(monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    c = token_counts.PrefixCounter(token_counts.read_model(MODEL), max_states=200)
    some = [*texts(80, 13), "", "a b", "the cat " * 40, "the  cat   " * 40, "x" * 300, "\u0301" * 200 + " "]
    for size in (10, 1 << 21):
        monkeypatch.setattr(token_counts, "BLOCK_CHARS", size)
        for t, (n, steps) in zip(some, c.texts(some), strict=True):
            assert n == len(sp.encode(t)) == steps.n, repr(t)
            assert token_counts.count_at(steps.bytes(), len(t) // 2) == len(sp.encode(t[: len(t) // 2])), repr(t)


def frame(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "the cat", "x"), (3, "the cat", "y"), (None, "word " * 5000, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")


def test_frames_with_nulls_repeats_and_clashing_names(spark, reference):
    df = frame(spark)
    got = bpe.encode(df, RANKS, P.PATTERN).collect()
    assert len(got) == 5
    for r in got:
        t = {1: "", 2: "", 3: "the cat", None: "word " * 5000}[r["doc_id"]]
        ids = reference.encode_ordinary(t)
        assert (r["token_ids"], r["n_tokens"]) == (ids, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    back = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS)
    assert sorted(r["text"] for r in back.collect()) == sorted(["", "", "the cat", "the cat", "word " * 5000])
    counts = token_counts.count(df, MODEL, 4096).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in counts:
        t = {1: "", 2: "", 3: "the cat", None: "word " * 5000}[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t), len(sp.encode(t)), len(sp.encode(t)) > 4096)
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == token_counts.count(df.limit(0), MODEL, 5).count() == 0


def test_hashes_of_ids_with_leading_and_lone_spaces(spark, reference):
    rows = list(enumerate([" foo bar", " ", "  ", " a", "  a b", "a ", " a ", " \n", "\n a", " é", " 1 2", *texts(150, 7)]))
    got = {r["doc_id"]: r for r in bpe.encode(spark.createDataFrame(rows, "doc_id bigint, text string"), RANKS, P.PATTERN, keep_ids=False).collect()}
    for i, t in rows:
        ids = reference.encode_ordinary(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()), repr(t)
