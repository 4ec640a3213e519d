"""Merges compiled into a lazily determinised transducer, held in flat arrays.

A state is what the rest of a piece can still depend on. It is a window of
positions from the last settled token's end to the current position. A position
is open if the symbols since then begin a longer vocabulary entry; the trie node
reached is kept with it. With every open position, and every position that the
tokens before it pass, goes the last token of the prefix that ends there.
Reading a symbol moves all open positions one step; the longest entry that ends
here and may follow the last token of its position is the new prefix's last
token. The window then begins where the tokens of all open positions part, and
the tokens up to there are emitted, so none waits longer than the longest entry.

A token may follow another only if merging the symbols of both in the order of
the merges gives just these two; this settles which open position a new token
continues.

Moves come into being when a text first needs them. Many pieces are run side by
side, one symbol of all of them after the other; the moves they lack are made
together. Between blocks, when there are more than max_states, the half of the
moves leaves that wasn't used for longest, and the states that only they reach.
"""

from __future__ import annotations

from array import array
from collections.abc import Sequence

import numpy as np

FEW = 12  # pieces, or missing moves, below which Python is quicker than arrays
MAX_STATES = 1 << 17
PAIR_BITS = 20
NONE = np.iinfo(np.int32).max
GOLDEN = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1


class Table:
    """int64 keys of 0 or more -> int32 values, in open addressing; grows at half full."""

    def __init__(self, bits: int = 12):
        self.clear(bits)

    def clear(self, bits: int = 12) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        self.flat_keys, self.flat_values = memoryview(self.keys), memoryview(self.values)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(GOLDEN)) >> np.uint64(64 - self.bits)).view(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that are different and not yet in."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old = self.keys >= 0
            old_keys, old_values = self.keys[old], self.values[old]
            self.clear((4 * (self.n + len(keys))).bit_length())
            self.add(old_keys, old_values)
        self.n += len(keys)
        slot, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[todo[free]]  # of several keys for a slot the last one stays
            put = self.keys[at] == keys[todo]
            self.values[at[put]] = values[todo[put]]
            todo = todo[~put]
            slot[todo] = slot[todo] + 1 & len(self.keys) - 1

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        slot = self.slot(keys)
        found = self.keys[slot]
        out = self.values[slot]
        open_ = np.flatnonzero(found != keys)
        while len(open_):
            at = slot[open_]
            found = self.keys[at]
            want = keys[open_]
            hit = found == want
            out[open_[hit]] = self.values[at[hit]]
            out[open_[found < 0]] = default
            more = ~hit & (found >= 0)
            open_ = open_[more]
            slot[open_] = slot[open_] + 1 & len(self.keys) - 1
        return out

    def get_one(self, key: int, default: int) -> int:
        keys, mask = self.flat_keys, len(self.keys) - 1
        slot = (key * GOLDEN & _WORD) >> (64 - self.bits)
        while (found := keys[slot]) != key:
            if found < 0:
                return default
            slot = slot + 1 & mask
        return self.flat_values[slot]


class Merges:
    """The vocabulary: tokens are numbered in the order of their merges, symbols are 0 .. n_symbols - 1."""

    def __init__(self, entries: Sequence[Sequence[int]], n_symbols: int):
        self.n_symbols, n = n_symbols, len(entries)
        self.length = np.fromiter(map(len, entries), np.int32, n)
        number = {tuple(e) if not isinstance(e, bytes) else e: i for i, e in enumerate(entries)}
        self.bits = max(1, n.bit_length())
        # the trie
        child: dict[int, int] = {}
        token, inner = [-1], [False]
        for e, i in number.items():
            node = 0
            for x in e:
                inner[node] = True
                key = node * n_symbols + x
                nxt = child.get(key)
                if nxt is None:
                    nxt = child[key] = len(token)
                    token.append(-1)
                    inner.append(False)
                node = nxt
            token[node] = i
        self.child = Table()
        self.child.add(np.fromiter(child, np.int64, len(child)), np.fromiter(child.values(), np.int32, len(child)))
        self.token, self.inner = np.array(token, np.int32), np.array(inner, bool)
        self.token_list, self.inner_list = memoryview(self.token), memoryview(self.inner)
        # every way to put an entry together from two, and the one that merging takes
        parts = array("i")
        for e, i in number.items():
            for k in range(1, len(e)):
                if (left := number.get(e[:k])) is not None and (right := number.get(e[k:])) is not None:
                    parts.extend((len(e), i, left, right))
        size, whole, left, right = np.frombuffer(parts, np.int32).reshape(-1, 4).T.astype(np.int64)
        del number, child, token, inner
        self.merged = Table()
        self.merged.add(left << self.bits | right, whole.astype(np.int32))
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for k in range(2, int(self.length.max(initial=0)) + 1):
            own = np.flatnonzero((size == k) & (left < whole) & (right < whole))
            own = own[self.alone(left[own]) & self.alone(right[own])]
            ok = self.apart(left[own], right[own], whole[own])
            self.left[whole[own[ok]]], self.right[whole[own[ok]]] = left[own[ok]], right[own[ok]]
        self.pairs, self.allowed = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)

    def alone(self, t: np.ndarray) -> np.ndarray:
        """Whether merging makes the entry."""
        return (self.length[t] == 1) | (self.left[t] >= 0)

    def apart(self, a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Takes the merges within a and b back, latest first, and looks for one across the border that came before the bound."""
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            joined = self.merged.get(a << self.bits | b, NONE) < bound
            ok[live[joined]] = False
            in_a, in_b = self.left[a] >= 0, self.left[b] >= 0
            go = ~joined & (in_a | in_b)
            live, a, b, bound, in_a, in_b = live[go], a[go], b[go], bound[go], in_a[go], in_b[go]
            first = ~in_b | in_a & (a > b)
            # of equal merges the one further left, across the border, comes first
            a, b, bound = np.where(first, self.right[a], a), np.where(first, b, self.left[b]), np.where(first, a, b + 1)
        return ok

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a: tokens, or -1 for none; remembered in a table of fixed size."""
        pair = a.astype(np.int64) + 1 << self.bits | b
        slot = ((pair.view(np.uint64) * np.uint64(GOLDEN)) >> np.uint64(64 - PAIR_BITS)).view(np.int64)
        out, miss = self.allowed[slot], np.flatnonzero(self.pairs[slot] != pair)
        if len(miss):
            new, back = np.unique(pair[miss], return_inverse=True)
            left, right = (new >> self.bits) - 1, new & (1 << self.bits) - 1
            ok = self.alone(right)
            some = np.flatnonzero(ok & (left >= 0))
            ok[some] = self.apart(left[some], right[some], np.full(len(some), NONE, np.int64))
            out[miss] = ok[back]
            slot, at = np.unique(slot[miss], return_index=True)
            self.pairs[slot], self.allowed[slot] = pair[miss[at]], out[miss[at]]
        return out


class Transducer:
    """Pieces of symbols -> tokens. Not thread-safe."""

    def __init__(self, merges: Merges, max_states: int = MAX_STATES):
        self.merges, self.max_states = merges, max_states
        self.end = merges.n_symbols  # read after a piece's last symbol
        self.shift = (self.end + 1).bit_length()
        self.made = self.steps = self.turn = 0
        self.reset()

    def reset(self) -> None:
        self.states: list[bytes] = []
        self.number: dict[bytes, int] = {}
        self.moves = Table()
        n = 1 << 12
        self.n_moves = self.n_out = 0
        self.next, self.last, self.step = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int8)
        self.out_at, self.out_len, self.used = np.zeros(n, np.int32), np.zeros(n, np.uint8), np.zeros(n, np.int32)
        self.out = np.zeros(n, np.int32)
        self.state(np.array([-1, 0], np.int32).tobytes())  # no token before, nothing read

    def state(self, record: bytes) -> int:
        """record: last token and node (-1: not open) of each position of the window."""
        n = self.number.get(record)
        if n is None:
            n = self.number[record] = len(self.states)
            self.states.append(record)
        return n

    def keep(self, keys: np.ndarray, next_: np.ndarray, last: np.ndarray, step: np.ndarray, counts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Adds moves; returns their numbers."""
        n, m = self.n_moves + len(keys), self.n_out + len(tokens)
        if n > len(self.next):
            for name in ("next", "last", "step", "out_at", "out_len", "used"):
                setattr(self, name, np.concatenate((old := getattr(self, name), np.zeros(max(n, 2 * len(old)) - len(old), old.dtype))))
        if m > len(self.out):
            self.out = np.concatenate((self.out, np.zeros(max(m, 2 * len(self.out)) - len(self.out), np.int32)))
        new = np.arange(self.n_moves, n, dtype=np.int32)
        self.next[new], self.last[new], self.step[new], self.out_len[new] = next_, last, step, counts
        self.out_at[new] = self.n_out + np.cumsum(counts) - counts
        self.out[self.n_out : m] = tokens
        self.n_moves, self.n_out = n, m
        self.moves.add(keys, new)
        self.made += len(new)
        return new

    def windows(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Last tokens and nodes, position by position, and each window's current position."""
        records = [self.states[s] for s in states.tolist()]
        size = np.fromiter(map(len, records), np.int64, len(records)) // 8
        width = int(size.max()) + 1  # one position more, for the symbol to be read
        flat = np.frombuffer(b"".join([r.ljust(8 * width, b"\xff") for r in records]), np.int32).reshape(len(records), width, 2)
        return flat[:, :, 0].T.copy(), flat[:, :, 1].T.copy(), size - 1

    def make(self, keys: np.ndarray) -> np.ndarray:
        """The moves of keys that are different and have none yet."""
        symbols = keys & (1 << self.shift) - 1
        ending = symbols == self.end
        out = np.empty(len(keys), np.int32)
        for some, how in ((np.flatnonzero(ending), self.finish), (np.flatnonzero(~ending), self.read)):
            if len(some):
                out[some] = how(keys[some], symbols[some])
        return out

    def finish(self, keys: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Emits what isn't settled at a piece's end."""
        last, _, here = self.windows(keys >> self.shift)
        rows, found = np.arange(len(keys)), []
        while len(rows := rows[here[rows] > 0]):
            t = last[here[rows], rows]
            found.append((rows, t))
            here[rows] -= self.merges.length[t]
        return self.emit(keys, np.zeros(len(keys), np.int32), np.full(len(keys), -1), np.zeros(len(keys)), found[::-1])

    def emit(self, keys, next_, last, step, found) -> np.ndarray:
        rows, tokens = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int32))
        order = np.argsort(rows, kind="stable")
        return self.keep(keys, next_, last, step, np.bincount(rows, minlength=len(keys)), tokens[order])

    def read(self, keys: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        m = self.merges
        last, node, here = self.windows(keys >> self.shift)
        width, n = node.shape
        at, row = np.nonzero(node >= 0)  # from the furthest position on
        to = m.child.get(node[at, row].astype(np.int64) * m.n_symbols + symbols[row], 0)
        at, row, to = at[to > 0], row[to > 0], to[to > 0]
        token = m.token[to]
        ends = np.flatnonzero(token >= 0)
        ends = ends[m.may_follow(last[at[ends], row[ends]], token[ends])]
        row_found, first = np.unique(row[ends], return_index=True)
        if len(row_found) < n:
            raise ValueError("the vocabulary lacks a symbol")
        new = token[ends[first]]
        here = here + 1
        every = np.arange(n)
        last[here, every] = new
        depth = np.zeros((width, n), np.int32)
        for k in range(1, width):
            r = np.flatnonzero(last[k] >= 0)
            depth[k, r] = depth[k - m.length[last[k, r]], r] + 1
        step = depth[here, every] - depth[here - 1, every]
        node[:] = -1
        stay = m.inner[to]
        node[at[stay], row[stay]] = to[stay]
        node[here, every] = 0
        reached, followers, follower = node >= 0, np.zeros((width, n), np.int32), np.zeros((width, n), np.int32)
        for k in range(width - 1, 0, -1):
            r = np.flatnonzero(reached[k])
            before = k - m.length[last[k, r]]
            reached[before, r] = True
            followers[before, r] += 1
            follower[before, r] = k
        root, rows, found = np.zeros(n, np.int64), every, []
        while len(rows := rows[(node[root[rows], rows] < 0) & (followers[root[rows], rows] == 1)]):
            root[rows] = follower[root[rows], rows]
            found.append((rows, last[root[rows], rows]))
        last[~reached] = -1
        flat = np.stack((last.T, node.T), 2).reshape(n, 2 * width).tobytes()
        line, state = 8 * width, self.state
        next_ = np.fromiter([state(flat[i * line + 8 * a : i * line + 8 * b + 8]) for i, (a, b) in enumerate(zip(root.tolist(), here.tolist(), strict=True))], np.int32, n)
        return self.emit(keys, next_, new, step, found)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = self.moves.get(keys, -1)
        miss = np.flatnonzero(out < 0)
        if len(miss):
            new, back = np.unique(keys[miss], return_inverse=True)
            out[miss] = self.make(new)[back]
        return out

    def run(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The move of each symbol, and of the end after each piece, of pieces that follow one another in symbols."""
        n = len(sizes)
        ends = np.cumsum(sizes + 1) - 1
        text = np.full(len(symbols) + n, self.end, np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = symbols
        moves = np.empty(len(text), np.int32)
        order = np.argsort(-sizes, kind="stable")
        at, size = ends[order] - sizes[order], sizes[order]
        state = np.zeros(n, np.int64)
        left = np.searchsorted(-size, -np.arange(int(size[0]) + 1 if n else 0), side="right").tolist()
        for k, m in enumerate(left):
            if m < FEW:
                for i in range(m):
                    self.run_one(text, moves, int(at[i]), int(ends[order[i]]), int(state[i]))
                break
            here = at[:m]
            mv = self.find(state[:m] << self.shift | text[here])
            moves[here] = mv
            state = self.next[mv].astype(np.int64)
            here += 1
        self.steps += len(text)
        self.turn += 1
        self.used[moves] = self.turn
        if len(self.states) > self.max_states:
            moves = self.forget(moves)
        return moves

    def run_one(self, text: np.ndarray, moves: np.ndarray, at: int, end: int, state: int) -> None:
        part = text[at : end + 1].tolist()
        out = []
        for x in part:
            key = state << self.shift | x
            mv = self.moves.get_one(key, -1)
            if mv < 0:
                mv = int(self.read_one(key, x)) if x != self.end else int(self.make(np.array([key]))[0])
            out.append(mv)
            state = int(self.next[mv])
        moves[at : end + 1] = out

    def read_one(self, key: int, x: int) -> int:
        """read() for a single key."""
        m = self.merges
        record = np.frombuffer(self.states[key >> self.shift], np.int32).tolist()
        last, node = record[0::2], record[1::2]
        here = len(last)
        moved, ends = [], []
        for k, old in enumerate(node):
            if old >= 0 and (to := m.child.get_one(old * m.n_symbols + x, 0)):
                moved.append((k, to))
                if (t := m.token_list[to]) >= 0:
                    ends.append((k, t))
        if len(ends) > 1 or last[ends[0][0]] >= 0 if ends else False:
            ok = m.may_follow(np.array([last[k] for k, _ in ends]), np.array([t for _, t in ends])).tolist()
            ends = [e for e, good in zip(ends, ok, strict=True) if good]
        if not ends:
            raise ValueError("the vocabulary lacks a symbol")
        new = ends[0][1]
        last.append(new)
        length = m.length
        depth = [0] * (here + 1)
        for k in range(1, here + 1):
            if last[k] >= 0:
                depth[k] = depth[k - int(length[last[k]])] + 1
        nodes = [-1] * here + [0]
        for k, to in moved:
            if m.inner_list[to]:
                nodes[k] = to
        reached = [v >= 0 for v in nodes]
        followers: list[list[int]] = [[] for _ in nodes]
        for k in range(here, 0, -1):
            if reached[k]:
                before = k - int(length[last[k]])
                reached[before] = True
                followers[before].append(k)
        root, out = 0, []
        while nodes[root] < 0 and len(followers[root]) == 1:
            root = followers[root][0]
            out.append(last[root])
        new_record = np.array([v for k in range(root, here + 1) for v in ((last[k] if reached[k] else -1), nodes[k])], np.int32).tobytes()
        return self.keep(np.array([key]), self.state(new_record), new, depth[here] - depth[here - 1], np.array([len(out)]), np.array(out, np.int32))[0]

    def forget(self, moves: np.ndarray) -> np.ndarray:
        """Keeps the moves used last, half of them or those of the last block alone; returns the block's moves by their new numbers."""
        age = self.used[: self.n_moves]
        least = min(int(np.partition(age, self.n_moves // 2)[self.n_moves // 2]) + 1, self.turn)
        used = np.flatnonzero(age >= least)
        back = np.empty(self.n_moves, np.int32)
        back[used] = np.arange(len(used))
        slots = np.flatnonzero(self.moves.keys >= 0)
        key_of = np.empty(self.n_moves, np.int64)
        key_of[self.moves.values[slots]] = self.moves.keys[slots]
        keys, next_, last, step, n_out, out_at = key_of[used], self.next[used], self.last[used], self.step[used], self.out_len[used], self.out_at[used]
        tokens, old, made, age = gather(self.out, out_at, n_out), self.states, self.made, age[used]
        hot = np.unique(np.concatenate(([0], keys >> self.shift, next_)))
        renumber = np.empty(len(old), np.int64)
        renumber[hot] = np.arange(len(hot))
        self.reset()
        for s in hot.tolist():
            self.state(old[s])
        self.keep(renumber[keys >> self.shift] << self.shift | keys & (1 << self.shift) - 1, renumber[next_], last, step, n_out.astype(np.int64), tokens)
        self.made = made
        self.used[: len(used)] = age
        return back[moves]

    def tokens(self, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What moves emit, one after the other, and how many each."""
        n = self.out_len[moves].astype(np.int64)
        return gather(self.out, self.out_at[moves], n), n


def gather(pool: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """pool[start : start + n] of all, one after the other."""
    some = np.flatnonzero(n)
    start, n = start[some].astype(np.int64), n[some].astype(np.int64)
    if not len(n):
        return pool[:0]
    if n.max() == 1:
        return pool[start]
    return pool[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
