"""Documents linked by the Jaccard similarity of their word shingles.

A document's set holds 64-bit hashes of its shingles; equal sets are one node
from the start. The rest goes by tiles: a tile is one shingle and one band of
set sizes. If two sets are similar enough, they share one of the first
n - ceil(t n) + 1 shingles of each, in any order that is the same for all; the
order here is by a table of shingle counts of fixed size (rare first), so
passages that many documents share open few tiles. No link is lost whatever
the counts are.

In a tile all sets are first checked against one hub, the set that holds the
fewest rarer shingles, so of near copies one with few edits, to which the others
are closest. What the hub doesn't settle goes in rounds. In a tile
that has few pairs of different components whose sizes and places allow a link,
all of them are checked; in another each set is only checked against a few
others, drawn anew in each round, and components are formed before the next.
When a round brings no link, all pairs that are left are checked, so none is lost. A tile of
very many sets is dealt out over parts, anew in each round, with a hub for each
part; for the last pairs its parts meet two by two. A check
compares hashed bitmap signatures: bits of one that the other lacks are elements
that it lacks, which bounds the overlap from above; pairs that pass intersect
their sorted arrays.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm.common import at_end, claim, in_small_batches, lasting, lean, release, remove, scope, shared_dir, shuffle_partitions, slices, stored
from pulse.operators.graph import connected_components

WORDS = 5
PERCENT = 75
COUNT_BITS = 22  # the table of counts has 2^22 slots, whatever the input
CHUNK_BITS = 16  # and travels in chunks of 2^16
MOST = 65535  # what a task counts at most for a slot
SPLIT = 1 << 16  # a tile of more sets, by the table of counts, is dealt out over parts of about so many
FILTER_BITS = 20
FEW_IDS = 50_000  # so many document ids may be broadcast
FEW_PAIRS = 1 << 14  # so many pairs may be broadcast
FEW_LINKS = 1 << 16  # of so many the driver makes the components itself
BLOCK = 1 << 20
#: A set with over a 64th of all pairs is hot: there are 64 at most.
HOT_SETS = 64
NARROW = 8  # pairs of different components for each set of a tile, up to which all are checked at once
DRAWN = 4  # others that a set of another tile is checked against in a round

_rng = np.random.default_rng(7)
_byte = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_blank = np.zeros(256, bool)
_blank[[32, 9, 10, 11, 12, 13]] = True
BASE = 0x5851F42D4C957F2D
_place = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2^64 and their inverses."""
    size = max(BLOCK * 2, 1 << (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        inverse = pow(BASE, -1, 1 << 64)
        both = []
        for b in (BASE, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[size] = both[0], both[1]
    return _powers[size]


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a buffer that begins and ends with a blank."""
    word = ~_blank[raw]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    up, down = powers(len(raw))
    total = np.cumsum(_byte[_lower[raw]] * up[: len(raw)], dtype=np.uint64)
    return starts, mix((total[ends - 1] - total[starts - 1]) * down[starts])


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; texts of under five words have one, those without words none."""
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    sizes = [len(t) + 1 for t in texts]
    for a, b in slices(sizes, BLOCK):
        raw = np.frombuffer(b" " + b" ".join(texts[a:b]) + b" ", np.uint8)
        starts, words = word_hashes(raw)
        offsets = np.concatenate(([1], 1 + np.cumsum(sizes[a:b])))
        first = np.searchsorted(starts, offsets)
        many = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            many += words[k : k + len(many)] * _place[k]
        many = mix(many)
        for i in range(b - a):
            low, high = int(first[i]), int(first[i + 1])
            n = high - low
            if n >= WORDS:
                own = many[low : high - WORDS + 1].copy()
                own.sort()
                out[a + i] = own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif n:
                out[a + i] = mix((words[low:high] * _place[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    return out


def set_id(s: np.ndarray) -> int:
    """64 bits of a set, as a signed number."""
    return int(mix((mix(s) * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))[0].astype(np.int64))


def blocks(batches: Iterator[pa.RecordBatch], limit: int = 4 * BLOCK) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of the batches (text in column 1) with their sets."""
    claim("ngram_join", _powers.clear)
    for batch in batches:
        sizes = [n or 0 for n in pa.compute.binary_length(batch.column(1)).to_pylist()]
        for a, b in slices(sizes, limit):
            part = batch.slice(a, b - a)
            yield part, shingle_sets([x or b"" for x in part.column(1).to_pylist()])
    _powers.clear()


def least_overlap(n: int, percent: int) -> int:
    """The overlap that any set similar enough to one of n elements has with it."""
    return -(-percent * n // 100)


def linked(common: int, n: int, m: int, percent: int) -> bool:
    return 100 * common >= percent * (n + m - common)


def signature(s: np.ndarray) -> bytes:
    """A bitmap of the set with two to four times as many bits as elements, 64 at least."""
    bits = max(64, 2 << int(len(s)).bit_length())
    flags = np.zeros(bits, np.uint8)
    flags[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def overlap_bound(a: bytes, n: int, b: bytes, m: int) -> int:
    """No overlap of the two sets is larger."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))


def common_elements(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, sid and size of each row; then, chunk by chunk, how many of the sets hold the shingles of each of 2^22 slots."""
    seen, kind = np.zeros(1 << COUNT_BITS, np.uint32), None
    names = ["doc", "sid", "size", "chunk", "counts"]
    for part, sets in blocks(batches):
        kind, n = part.schema.field(0).type, part.num_rows
        for s in sets:
            seen[(s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)] += 1
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
    for c, some in enumerate(np.split(seen, 1 << (COUNT_BITS - CHUNK_BITS)) if kind is not None else ()):
        counts = np.minimum(some, MOST).astype(np.uint16).tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([c], pa.int32()), pa.array([counts], pa.binary())], names)


def count_table(chunks: DataFrame) -> np.ndarray:
    """Four times the binary logarithm of the sums of describe()'s counts, chunk by chunk: of one size for any input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total = totals.setdefault(c, np.zeros(1 << CHUNK_BITS, np.uint32))
                np.minimum(total, (1 << 32) - 1 - MOST, out=total)
                total += np.frombuffer(x.as_buffer(), np.uint16)
        for c, total in totals.items():
            scale = np.rint(4 * np.log2(1.0 + total)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([scale.tobytes()], pa.binary())], ["chunk", "counts"])

    table = np.zeros(1 << COUNT_BITS, np.uint8)
    for r in chunks.repartition(1 << (COUNT_BITS - CHUNK_BITS), "chunk").mapInArrow(lean(add), "chunk int, counts binary").collect():
        table[r["chunk"] << CHUNK_BITS : (r["chunk"] + 1) << CHUNK_BITS] = np.frombuffer(bytes(r["counts"]), np.uint8)
    return table


def rare_first(s: np.ndarray, table: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set of which any similar enough set shares one."""
    n = len(s) - least_overlap(len(s), percent) + 1
    weight = table[(s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
    if n >= len(s):
        return s
    order = np.lexsort((s, weight))
    return s[order[:n]]


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[list[np.ndarray]]:
    """Columns of about so many rows, from smaller batches."""
    held: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy() for c in batch.columns])
            n += batch.num_rows
        if n >= rows:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, n = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of batches sorted by their first two, and where the rows of each pair of these begin; no value of the first column is cut."""
    held: list[list[np.ndarray]] = []
    for cols in gathered(batches):
        cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        if not cut and held and held[-1][0][-1] == cols[0][0]:  # all of one group
            held.append(cols)
            continue
        parts = [*held, [c[:cut] for c in cols]]
        done = [np.concatenate(x) for x in zip(*parts, strict=True)]
        held = [[c[cut:] for c in cols]]
        if len(done[0]):
            yield done, starts_of(done[0], done[1])
    if held:
        done = [np.concatenate(x) for x in zip(*held, strict=True)]
        yield done, starts_of(done[0], done[1])


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where rows begin that differ in a key from the row before."""
    new = np.zeros(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1))


def parts_of(shingles: np.ndarray, table: np.ndarray, split: int) -> np.ndarray:
    """How many parts each shingle's tile is dealt out over."""
    scale = table[(shingles.view(np.uint64) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
    return np.exp2(scale / 4.0).astype(np.int64) // split + 1


def part_of(sid: np.ndarray, parts: np.ndarray, turn: int) -> np.ndarray:
    return (mix(sid.view(np.uint64) ^ np.uint64(0xD1B54A32D192ED03 * (turn + 1) & (1 << 64) - 1)) % parts.astype(np.uint64)).astype(np.int32)


def hot_sets(pairs: DataFrame, n: int, end: str) -> list[int]:
    """The sets that are at one end of over a 64th of all n pairs."""
    return [r[0] for r in pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1, n // HOT_SETS)).collect()]


def attach(pairs: DataFrame, sets: DataFrame, end: str, cols: list[str], hot: list[int]) -> DataFrame:
    """pairs with columns of the set at one end. Its hot sets (64 at most) are broadcast, so no task gets all the pairs of one."""
    own = sets.select(F.col("sid").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in cols])
    is_hot = F.col(end).isin(hot)
    out = pairs.where(~is_hot).join(own.hint("merge"), end)
    return out.unionByName(pairs.where(is_hot).join(F.broadcast(own.where(is_hot)), end)) if hot else out


def by_id(sets: DataFrame, parts: int) -> DataFrame:
    """Written with one row for each set, bucketed by its id, so that joins on it don't move it."""
    spark = sets.sparkSession
    table, folder = f"pulse_sets_{uuid.uuid4().hex}", shared_dir(spark)
    at_end(lambda: remove(folder, spark))
    at_end(lambda: spark.sql(f"DROP TABLE IF EXISTS {table}"))
    sets.write.format("parquet").option("path", folder).bucketBy(parts, "sid").sortBy("sid").saveAsTable(table)
    return spark.table(table)


def sets_of(text: DataFrame, members: DataFrame, ids: DataFrame, parts: int, whole: bool) -> DataFrame:
    """sid, size and signature, or with ``whole`` the sorted hashes, of the sets whose ids a filter of fixed size lets through; one row each, bucketed by id.

    Few sets are made from one document each, found by a broadcast of their
    ids; for more, all texts are gone through.
    """
    spark = text.sparkSession
    name = "items" if whole else "sig"
    ids = stored(ids.select("sid").distinct())
    if ids.count() <= FEW_IDS:
        docs = members.join(ids.hint("broadcast"), "sid", "left_semi").groupBy("sid").agg(F.min("doc").alias("own")).select("own")
        text = text.join(F.broadcast(docs), text["doc"].eqNullSafe(docs["own"]), "left_semi")
    slot = F.shiftrightunsigned(F.col("sid"), 64 - FILTER_BITS)
    words = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bit = F.expr("shiftleft(1L, cast(slot & 63 AS int))")
    for r in ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect():  # 2^14 rows at most
        words[r["word"]] = r["bits"]
    flags = spark.sparkContext.broadcast(words)
    at_end(flags.destroy)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.unpackbits(flags.value.view(np.uint8), bitorder="little")
        known: set[int] = set()
        for _, sets in blocks(batches):
            found = []
            for s in sets:
                i = set_id(s)
                if len(s) and asked[(i & (1 << 64) - 1) >> (64 - FILTER_BITS)] and i not in known:
                    if len(known) > 1_000_000:
                        known.clear()
                    known.add(i)
                    found.append((i, len(s), s.tobytes() if whole else signature(s)))
            if found:
                ids, sizes, data = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], ["sid", "size", name])

    found = text.mapInArrow(lean(keep), f"sid bigint, size int, {name} binary").repartition(parts, "sid")
    return by_id(found.dropDuplicates(["sid"]), parts)


def similar_bounds(x: bytes, n: int, y: bytes, m: int, percent: int) -> bool:
    return linked(overlap_bound(x, n, y, m), n, m, percent)


def similar_items(x: bytes, n: int, y: bytes, m: int, percent: int) -> bool:
    return linked(common_elements(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), n, m, percent)


def check(text: DataFrame, members: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids that are similar enough. sets has the signatures; arrays are made again for the pairs that pass.

    Few pairs are broadcast to the sets, more are joined with them; both ways check all.
    """
    with scope():
        pairs = stored(pairs)
        left = passing(pairs, pairs.count(), sets, "sig", partial(similar_bounds, percent=percent))
        n = left.count()
        made = set_arrays(text, members, left) if n <= FEW_PAIRS else sets_of(text, members, ends_of(left).select("sid"), shuffle_partitions(text.sparkSession), True)
        return lasting(passing(left, n, made, "items", partial(similar_items, percent=percent)))


def ends_of(pairs: DataFrame) -> DataFrame:
    """sid, a, b: each pair once for each end."""
    return pairs.select(F.explode(F.array("a", "b")).alias("sid"), "a", "b")


def set_arrays(text: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """sid, size and sorted hashes of the sets of few pairs, each from one document; rows that share an id may bring others."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in blocks(batches):
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], ["sid", "size", "items"])

    docs = members.join(F.broadcast(ends_of(pairs).select("sid")), "sid", "left_semi").groupBy("sid").agg(F.min("doc").alias("own")).select("own")
    return text.join(F.broadcast(docs), text["doc"].eqNullSafe(docs["own"]), "left_semi").mapInArrow(lean(again), "sid bigint, size int, items binary")


def passing(pairs: DataFrame, n: int, sets: DataFrame, name: str, similar) -> DataFrame:
    """Those of n stored pairs (a, b) whose sets' sizes and columns of that name are similar."""
    if not n:
        return pairs

    def of_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come with those of a pair together; a set may come twice."""
        pair, seen = None, {}
        for batch in batches:
            found = []
            for a, b, sid, size, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (a, b) != pair:
                    pair, seen = (a, b), {}
                if sid not in seen:
                    seen[sid] = data, size
                    if len(seen) == 2 and similar(*seen[a], *seen[b]):
                        found.append(pair)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["a", "b"])

    def of_many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(*row) for row in zip(*[batch.column(c).to_pylist() for c in (f"{name}_a", "size_a", f"{name}_b", "size_b")], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    if n <= FEW_PAIRS:
        rows = sets.join(F.broadcast(ends_of(pairs)), "sid").select("a", "b", "sid", "size", name)
        rows = rows.repartition(shuffle_partitions(pairs.sparkSession), "a", "b").sortWithinPartitions("a", "b")
        return stored(rows.mapInArrow(lean(of_few), "a bigint, b bigint"))
    hot = {end: hot_sets(pairs, n, end) for end in ("a", "b")}
    both = attach(pairs, sets, "b", ["size", name], hot["b"])
    return stored(attach(both, sets, "a", ["size", name], hot["a"]).mapInArrow(lean(of_many), "a bigint, b bigint"))


def components(links: DataFrame) -> DataFrame:
    """node, component of stored links (a, b): of few at once in the driver, of more in rounds."""
    if links.count() > FEW_LINKS:
        return connected_components(links, "a", "b")
    least: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := least.setdefault(x, x)) != x:
            least[x] = x = least[up]
        return x

    for a, b in links.collect():
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    return stored(links.sparkSession.createDataFrame([(x, root(x)) for x in list(least)], "node bigint, component bigint"))


def across(percent: int, turn: int, last: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a tile's part that no links join yet. Unless it is the last turn, of wide ones only some, and a row with the shingle and the least and largest component, as of each part of a tile that has several."""
    share = np.log(100 / percent) / 2
    for (h, sub, parts, size, sid, place, comp), starts in whole_groups(batches):
        n = np.diff(np.append(starts, len(h)))
        size, place = size.astype(np.int64), place.astype(np.int64)
        left_over = size - place  # this shingle and those after it
        drawn = mix(sid.view(np.uint64) ^ mix(h.view(np.uint64) + np.uint64(turn)))
        left, right, wide = [], [], []

        def meet(i, j):
            """Keeps the pairs of rows i and j that can be similar enough: the first shingle that two sets share leaves room for the overlap they need."""
            low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            needed = -(-percent * (size[i] + size[j]) // (100 + percent))
            ok = (comp[i] != comp[j]) & (high <= low * 100 // percent) & (np.minimum(left_over[i], left_over[j]) >= needed)
            x, y = np.broadcast_to(sid[i], ok.shape)[ok], sid[j][ok]
            left.append(np.minimum(x, y))
            right.append(np.maximum(x, y))
            return len(x)

        several = comp != np.repeat(comp[starts], n)
        if not last:
            for g in np.flatnonzero(parts[starts] > 1).tolist():
                own = comp[starts[g] : starts[g] + n[g]]
                wide.append((h[starts[g]], own.min(), own.max()))
        for g in np.unique(np.repeat(np.arange(len(n)), n)[several]):
            a, end = int(starts[g]), int(starts[g] + n[g])
            names, counts = np.unique(comp[a:end], return_counts=True)
            before, found = len(left), 0
            for i in (a + np.flatnonzero(comp[a:end] != names[counts.argmax()])).tolist():
                low, high = np.searchsorted(size[a:end], (-(-size[i] * percent // 100), size[i] * 100 // percent + 1))
                found += meet(i, np.arange(a + low, a + high))
                if last and len(left) > before + 1000:  # a wide tile hands its pairs on piece by piece
                    yield pairs_of(left, right, wide)
                    before = 0
                if not last and found > NARROW * (end - a):
                    del left[before:], right[before:]
                    wide.append((h[a], names[0], names[-1]))
                    order = a + np.lexsort((drawn[a:end], np.log(size[a:end]) // share))
                    for d in range(1, DRAWN + 1):
                        meet(order[:-d], order[d:])
                    break
        yield pairs_of(left, right, wide)


def pairs_of(left: list, right: list, wide: list) -> pa.RecordBatch:
    both = np.unique(np.stack([np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right)], 1), axis=0)
    pairs = [pa.array(both[:, k].copy(), pa.int64()) for k in range(2)]
    marks = [pa.array(x, pa.int64()) for x in np.array(wide, np.int64).reshape(-1, 3).T]
    for x in (left, right, wide):
        x.clear()
    none = lambda n: pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays([pa.concat_arrays([x, none(len(marks[0]))]) for x in pairs] + [pa.concat_arrays([none(len(pairs[0])), x]) for x in marks], ["a", "b", "wide", "least", "most"])


def classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id for each row of docs, in no order.

    Two documents are linked if 100 * intersection >= percent * union of their
    sets of five-word shingles (A-Z lower-cased, words between ASCII white
    space; under five words: the whole sequence). component_id is the smallest
    id that links lead to, itself included. Texts without words, and null ones,
    have an empty set and their own id; rows that share an id are judged one by
    one and get the same component if their texts do. Rows without an id have
    a null component unless a link leads to one with an id.
    """
    with scope():
        return lasting(_classes(docs, text_col, id_col, percent))


def _classes(docs: DataFrame, text_col: str, id_col: str, percent: int) -> DataFrame:
    spark = docs.sparkSession
    release(spark)
    parts = shuffle_partitions(spark)
    text = in_small_batches(docs).select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    described = stored(text.mapInArrow(lean(describe), f"doc {kind}, sid bigint, size int, chunk int, counts binary"))
    members = described.where("chunk IS NULL").select("doc", "sid", "size")
    table = spark.sparkContext.broadcast(count_table(described.where("chunk IS NOT NULL").select("chunk", "counts")))
    at_end(table.destroy)

    split = SPLIT

    def open_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each set that this task meets first, a row for each shingle of its prefix."""
        known: set[int] = set()
        for _, sets in blocks(batches):
            ids = [set_id(s) for s in sets]
            if len(known) > 1_000_000:
                known.clear()
            hashes, owners, sizes, places = [], [], [], []
            for i, s in zip(ids, sets, strict=True):
                if len(s) and i not in known:
                    known.add(i)
                    p = rare_first(s, table.value, percent)
                    hashes.append(p)
                    owners.append(np.full(len(p), i, np.int64))
                    sizes.append(np.full(len(p), len(s), np.int32))
                    places.append(np.arange(len(p), dtype=np.int32))
            if hashes:
                h, sid = np.concatenate(hashes).view(np.int64), np.concatenate(owners)
                sub = part_of(sid, parts_of(h, table.value, split), 0)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(sub), pa.array(np.concatenate(sizes)), pa.array(sid), pa.array(np.concatenate(places))], ["shingle", "part", "size", "sid", "place"])

    entries = text.mapInArrow(lean(open_tiles), "shingle bigint, part int, size int, sid bigint, place int")
    names = ["shingle", "size", "sid", "place", "hub"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of shingles that several sets hold, each with the hub of its tile and its band of sizes: the set with the fewest rarer shingles."""
        for (h, sub, size, sid, place), _ in whole_groups(batches):
            new = starts_of(h, sub, sid)  # rows are sorted by size and set: a set may come from several tasks
            h, sub, size, sid, place = h[new], sub[new], size[new].astype(np.int64), sid[new], place[new]
            starts = starts_of(h, sub)
            n = np.diff(np.append(starts, len(h)))
            many = np.repeat((n > 1) | (parts_of(h[starts], table.value, split) > 1), n)
            far = size > np.repeat(size[starts], n) * 100 // percent
            bands = [starts]
            for g in np.unique(np.repeat(np.arange(len(n)), n)[far]):
                a, end = int(starts[g]), int(starts[g] + n[g])
                while (a := a + int(np.searchsorted(size[a:end], size[a] * 100 // percent, side="right"))) < end:
                    bands.append(np.array([a]))
            first = np.sort(np.concatenate(bands))
            central = np.minimum.reduceat(place.astype(np.int64) * len(h) + np.arange(len(h)), first) % len(h)
            hub = np.repeat(sid[central], np.diff(np.append(first, len(h))))
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(h[many]), pa.array(size[many].astype(np.int32)), pa.array(sid[many]), pa.array(place[many]), pa.array(hub[many])], names)

    met = stored(entries.repartition(parts, "shingle", "part").sortWithinPartitions("shingle", "part", "size", "sid").mapInArrow(lean(meet), "shingle bigint, size int, sid bigint, place int, hub bigint"))

    sigs = sets_of(text, members, met, parts, False)
    # a hub is only tried on sets that meet it in a tenth of their tiles: what it leaves is looked at below
    often = F.col("n") >= 0.1 * (F.col("size") * (100 - percent) / 100)
    star = met.where("sid <> hub").groupBy(F.col("hub").alias("a"), F.col("sid").alias("b"), "size").agg(F.count(F.lit(1)).alias("n")).where(often).select("a", "b")
    links = check(text, members, star, sigs, percent)
    def deal(turn: int, last: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with its part of the tile in this turn; in the last one, with each pair of parts that it is in."""
        for batch in batches:
            h, sid = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            of = parts_of(h, table.value, split)
            sub = part_of(sid, of, turn + 1).astype(np.int64)
            if last and len(h):
                row = np.repeat(np.arange(len(h)), of)
                other = np.arange(len(row)) - np.repeat(np.cumsum(of) - of, of)
                sub, of = np.minimum(sub[row], other) * of[row] + np.maximum(sub[row], other), of[row]
                batch = batch.take(pa.array(row))
            c = batch.columns
            yield pa.RecordBatch.from_arrays([c[0], pa.array(sub), pa.array(of), *c[1:]], ["shingle", "part", "parts", "size", "sid", "place", "component"])

    labels = components(links)
    rest, turn, last = met.drop("hub"), 0, False
    while True:
        release(spark)
        labelled = rest.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("shingle", "size", "sid", "place", F.coalesce("component", "sid").alias("component"))
        dealt = labelled.mapInArrow(lean(partial(deal, turn, last)), "shingle bigint, part bigint, parts bigint, size int, sid bigint, place int, component bigint")
        dealt = dealt.repartition(parts, "shingle", "part").sortWithinPartitions("shingle", "part", "size", "sid")
        tried = stored(dealt.mapInArrow(lean(partial(across, percent, turn, last)), "a bigint, b bigint, wide bigint, least bigint, most bigint"))
        found = check(text, members, tried.where("wide IS NULL").select("a", "b").distinct(), sigs, percent)
        some = not found.isEmpty()
        if some:
            links = links.unionByName(found)
            labels = components(links)
        wide = stored(tried.where("wide IS NOT NULL").groupBy(F.col("wide").alias("shingle")).agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least <> most").select("shingle"))
        if wide.isEmpty():
            break
        rest, turn, last = stored(rest.join(wide, "shingle", "left_semi")), turn + 1, not some
    labels = labels.select(F.col("node").alias("sid"), "component")

    own = members.where("size > 0").groupBy("sid").agg(F.min("doc").alias("least"))
    own = stored(own.join(labels, "sid", "left").select("sid", "least", F.coalesce("component", "sid").alias("component")))
    whole = stored(own.groupBy("component").agg(F.min("least").alias("component_id")))
    by_set = stored(own.join(whole, "component").select("sid", "component_id"))
    out = members.join(by_set, "sid", "left")
    return out.select(F.col("doc").alias(id_col), F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))
