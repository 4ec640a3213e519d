"""Document fingerprints by a randomised edit embedding.

A walk goes over a text's characters: at step j it writes down the character it
stands on and moves on if a random bit, shared by all texts, of (j, character)
is one. Texts at a small edit distance fall back into step after each edit, so
their written sequences have a small Hamming distance. The sequences (about two
steps for a character) are never stored: positions are sampled once for all
texts, 64 from each range [2^k, 2^(k+1)), and a fingerprint holds one random
bit of the character at each of them.

The likeness of two fingerprints estimates the share of equal positions: each
range counts by its length, and agreement by chance is taken out. Bands are
groups of bits drawn over all ranges by their length; texts that share one are
candidates, and verification compares whole fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.llm.common import shuffle_partitions, slices, stored

PERIOD = 1 << 12  # steps after which the shared random bits repeat
PER_RANGE = 64
RANGES = 40
BAND_BITS = 16
RECALL = 0.999
BLOCK_CELLS = 4 << 20
BLOCK_CHARS = 4 << 20

_rng = np.random.default_rng(20240101)
_moves = _rng.integers(0, 2, (PERIOD, 256), dtype=np.uint8)
_moves[-1] = 1
#: steps that a walk stays on a character it reaches at a step: until the next one bit
_wait = np.zeros((PERIOD, 256), np.uint8)
_run = np.zeros(256, np.int64)
for _pass in range(2):
    for _j in range(PERIOD - 1, -1, -1):
        _run = np.where(_moves[_j] == 1, 1, _run + 1)
        _wait[_j] = np.minimum(_run, 255)
_wait = _wait.reshape(-1)
_sampled = [np.arange(1 << k, 2 << k) if (1 << k) <= PER_RANGE else np.sort(_rng.integers(1 << k, 2 << k, PER_RANGE)) for k in range(RANGES)]
_bits = _rng.integers(0, 2, (RANGES, PER_RANGE, 257), dtype=np.uint8)
END = 256


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((points * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)


def arrivals(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Of each text, the step at which its walk reaches each character, and at the end the number of steps."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    out: list[np.ndarray] = [np.ones(1, np.int64)] * len(texts)
    a = 0
    while a < len(order) and len(texts[order[a]]):
        n = len(texts[order[a]])
        group = order[a : a + max(1, BLOCK_CELLS // n)]
        group = [i for i in group if len(texts[i])]
        lengths = np.array([len(texts[i]) for i in group])
        chars = np.zeros((n, len(group)), np.uint8)
        for d, i in enumerate(group):
            chars[: lengths[d], d] = texts[i]
        steps = np.empty((n + 1, len(group)), np.int32)
        at = np.ones(len(group), np.int32)  # position 0 isn't used, so that ranges begin at powers of two
        active = len(group) - np.searchsorted(lengths[::-1], np.arange(1, n + 1), side="left")
        for i, k in enumerate(active.tolist()):
            steps[i] = at
            now = at[:k]
            now += _wait[((now & (PERIOD - 1)) << 8) | chars[i, :k]]
        steps[n] = at
        for d, i in enumerate(group):
            own = steps[: lengths[d] + 1, d].astype(np.int64)
            own[-1] = at[d]
            out[i] = own
        a += len(group)
    return out


@lru_cache(RANGES)
def _layout(ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions that a walk through so many ranges is sampled at, and where each one's bits are."""
    own = _sampled[:ranges]
    return np.concatenate(own), np.concatenate([np.full(len(s), i) for i, s in enumerate(own)]), np.concatenate([np.arange(len(s)) for s in own])


def _digest(text: np.ndarray, steps: np.ndarray) -> str:
    """Hex: the number of steps in 10 digits, then the sampled bits of each range that the walk reaches."""
    total = int(steps[-1])
    if not len(text):
        return f"{0:010x}"
    chars = np.append(text.astype(np.int64), END)
    ranges = total.bit_length()
    where, k, slot = _layout(ranges)
    at = chars[np.searchsorted(steps, where, side="right") - 1]
    return f"{total:010x}" + np.packbits(_bits[k, slot, at]).tobytes().hex()


def fingerprints(texts: list[str]) -> list[str]:
    coded = [classes(t) for t in texts]
    return [_digest(c, s) for c, s in zip(coded, arrivals(coded), strict=True)]


def _open(fp: str) -> tuple[int, list[np.ndarray]]:
    total = int(fp[:10], 16)
    bits = np.unpackbits(np.frombuffer(bytes.fromhex(fp[10:]), np.uint8))
    out, at = [], 0
    for k in range(total.bit_length() if total else 0):
        n = len(_sampled[k])
        out.append(bits[at : at + n])
        at += n
    return total, out


def likeness(a: str, b: str) -> float:
    """From 0 to 1; 1 for equal fingerprints, 0 if just one text is empty."""
    if a == b:
        return 1.0
    (na, xs), (nb, ys) = _open(a), _open(b)
    if not na or not nb:
        return 0.0
    whole, same = 0.0, 0.0
    longest = max(na, nb)
    for k in range(longest.bit_length()):
        part = _sampled[k] < longest
        if k == 0:
            part[:] = True
        n = int(part.sum())
        weight = min(longest, 2 << k) - (1 << k)
        if not n or weight <= 0:
            continue
        whole += weight
        if k < min(len(xs), len(ys)):
            same += weight * (2 * float((xs[k] == ys[k])[part].mean()) - 1)
    return min(1.0, max(0.0, same / whole)) if whole else 0.0


@lru_cache(4 * RANGES)
def _drawn(level: int, least: float) -> np.ndarray:
    """For each band of a level, the bits it takes of the ranges under 2^level, laid end to end.

    Bits are drawn by the lengths of their ranges. Of a pair with a likeness of
    ``least`` a drawn bit then differs with a chance of (1 - least) / 2 at
    most, whichever ranges the differences are in; a last range that ends
    early is compared at its sampled positions, for which the bound is taken
    at the worst end. There are so many bands that such a pair shares none with
    a chance of 1 - RECALL over the draw.
    """
    top, share = 1 << (level - 1), (1 - least) / 2
    s = (_sampled[level - 1] + 1 - top) / top  # ends of the last range, and below the part sampled up to each
    f = np.arange(1, len(s) + 1) / len(s)
    apart = np.minimum(1, share * (1 + s) / s)
    differ = max(share, float(((share * (1 + s) + apart * np.maximum(0, f - s)) / 2).max()) * (1 << level) / ((1 << level) - 1))
    meet = max(0.0, 1 - differ) ** BAND_BITS
    n = 1 if meet >= 1 else int(np.ceil(np.log(1 - RECALL) / np.log1p(-meet)))
    rng = np.random.default_rng([20240102, level])
    sizes = np.array([len(x) for x in _sampled[:level]])
    weights = 2.0 ** np.arange(level)
    k = rng.choice(level, (n, BAND_BITS), p=weights / weights.sum())
    return (np.cumsum(sizes) - sizes)[k] + (rng.random(k.shape) * sizes[k]).astype(np.int64)


def bands(fp: str, least: float = 0.75) -> list[str]:
    """Keys of drawn bits at each level at which a text with a likeness of ``least`` can end, and of the whole fingerprint."""
    total, bits = _open(fp)
    out, flat = [f"all:{fp}"], np.concatenate([*bits, np.zeros(0, np.uint8)])
    for level in range(len(bits), 0, -1):
        shorter = level < len(bits)
        if shorter and least * (total - 1) > (1 << level) - 1 and total > _sampled[level][0]:
            break
        keys = np.packbits(flat[_drawn(level, least)], axis=1)
        out += [f"{level}:{b}:{key.tobytes().hex()}" for b, key in enumerate(keys)]
    return out


def fingerprint(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: id, fingerprint. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            fps: list[str] = []
            for a, b in slices([len(t) for t in texts], BLOCK_CHARS):
                fps += fingerprints(texts[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.string())], [id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField("fingerprint", T.StringType())]))


def near_groups(docs: DataFrame, least: float = 0.75, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and group_id, the smallest id linked to it, for texts whose fingerprints have a likeness of at least ``least``.

    Equal fingerprints count once. Texts that share a band are compared with
    the smallest id of the band; what isn't linked to it by then is compared
    with all others of the band that it isn't linked to either. A pair of that
    likeness shares a band with a chance of RECALL at least.
    """
    from pulse.operators.graph import connected_components

    own = stored(fingerprint(docs, text_col, id_col).withColumnRenamed(id_col, "doc_id").where("doc_id IS NOT NULL"))
    fps = stored(own.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "fingerprint").groupBy("doc_id").agg(F.collect_list("fingerprint").alias("fingerprints")))
    kind = own.schema["doc_id"].dataType

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, own_fps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k in {k for fp in own_fps for k in bands(fp, least)}:
                    ids.append(i)
                    keys.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(keys, pa.string())], ["doc_id", "band"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [any(likeness(a, b) >= least for a in x for b in y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("dst")], ["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    def alike(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct().join(fps.toDF("src", "x"), "src").join(fps.toDF("dst", "y"), "dst")
        return stored(both.select("src", "dst", "x", "y").mapInArrow(verify, T.StructType([T.StructField("src", kind), T.StructField("dst", kind)])))

    keyed = stored(fps.mapInArrow(split, T.StructType([T.StructField("doc_id", kind), T.StructField("band", T.StringType())])))
    hubs = keyed.groupBy("band").agg(F.min("doc_id").alias("hub"))
    copies = own.join(own.groupBy("fingerprint").agg(F.min("doc_id").alias("dst")), "fingerprint").where("doc_id <> dst").select(F.col("doc_id").alias("src"), "dst")
    links = copies.unionByName(alike(keyed.join(hubs, "band").where("hub <> doc_id").select(F.col("doc_id").alias("src"), F.col("hub").alias("dst"))))
    groups = connected_components(links).withColumnRenamed("node", "doc_id")
    inside = stored(keyed.join(groups, "doc_id", "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("g")))
    heads = inside.join(hubs.withColumnRenamed("hub", "doc_id"), ["band", "doc_id"]).select("band", F.col("g").alias("head"))
    rest = inside.join(heads, "band").where("g <> head").select("band", F.col("doc_id").alias("a"), F.col("g").alias("ga"))
    others = rest.join(inside, "band").where("g <> ga").select(F.least("a", "doc_id").alias("src"), F.greatest("a", "doc_id").alias("dst"))
    groups = connected_components(links.unionByName(alike(others)))
    out = own.select("doc_id").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("component", "doc_id").alias("group_id"))


def with_next(docs: DataFrame, text_col: str, id_col: str, parts: int) -> DataFrame:
    """part, ghost, id, text: ranges of descending ids, each followed by the first rows of the next range as ghosts.

    The ranges begin at ids that occur, so a range's first row is known before
    the texts move; they move once.
    """
    ids = docs.where(F.col(id_col).isNotNull()).select(id_col)
    cuts = sorted(set(ids.approxQuantile(id_col, [i / parts for i in range(1, parts)], min(0.01, 0.2 / parts)))) if parts > 1 else []
    top = ids.agg(F.max(id_col)).first()[0]
    cuts = np.array([c for c in cuts if c != top], np.int64)  # a range: ids up to its cut and over the cut before
    last = len(cuts)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("ghost", T.BooleanType()), docs.schema[id_col], T.StructField("text", T.StringType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            values = ids.fill_null(0).to_numpy(zero_copy_only=False)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            low = np.searchsorted(cuts, values, side="left")
            part = np.where(null, last, last - low)  # descending: the largest ids are in part 0
            if top is None:
                part[:] = 0
            head = ~null & (np.isin(values, cuts) | (values == top))
            pick = np.flatnonzero(head)
            before = np.where(values[pick] == top, last, part[pick] - 1)
            for rows, where, ghost in ((np.arange(len(values)), part, False), (pick, before, True)):
                if len(rows):
                    chosen = batch.take(pa.array(rows)) if ghost else batch
                    yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array([ghost] * len(rows)), chosen.column(0), chosen.column(1)], schema.names)

    dealt = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(deal, schema)
    spread = dealt.repartitionById(last + 1, F.col("part")) if hasattr(dealt, "repartitionById") else dealt.repartition(last + 1, "part")
    return spread.sortWithinPartitions("part", "ghost", F.desc_nulls_last(id_col), "text")


def against_next(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", parts: int | None = None) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next text.

    The next row is the next in order of descending id (equal ids by text, rows
    without id last); after the last comes the first. The edited text has its
    last floor(n / 2) characters replaced by as many (or all) from the next
    text's beginning. One row per input row; null texts count as empty; a
    single row is its own next. Other columns are left out.
    """
    spark = docs.sparkSession
    moved = with_next(docs, text_col, id_col, parts or shuffle_partitions(spark))

    def finish(rows: list[tuple], follow: str):
        texts = [r[2] for r in rows] + [follow]
        edited = []
        for t, nxt in zip(texts, texts[1:], strict=False):
            half = len(t) // 2
            edited.append(t[: len(t) - half] + nxt[:half])
        fps = fingerprints(texts)
        changed = fingerprints(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[1] for r in rows], pa.from_numpy_dtype(np.int64)),
                pa.array([len(r[2]) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited], pa.string()),
                pa.array(fps[:-1], pa.string()),
                pa.array(changed, pa.string()),
                pa.array([likeness(a, b) for a, b in zip(fps, changed, strict=False)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(fps, fps[1:], strict=False)], pa.float64()),
            ],
            [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows that wait for the one after them
        size, part, first = 0, None, ""
        for batch in batches:
            for p, ghost, i, text in zip(*(batch.column(k) for k in range(4)), strict=True):
                p, ghost, i, text = p.as_py(), ghost.as_py(), i.as_py(), text.as_py()
                if p != part:
                    if held:  # a range without ghosts holds rows without id only
                        yield finish(held, first)
                    held, size, part, first = [], 0, p, text
                if ghost:
                    if held:
                        yield finish(held, text)
                        held, size = [], 0
                    continue
                if held and size >= BLOCK_CHARS:
                    yield finish(held, text)
                    held, size = [], 0
                held.append((p, i, text))
                size += len(text) + 1
        if held:
            yield finish(held, first)

    schema = T.StructType(
        [docs.schema[id_col], T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]
    )
    return moved.mapInArrow(run, schema)
