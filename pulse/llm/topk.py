"""Exact top-k inner products over vectors sorted by length.

Vectors are turned by the right singular vectors of the whole table, so that
the first coordinates carry most of a product. A stored block holds vectors of
similar length, longest first: their turned coordinates, the lengths of what
remains after each cut, and the original integers. A query's threshold is its
k-th best score in the longest blocks; by Cauchy-Schwarz a block whose longest
vector times the query's length stays under it is never looked at, and within a
block a vector is dropped as soon as its partial sum plus the product of the
two remainders stays under it. What is left is scored exactly, in integers.

The queries go to the blocks in passes of at most PASS_BYTES, so that neither
the driver nor a task ever holds more of them, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.llm.common import at_end, remove, shared_dir, shuffle_partitions, stored

BLOCK_ROWS = 2048
QUERY_ROWS = 256
PASS_BYTES = 8 << 20  # of the integers of the queries that go to all blocks together
CUTS = (8, 16, 32)


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, ints: floor(scale * x) of each component as double; null vectors and those with null or non-finite components are left out."""
    ok = F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return df.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), scaled.alias("ints"))


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors by falling singular value, from the Gram matrix, which is summed where the rows are."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = matrix(batch.column(0), width).astype(np.float64)
            total += m.T @ m
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "x"])

    cells = vectors.select("ints").mapInArrow(gram, "i bigint, j bigint, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    i, j, x = (cells.column(c).to_numpy() for c in ("i", "j", "x"))  # half of width squared
    g = np.zeros((width, width))
    g[i, j] = g[j, i] = x
    return np.linalg.eigh(g)[1][:, ::-1].copy()


def matrix(column, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width)


def tails(turned: np.ndarray) -> np.ndarray:
    """Lengths of the coordinates after each cut, the whole vector's first."""
    return np.stack([np.sqrt((turned[:, c:] ** 2).sum(1)) for c in (0, *CUTS)], 1)


class Best:
    """The best k of each query, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.ids = [np.empty(0, np.int64)] * n
        self.scores = [np.empty(0, np.int64)] * n

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate((self.ids[q], ids)), np.concatenate((self.scores[q], scores))
        top = np.lexsort((ids, -scores))[: self.k]
        self.ids[q], self.scores[q] = ids[top], scores[top]

    def floor(self, q: int) -> float:
        return float(self.scores[q][-1]) if len(self.scores[q]) == self.k else -np.inf


class Asked(NamedTuple):
    """Queries with what their turned coordinates are and leave."""

    ids: np.ndarray
    items: np.ndarray
    floors: np.ndarray
    turned: np.ndarray
    rests: np.ndarray


def asked_of(ids: np.ndarray, items: np.ndarray, floors: np.ndarray, turn: np.ndarray) -> Asked:
    turned = items @ turn
    return Asked(ids, items, floors, turned, tails(turned))


def search_block(asked: Asked, vectors: np.ndarray, ids: np.ndarray, turn: np.ndarray, best: Best) -> None:
    """Adds to best what a block (longest vectors first) has for each query."""
    queries, tq, rq = asked.items, asked.turned, asked.rests
    tv = vectors @ turn
    rv = tails(tv)
    slack = 1e-6 * (1 + rq[:, 0].max(initial=0) * rv[:, 0].max(initial=0)) + 1  # above the rounding of the turned sums
    for q in range(len(queries)):
        least = max(asked.floors[q], best.floor(q)) - slack
        live = np.arange(int(np.searchsorted(-rv[:, 0], -least / rq[q, 0], side="right")) if rq[q, 0] > 0 and least > 0 else len(ids))
        done, partial = 0, np.zeros(len(live))
        for c, cut in enumerate((*CUTS, vectors.shape[1])):
            if not len(live) or cut > vectors.shape[1]:
                break
            partial += tv[live, done:cut] @ tq[q, done:cut]
            rest = rq[q, c + 1] * rv[live, c + 1] if c < len(CUTS) else 0.0
            ok = partial + rest >= least
            live, partial, done = live[ok], partial[ok], cut
        live = live[ids[live] != asked.ids[q]]
        if len(live):
            small = rq[q, 0] * rv[0, 0] < 1 << 52  # every partial sum is an integer that a double holds
            exact = vectors[live] @ queries[q] if small else vectors[live].astype(np.int64) @ queries[q].astype(np.int64)
            best.add(q, ids[live], exact.astype(np.int64))


def unpacked(row, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, integers and floors of a block."""
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["items"], np.int64).reshape(-1, width).astype(np.float64), np.frombuffer(row["floors"], np.float64)


def top_k(df: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id is divisible by ``every``.

    Scores are integer inner products of the scaled vectors, ties go to the
    smaller id; fewer than k candidates give all of them. Null vectors, rows
    without id, vectors with null or non-finite components and vectors of
    another number of components than most take no part (of numbers that are
    as frequent the larger one counts). Rows that share an id are separate
    candidates; none of them is a candidate of its own id.
    """
    spark = df.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    vectors = stored(integer_vectors(df, id_col, vector_col, scale).where("id IS NOT NULL"))
    first = vectors.where(F.size("ints") > 0).groupBy(F.size("ints").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    if first is None:
        return spark.createDataFrame([], schema)
    width = first["n"]
    vectors = vectors.where(F.size("ints") == width)
    turn = rotation(vectors, width)
    parts = shuffle_partitions(spark)

    norm2 = F.aggregate("ints", F.lit(0).cast("long"), lambda a, x: a + x * x)
    vectors = vectors.withColumn("norm2", norm2)
    ordered = vectors.repartitionByRange(parts, F.desc("norm2"), "id").sortWithinPartitions(F.desc("norm2"), "id")
    blocks = ordered.select("id", "ints", F.lit(0.0).alias("floor")).mapInArrow(lambda b: packed(b, width, BLOCK_ROWS), BLOCK_SCHEMA)
    v_blocks = stored(blocks.withColumn("block", F.monotonically_increasing_id()))
    asked = vectors.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("ints").alias("ints"))

    # the block of the longest vectors, one row of bounded size, gives each query a first threshold
    longest = v_blocks.select("longest", "block").orderBy(F.desc("longest"), "block").first()["block"]
    seed_ids, seed, _ = unpacked(v_blocks.where(F.col("block") == longest).first(), width)
    seeds = spark.sparkContext.broadcast((seed_ids, seed))

    def first_floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items = seeds.value
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_ROWS):
                rows = batch.slice(at, QUERY_ROWS)
                q, best = matrix(rows.column(1), width).astype(np.float64), Best(rows.num_rows, k)
                search_block(asked_of(rows.column(0).to_numpy(), q, np.full(len(q), -np.inf), turn), items, ids, turn, best)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([best.floor(i) for i in range(len(q))], pa.float64())], ["id", "ints", "floor"])

    queries = stored(asked.mapInArrow(first_floors, "id bigint, ints array<bigint>, floor double"))
    seeds.destroy()

    path = shared_dir(spark)
    at_end(lambda: remove(path, spark))
    passes = -(-queries.count() * width * 8 // PASS_BYTES)
    for n in range(passes):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == n)
        served(spark, own, v_blocks, width, turn, k).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path) if passes else spark.createDataFrame([], schema)


def served(spark, queries: DataFrame, v_blocks: DataFrame, width: int, turn: np.ndarray, k: int) -> DataFrame:
    """The ranked best of each query (id, ints, floor), all of which go to every task; a task keeps k of its own blocks."""
    rows = queries.mapInArrow(lambda b: packed(b, width, QUERY_ROWS), BLOCK_SCHEMA).select("ids", "items", "floors").collect()
    blocks = [unpacked(r, width) for r in rows] or [(np.empty(0, np.int64), np.empty((0, width)), np.empty(0))]
    held = spark.sparkContext.broadcast(tuple(np.concatenate(x) for x in zip(*blocks, strict=True)))
    at_end(held.destroy)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = asked_of(*held.value, turn)
        best = Best(len(asked.ids), k)
        for batch in batches:
            for r in range(batch.num_rows):
                ids, items, _ = unpacked({c: batch.column(c)[r].as_py() for c in ("ids", "items", "floors")}, width)
                search_block(asked, items, ids, turn, best)
        if len(asked.ids):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked.ids, [len(x) for x in best.ids])), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))], ["query_id", "vec_id", "score"])

    found = v_blocks.select("ids", "items", "floors").mapInArrow(scan, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


BLOCK_SCHEMA = "longest double, ids binary, items binary, floors binary"


def packed(batches: Iterator[pa.RecordBatch], width: int, rows: int) -> Iterator[pa.RecordBatch]:
    """id, ints, floor -> blocks of ``rows`` vectors at most, in the order in which they come."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def block():
        ids, m, floors = (np.concatenate(x) for x in zip(*held, strict=True))
        longest = float(np.sqrt((m.astype(np.float64) ** 2).sum(1)).max())
        return pa.RecordBatch.from_arrays(
            [pa.array([longest]), *[pa.array([x.tobytes()], pa.binary()) for x in (ids, m, floors)]],
            ["longest", "ids", "items", "floors"],
        )

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows - sum(len(h[0]) for h in held), batch.num_rows - at)
            part = batch.slice(at, n)
            held.append((part.column(0).to_numpy(), matrix(part.column(1), width), part.column(2).to_numpy()))
            at += n
            if sum(len(h[0]) for h in held) == rows:
                yield block()
                held.clear()
    if held:
        yield block()
