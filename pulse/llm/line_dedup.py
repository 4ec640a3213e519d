"""Removal of lines that another document held first, by levelled sorted runs.

A run holds (line hash, owner): the document that keeps the line. Runs are
tables bucketed and sorted by the hash, so a batch is merge-joined with each of
them without moving them. A batch first reduces its lines to one row for each
hash (its smallest document), drops the hashes that a run holds already, and
writes the rest as a run of level 0. When a level has ``fanout`` runs they are
merged into one of the next level; a last merge leaves one run.

Hashes have 128 bits: two chained 64-bit hashes of the line's key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.llm.common import at_end, remove, shared_dir, shuffle_partitions, stored, text_or_empty

# Fixed values of the contract: what is stripped, what is lower-cased, and the least length of a key.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_KEY = 10
#: A hash with over a 512th of all lines is hot; there are 512 at most, so they may be broadcast.
HOT_PART = 512


def line_key(line):
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


class LineRuns:
    """The runs of one history of batches, in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.folder = shared_dir(spark)
        at_end(self.drop)
        self.buckets = shuffle_partitions(spark)
        self.levels: list[list[str]] = []
        self.made: list[str] = []

    def _write(self, df: DataFrame) -> str:
        name = f"pulse_run_{uuid.uuid4().hex}"
        df.select("h1", "h2", "owner").write.format("parquet").option("path", f"{self.folder}/{name}").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        self.made.append(name)
        return name

    def _push(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            whole = self._merge(merged)
            self._remove(merged)
            self._push(whole, level + 1)

    def _merge(self, names: list[str]) -> str:
        """Runs never share a hash, so merging only brings them together."""
        whole = self.spark.table(names[0])
        for n in names[1:]:
            whole = whole.union(self.spark.table(n))
        return self._write(whole.repartition(self.buckets, "h1", "h2"))

    def add(self, lines: DataFrame) -> None:
        """lines: h1, h2, owner, any number for a hash."""
        fresh = lines.groupBy("h1", "h2").agg(F.min("owner").alias("owner"))
        for name in [n for level in self.levels for n in level]:
            fresh = fresh.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self._push(self._write(fresh), 0)

    def owners(self) -> DataFrame:
        names = [n for level in self.levels for n in level]
        if len(names) > 1:
            self.levels = [[] for _ in self.levels]
            whole = self._merge(names)
            self._remove(names)
            self._push(whole, len(self.levels))
            names = [n for level in self.levels for n in level]
        return self.spark.table(names[0])

    def _remove(self, names: list[str]) -> None:
        for n in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")
            remove(f"{self.folder}/{n}", self.spark)
            self.made.remove(n)

    def drop(self) -> None:
        for n in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")
        self.made.clear()
        remove(self.folder, self.spark)


def hash_lines(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """doc, row (a hash of the text), pos, h1, h2: the hashes are null for keys that are too short and rows without id."""
    lines = docs.select(
        F.col(id_col).alias("doc"),
        F.xxhash64(text_or_empty(text_col)).alias("row"),
        F.posexplode(F.split(text_or_empty(text_col), "\n", -1)).alias("pos", "line"),
    )
    key = line_key(F.col("line"))
    long = lines.select("doc", "row", "pos", F.when((F.length(key) >= MIN_KEY) & F.col("doc").isNotNull(), key).alias("key"))
    return long.select("doc", "row", "pos", F.when(F.col("key").isNotNull(), F.xxhash64("key")).alias("h1"), F.when(F.col("key").isNotNull(), F.xxhash64(F.lit("second"), F.col("key"))).alias("h2"))


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", batches: int = 4, fanout: int = 3) -> DataFrame:
    """docs with the text reduced to its kept lines, and columns n_lines, n_dropped (replaced if docs has them).

    Batches are ranges of ascending ids, so each line stays in the smallest id
    that holds it, every time it occurs there. A null or empty text is one
    empty line, which stays (the text becomes empty). Lines whose key has
    under 10 characters always stay. Rows without an id lose nothing and own
    nothing; rows that share an id count as one document. Other columns,
    whatever their names, are kept.
    """
    spark = docs.sparkSession
    lines = stored(hash_lines(docs, text_col, id_col))

    cuts = sorted(set(lines.approxQuantile("doc", [i / batches for i in range(1, batches)], 0.01))) if dict(lines.dtypes)["doc"] in ("bigint", "int", "smallint", "tinyint", "double", "float") else []
    runs = LineRuns(spark, fanout)
    keyed = lines.where("h1 IS NOT NULL").select("h1", "h2", F.col("doc").alias("owner"))
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = keyed
        if low is not None:
            part = part.where(F.col("owner") > low)
        if high is not None:
            part = part.where(F.col("owner") <= high)
        runs.add(part)
    owners = runs.owners()

    counted = keyed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("owner"))
    least = max(1, keyed.count() // HOT_PART)
    hot = F.broadcast(spark.createDataFrame(counted.where(F.col("n") > least).select("h1", "h2", "owner").collect(), keyed.schema))
    known = lines.where("h1 IS NOT NULL")
    cold = known.join(hot, ["h1", "h2"], "left_anti").join(owners, ["h1", "h2"])
    warm = known.join(hot, ["h1", "h2"])
    flags = cold.unionByName(warm).select("doc", "row", "pos", (F.col("owner") != F.col("doc")).alias("gone"))
    flags = flags.unionByName(lines.where("h1 IS NULL").select("doc", "row", "pos", F.lit(False).alias("gone")))
    per_row = flags.groupBy("doc", "row").agg(F.sort_array(F.collect_set(F.struct("pos", "gone"))).alias("marks"))
    per_row = per_row.select(F.col("doc").alias("__doc"), F.col("row").alias("__row"), F.transform("marks", lambda m: m["gone"]).alias("__gone"))

    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    src = docs.select(*names).withColumn("__hash", F.xxhash64(text_or_empty(text_col)))
    both = src.join(per_row, src[id_col].eqNullSafe(per_row["__doc"]) & (src["__hash"] == per_row["__row"]), "left")
    pairs = F.arrays_zip(F.split(text_or_empty(text_col), "\n", -1).alias("line"), F.col("__gone").alias("gone"))
    kept = F.array_join(F.transform(F.filter(pairs, lambda p: ~p["gone"]), lambda p: p["line"]), "\n")
    return both.select(
        *[kept.alias(c) if c == text_col else F.col(c) for c in names],
        F.size("__gone").cast("long").alias("n_lines"),
        F.size(F.filter("__gone", lambda g: g)).cast("long").alias("n_dropped"),
    )
