"""Mixing of sources to target weights by iterative proportional fitting.

Documents are counted in cells of source, language and topic; the cells' token
weights are raked to the three target marginals in turn. A cell's factor over
its own tokens, scaled so that the largest is one, is the probability with
which each of its documents is kept; a hash of the id decides. DataFrame
operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm.common import release, stored, text_or_empty

#: A marginal's target shares are its own to this power: under one, small groups gain.
POWERS = (("source", 0.7), ("lang", 0.7), ("topic", 1.0))
ROUNDS = 12
SETTLED = 1e-10
NONE = "(none)"


def topic(text):
    """A coarse topic by form: tables, numbers or prose."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    digits = F.length(text) - F.length(F.translate(text, "0123456789", ""))
    return F.when(bars * 40 >= F.length(text) + 1, "table").when(digits * 20 >= F.length(text) + 1, "figures").otherwise("prose")


def topic_of(text_col: str, topic_col: str | None):
    return topic(text_or_empty(text_col)) if topic_col is None else F.coalesce(F.col(topic_col).cast("string"), F.lit(NONE))


def draw(id_col: str):
    """A number from 0 to under 1 that an id alone fixes."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def described(docs: DataFrame, text_col: str, id_col: str, source_col: str, lang_col: str, topic_col: str | None = None) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("doc"),
        F.coalesce(F.col(source_col).cast("string"), F.lit(NONE)).alias("source"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit(NONE)).alias("lang"),
        topic_of(text_col, topic_col).alias("topic"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"),
    )


def rates(rows: DataFrame, powers=POWERS, rounds: int = ROUNDS, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """source, lang, topic, rate: the probability of a cell's documents. Cells without tokens have rate 1.

    ``targets`` gives the shares of a marginal's groups outright, by the name of
    the marginal; groups that it leaves out get nothing, shares are taken
    relative to the sum of those that occur. Raking ends after ``rounds``, or
    when a round moves no weight by more than SETTLED of itself.
    """
    dims = [d for d, _ in powers]
    cells = stored(rows.groupBy(*dims).agg(F.sum("n_tokens").cast("double").alias("tokens")).withColumn("weight", F.col("tokens")))
    marginals = []
    for d, power in powers:
        given = (targets or {}).get(d)
        share = F.pow(F.sum("tokens"), F.lit(power)) if given is None else F.max(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in given.items() for x in kv]), F.col(d)) if given else F.lit(None), F.lit(0.0)))
        own = cells.groupBy(d).agg(share.alias("t"))
        total = own.agg(F.sum("t")).first()[0] or 1.0
        marginals.append(stored(own.select(d, (F.col("t") / F.lit(total)).alias("target"))))
    cells = cells.withColumn("moved", F.lit(0.0))
    for _ in range(rounds):
        release(rows.sparkSession)  # a round's plans are large and short-lived
        cells = cells.withColumn("moved", F.lit(0.0))
        for (d, _), target in zip(powers, marginals, strict=True):
            factor = cells.groupBy(d).agg(F.sum("weight").alias("now")).join(target, d).select(d, F.when(F.col("now") > 0, F.col("target") / F.col("now")).otherwise(0.0).alias("factor"))
            cells = cells.join(factor, d).select(*dims, "tokens", (F.col("weight") * F.col("factor")).alias("weight"), F.greatest("moved", F.when(F.col("weight") > 0, F.abs(F.col("factor") - 1)).otherwise(0.0)).alias("moved"))
        cells = stored(cells)
        if (cells.agg(F.max("moved")).first()[0] or 0.0) <= SETTLED:
            break
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    most = cells.agg(F.max(ratio)).first()[0] or 1.0
    return cells.select(*dims, F.coalesce(ratio / F.lit(most), F.lit(1.0)).alias("rate"))


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, powers=POWERS, rounds: int = ROUNDS, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """doc, source, lang, topic, n_tokens, probability, kept for each row of docs.

    Without ``topic_col`` a text's form is its topic: tables, figures or prose.
    A null source, language or topic is a group of its own; a null text has no
    tokens. Rows that share an id (those without one too) are kept or dropped as
    their cells' probabilities and the one draw of the id say. An empty table
    gives an empty result.
    """
    rows = stored(described(docs, text_col, id_col, source_col, lang_col, topic_col))
    cells = stored(rates(rows, powers, rounds, targets))
    out = rows.join(cells, [d for d, _ in powers], "left")
    return out.select("doc", "source", "lang", "topic", "n_tokens", F.col("rate").alias("probability"), (draw("doc") < F.col("rate")).alias("kept"))


def sample(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that mix() keeps, with all their columns."""
    source, lang = options.get("source_col", "source"), options.get("lang_col", "lang")
    found = topic_of(text_col, options.get("topic_col"))
    cells = stored(rates(stored(described(docs, text_col, id_col, source, lang, options.get("topic_col"))), options.get("powers", POWERS), options.get("rounds", ROUNDS), options.get("targets")))
    cells = cells.select(*[F.col(c).alias(f"__{c}") for c in cells.columns])
    own = (F.coalesce(F.col(source).cast("string"), F.lit(NONE)) == F.col("__source")) & (F.coalesce(F.col(lang).cast("string"), F.lit(NONE)) == F.col("__lang")) & (found == F.col("__topic"))
    return docs.join(cells, own).where(draw(id_col) < F.col("__rate")).select(*[docs[c] for c in docs.columns])


def oracle(table: str = "documents") -> str:
    """The same as one DuckDB statement over a table like documents."""
    dims = [d for d, _ in POWERS]
    steps = [
        "rows AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,"
        " CASE WHEN (length(t) - length(replace(t, '|', ''))) * 40 >= length(t) + 1 THEN 'table'"
        " WHEN length(regexp_replace(t, '[^0-9]', '', 'g')) * 20 >= length(t) + 1 THEN 'figures' ELSE 'prose' END AS topic,"
        r" len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::bigint AS n_tokens"
        f" FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM {table}))",
        f"c0 AS (SELECT {', '.join(dims)}, sum(n_tokens)::double AS tokens, sum(n_tokens)::double AS weight FROM rows GROUP BY ALL)",
    ]
    for d, power in POWERS:
        steps.append(f"t_{d} AS (SELECT {d}, t / sum(t) OVER () AS target FROM (SELECT {d}, pow(sum(tokens), {power}) AS t FROM c0 GROUP BY {d}))")
    k = 0
    for _ in range(ROUNDS):
        for d in dims:
            rest = ", ".join(f"c.{x}" for x in dims)
            steps.append(
                f"c{k + 1} AS MATERIALIZED (SELECT {rest}, c.tokens, c.weight * f.factor AS weight FROM c{k} c JOIN (SELECT {d}, CASE WHEN sum(weight) > 0 THEN any_value(target) / sum(weight) ELSE 0 END AS factor"
                f" FROM c{k} JOIN t_{d} USING ({d}) GROUP BY {d}) f USING ({d}))"
            )
            k += 1
    steps.append(f"r AS (SELECT {', '.join(dims)}, coalesce(CASE WHEN tokens > 0 THEN weight / tokens END / (SELECT max(CASE WHEN tokens > 0 THEN weight / tokens END) FROM c{k}), 1.0) AS rate FROM c{k})")
    return (
        f"WITH {', '.join(steps)} SELECT doc_id, source, lang, topic, n_tokens, round(rate, 6) AS probability,"
        " ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint / 4294967296.0 < rate AS kept"
        f" FROM rows JOIN r USING ({', '.join(dims)})"
    )
