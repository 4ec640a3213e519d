"""URL verdicts by fixed rules and by mined token combinations.

Where no fixed rule fits, rules mined by FP-growth decide: each labelled URL is
a transaction of its tokens and its label; combinations of tokens that lead to
the label ``block`` with enough support and confidence are kept, less those
that a part of them makes needless. A rule is filed under its rarest token, so
that a URL is only compared with rules that hold one of its own tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK, ALLOW = "block", "allow"
LABEL = "=block"
MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE = 0.005, 30, 0.6

# Fixed values of the contract: verdict and rule (host, then path).
RULES = (
    (BLOCK, "com/en/"),
    (ALLOW, "example.com/en/7"),
    (ALLOW, "net/de/"),
    (BLOCK, "example.net/de/8"),
    (BLOCK, "org/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FORM = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host(url):
    return F.translate(F.coalesce(F.regexp_extract(url, _FORM, 1), F.lit("")), UPPER, LOWER)


def path(url):
    return F.coalesce(F.regexp_extract(url, _FORM, 2), F.lit(""))


def fixed_rule(h, p, rules=RULES):
    """The longest rule that fits, or null; and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones take precedence
        domain, _, rest = rule.partition("/")
        fits = ((h == domain) | h.endswith("." + domain)) & p.startswith("/" + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def tokens(url):
    """Distinct tokens: labels of the host, directories, last segment and ending of the path, keys and pairs of the query, a fragment's name."""
    h, p = host(url), path(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    own = lambda kind, items: F.transform(items, lambda x: F.concat(F.lit(kind), x))
    parts = [
        own("h:", F.split(h, r"\.")),
        own("p:", F.split(F.regexp_replace(p, r"[^/]*$", ""), "/")),
        own("s:", F.array(F.regexp_extract(p, r"([^/]*)$", 1))),
        own("e:", F.array(F.regexp_extract(p, r"\.([A-Za-z0-9]+)$", 1))),
        own("q:", F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^([^=]*)", 1))),
        own("v:", F.filter(F.split(query, "&"), lambda x: x.rlike(r"=."))),
        own("f:", F.array(F.regexp_extract(url, r"#(.*)$", 1))),
    ]
    return F.coalesce(F.array_distinct(F.filter(F.concat(*parts), lambda x: F.length(x) > 2)), F.array().cast("array<string>"))


def implied(rule: frozenset[str]) -> frozenset[str]:
    """The rule's tokens and those that come with them: a pair's key, a segment's ending."""
    keys = {f"q:{t[2:].split('=', 1)[0]}" for t in rule if t.startswith("v:")}
    return rule | keys | {f"e:{m[1]}" for t in rule if t.startswith("s:") and (m := re.search(r"\.([A-Za-z0-9]+)\Z", t))}


def mine(pages: DataFrame, labels: DataFrame, url_col: str = "url", id_col: str = "page_id", label_id: str = "doc_id", min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> list[frozenset[str]]:
    """Antecedents of rules for ``block``: labelled URLs are bad with quality 0 or toxic 1.

    Every labelled URL counts; a rule needs min_rows of them as well as its
    share. With few tokens in a URL and a least support,
    the number of rules is bounded whatever the table's size. Rows without
    labels, ids or URLs teach nothing; without labelled rows there are no rules.
    """
    bad = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("__id")).agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    known = pages.where(F.col(url_col).isNotNull()).select(F.col(id_col).alias("__id"), tokens(F.col(url_col)).alias("t")).join(bad, "__id")
    items = known.select(F.when(F.col("bad") == 1, F.array_append("t", F.lit(LABEL))).otherwise(F.col("t")).alias("items"))
    n = items.count()
    if n < min_rows:
        return []
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_rows / n), minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(LABEL))).select("antecedent").collect()
    found = sorted({frozenset(r[0]) for r in rules}, key=lambda r: (len(r), sorted(r)))
    kept: list[frozenset[str]] = []
    for r in found:
        whole = implied(r)
        if not any(k <= whole for k in kept):
            kept.append(r)
    return kept


def inverted(rules: list[frozenset[str]]) -> dict[str, list[frozenset[str]]]:
    """Rules by the token that fewest rules hold."""
    uses: dict[str, int] = {}
    for r in rules:
        for t in r:
            uses[t] = uses.get(t, 0) + 1
    out: dict[str, list[frozenset[str]]] = {}
    for r in rules:
        out.setdefault(min(r, key=lambda t: (uses[t], t)), []).append(r)
    return out


def judge(pages: DataFrame, mined: list[frozenset[str]], rules=RULES, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """id, host, path, rule, verdict for each row; other columns are left out.

    A null URL or one without :// has an empty host and path and fits no fixed
    rule; without a mined rule that matches, the verdict is allow. Rows that
    repeat are judged one by one.
    """
    index = inverted(mined)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ts in batch.column(4):
                own = set(ts.as_py() or ())
                out.append(BLOCK if any(r <= own for t in own for r in index.get(t, ())) else ALLOW)
            given = batch.column(5)
            verdict = pa.compute.coalesce(given, pa.array(out, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], verdict], [*batch.schema.names[:4], "verdict"])

    url = F.col(url_col).cast("string")
    parted = pages.select(F.col(id_col), host(url).alias("host"), path(url).alias("path"), tokens(url).alias("t"))
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    ready = parted.select(id_col, "host", "path", name.alias("rule"), "t", verdict.alias("given"))
    schema = T.StructType([pages.schema[id_col], *[T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")]])
    return ready.mapInArrow(match, schema)
