"""Every query that has SQL gives what the SQL gives on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from pulse import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, values):
    at = sorted(range(len(names)), key=lambda i: names[i])
    near = lambda x: round(x, 5) + 0.0 if isinstance(x, float) else x
    return sorted(map(repr, ([near(v[i]) for i in at] for v in values)))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) ))
def test_runs(spark, name):
    n = registry.queries()[name](spark, SF).count()
    assert n > 0 or name == "predict_windows"  # which needs ten labelled windows; test_operators has more


def test_candidates_keep_away_from_every_event(spark, duck, tmp_path):
    from pyspark.sql import functions as F

    from pulse.sources.activity import catalogue

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.unionByName(events.withColumn("ts", F.col("ts") + F.expr("INTERVAL 200 DAYS"))).write.parquet(str(tmp_path / "events.parquet"))
    days = [r["day_sec"] // 86400 for r in catalogue(spark).collect()]
    got = [tuple(r) for r in registry.queries()["negative_candidates"](spark, str(tmp_path)).select("channel", "hour").collect()]
    assert len(days) > 3 and len(got) == 3 * len(days)
    assert all(abs(h // 86400 - d) > 3 for _, h in got for d in days)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(got) == sorted(c.execute(registry.oracle_sql()["negative_candidates"]).fetchall())


def test_clusters_link_windows_up_to_48_hours_apart(spark, duck):
    ids = {r["window_id"]: r["cluster_id"] for r in registry.queries()["event_clusters_48h"](spark, SF).collect()}
    pairs = registry.queries()["cooccurring_pairs"](spark, SF).collect()
    assert pairs and {x for r in pairs for x in (r["a"], r["b"])} == set(ids)
    assert all(ids[r["a"]] == ids[r["b"]] for r in pairs)
