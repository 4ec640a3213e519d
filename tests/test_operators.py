"""Edge cases of operators on small literal frames."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulse.functions import stats, storage
from pulse.functions.text import clean
from pulse.operators import anomaly, learning, profile, propagation, rollup
from pulse.operators.graph import connected_components
from pulse.operators.intervals import near_pairs

H = 3600


def test_gap_of_just_six_hours_stays_one_window(spark):
    rows = [("a", 0), ("a", 6 * H), ("b", 0), ("b", 6 * H + 1), ("c", 0), ("c", 6 * H - 1)]
    s = anomaly.sessions(spark.createDataFrame(rows, "channel string, hour bigint"))
    got = {r[0]: r[1] for r in s.groupBy("channel").agg(F.countDistinct("window_id")).collect()}
    assert got == {"a": 1, "b": 2, "c": 1}


def test_z_is_zero_without_baseline_or_spread(spark):
    rows = [("one", 0, 5), ("flat", 0, 3), ("flat", H, 3), ("flat", 2 * H, 9)]
    z = anomaly.rolling_z(spark.createDataFrame(rows, "channel string, hour bigint, post_count bigint"))
    assert {r["z"] for r in z.collect()} == {0.0}


def test_rollup_leaves_out_null_channels_and_scores(spark):
    rows = [(None, "comments", 10, "x", 1.0), ("a", "comments", 20, None, 1.0), ("a", "submissions", 30, "x", None)]
    act = spark.createDataFrame(rows, "channel string, data_type string, sec bigint, author string, score double")
    got = rollup.hourly(act).collect()
    assert [(r["channel"], r["post_count"], r["unique_authors"], r["mean_score"]) for r in got] == [("a", 1, 1, 1.0)]
    assert rollup.hourly(act, "mixed").count() == 2
    with pytest.raises(ValueError):
        rollup.hourly(act, "other")


def wins(spark, rows):
    return spark.createDataFrame(rows, "window_id string, channel string, window_start bigint, window_end bigint")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 90), st.integers(0, 5)), min_size=1, max_size=14), st.sampled_from([2, 6, 48]))
def test_near_pairs_equal_nested_loops(spark, rows, radius):
    data = [(f"w{i:02d}", f"c{c}", s * H, (s + d) * H) for i, (c, s, d) in enumerate(rows)]
    want = {(a[0], b[0]) for a in data for b in data if a[1] < b[1] and a[3] >= b[2] - radius * H and b[3] >= a[2] - radius * H}
    got = [tuple(r) for r in near_pairs(wins(spark, data), radius * H).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 30), st.integers(0, 12)), min_size=1, max_size=24), st.sampled_from([2, 6, 12]))
def test_near_links_connect_what_near_pairs_connect(spark, steps, radius):
    at, data = {}, []
    for i, (c, gap, long) in enumerate(steps):  # windows of a channel come one after the other
        start = at.get(c, 0) + gap
        at[c] = start + long
        data.append((f"w{i:02d}", f"c{c}", start * H, (start + long) * H))

    def groups(pairs):
        up = {d[0]: d[0] for d in data}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[find(a)] = find(b)
        return {d[0]: frozenset(e[0] for e in data if find(e[0]) == find(d[0])) for d in data}

    from pulse.operators.intervals import near_links

    want = [(a[0], b[0]) for a in data for b in data if a[1] < b[1] and a[3] >= b[2] - radius * H and b[3] >= a[2] - radius * H]
    links = [tuple(r) for r in near_links(wins(spark, data), radius * H).collect()]
    assert len(links) <= 2 * len(data) and groups(links) == groups(want)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=16))
def test_components_equal_union_find(spark, edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {x: find(x) for x in up}


def test_isolated_windows_are_dropped_or_kept(spark):
    w = wins(spark, [("a", "x", 0, H), ("b", "y", 0, H), ("c", "z", 10**6, 10**6)])
    assert {r[0] for r in propagation.clusters(w, 6).collect()} == {"a", "b"}
    assert {r[0]: r[1] for r in propagation.clusters(w, 6, include_singletons=True).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_half_within_two_hours_is_not_simultaneous(spark):
    rows = [("1", "a", 0, H), ("2", "b", 3 * H, 4 * H)]
    volume = spark.createDataFrame([("a", 100), ("b", 1)], "channel string, total_posts bigint")
    m = propagation.members(wins(spark, rows), spark.createDataFrame([("1", "k"), ("2", "k")], "window_id string, cluster_id string"), volume)
    got = propagation.profile(m, volume).first()
    assert (got["propagation_type"], got["channel_sequence"], got["num_windows"], got["num_channels"]) == ("top_down", "a|b", 2, 2)


def test_shapes():
    decay = [1.0] * 24 + [100 * math.exp(-i / 3) for i in range(73)]
    assert profile.shape(decay) == "sharp_spike"
    mixed = [x for v in decay for x in (v, 0.08 * v)]
    assert profile.shape(mixed) == "double_peak"
    assert profile.shape([]) == profile.shape([math.nan]) == "sharp_spike"
    assert profile.shape([0.0] * 9) == profile.shape([4.0] * 9) == "sustained_plateau"
    assert profile.shape([1.0] * 24 + [1 + 0.1 * i for i in range(20)] + [30.0, 1.0, 1.0]) == "slow_burn"


def test_a_peak_without_a_fall_to_half_is_not_sharp(spark):
    late = [1.0] * 25 + [5.0, 10.0, 9.0, 8.0, 7.0, 6.9]
    assert profile.shape(late) == "sustained_plateau"
    df = spark.createDataFrame([("w", late), ("v", [*late, 1.0])], "window_id string, v array<double>")
    got = {r["window_id"]: (r["peak_index"], r["time_to_peak"], r["half_decay"]) for r in profile.peak_features(profile.normalised(df)).collect()}
    assert got == {"w": (26, 2, None), "v": (26, 2, 5)}


def test_peaks_by_hand():
    x = np.array([0, 1, 0, 0, 2, 2, 2, 0, 0, 1.5, 1.4, 1.45, 0])
    assert profile.find_peaks(x).tolist() == [1, 5, 9]
    assert profile.find_peaks(np.array([3.0, 1, 2])).tolist() == []


@given(st.lists(st.floats(0, 100), min_size=30, max_size=60), st.floats(0.5, 20))
@settings(max_examples=50, deadline=None)
def test_shape_ignores_scale(values, k):
    v = np.round(values)
    assert profile.shape(v) == profile.shape(v * 2.0 ** round(k))


def test_gini(spark):
    rows = [("a", 1), ("a", 1), ("a", 1), ("b", 0), ("b", 0), ("b", 1), ("c", 0), ("c", 0), ("d", 5)]
    got = {r["k"]: r["gini"] for r in stats.gini(spark.createDataFrame(rows, "k string, v bigint"), "k", "v").collect()}
    assert got == pytest.approx({"a": 0, "b": 2 / 3, "c": 0, "d": 0})


def test_t_tail_against_tables():
    for t, df in ((12.706, 1), (2.228, 10), (2.042, 30), (1.98, 120)):
        assert stats.t_tail(t, df) == pytest.approx(0.05, abs=2e-4)
    assert stats.t_tail(0.0, 5) == pytest.approx(1) and stats.t_tail(None, 5) is None


def test_average_rank_shares_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "x double")
    assert sorted(r["r"] for r in stats.average_rank(df, "x", "r").collect()) == [1.0, 2.5, 2.5, 4.0]


def test_cleaning_order(spark):
    rows = [("see [x](http://a.b) now (ok) end",), ("/r/café x",), (None,), ("[removed]",), ("5 km per hour/day and/or/both u/me /u/you_1 r/a",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(clean(F.col("t"))).collect()]
    assert got == ["see x end", "x", "", "", "5 km per hour/day and/or/both u/me r/a"]


def test_half_ratio_and_concentration_by_hand(spark):
    from pulse.operators import features

    rows = [(e, i, p, a) for e, ps in ((1, [(7, 3)]), (2, [(1, 1), (3, 1)]), (3, [(0, 0), (0, 0), (6, 9)])) for i, (p, a) in enumerate(ps)]
    df = spark.createDataFrame(rows, "event_id bigint, i bigint, post_count bigint, unique_authors bigint")
    assert {r[0]: r[1] for r in features.half_ratio(df).collect()} == {1: 1.0, 2: 3.0, 3: 3.0}
    assert {r[0]: r[1] for r in features.gini_of(df).collect()} == pytest.approx({1: 0.0, 2: 0.0, 3: 2 / 3})


def test_no_channel_counts_where_the_own_one_is_silent(spark):
    from pulse.operators import features

    hours = [("a", h, 0) for h in range(3)] + [("b", h, 10) for h in range(3)] + [("c", h, 1) for h in range(5)] + [("d", h, 1) for h in range(5)] + [("e", 4, 50)]
    df = spark.createDataFrame([(c, h * H, n, n, 1.0) for c, h, n in hours], "channel string, hour bigint, post_count bigint, unique_authors bigint, mean_score double")
    w = spark.createDataFrame([("wa", "a", 0), ("wc", "c", 0), ("wd", "d", 9 * H)], "window_id string, channel string, window_start bigint")
    assert {r[0]: r[1] for r in features.concurrent_channels(w, df).collect()} == {"wa": 0, "wc": 1, "wd": 0}  # of 0, 1, 10, 50 only the last is over twice the median 5.5


def test_sentiment_of_long_texts_equals_brute_force_and_splits_each_once(spark):
    from pulse.operators import texts

    words = ["day", "not", "good", "no", "bad", "t", "hate", "joy"]
    rows = [("",), ("Good",), *((" ".join(words[(i * i * 7 + i * k + i // 5) % 8] for i in range(n)),) for k, n in enumerate((1, 2, 50, 3000)))]
    assert not set(texts.POSITIVE) & set(texts.NEGATIVE)
    scored = texts.sentiment(spark.createDataFrame(rows, "text string"))
    for r in scored.collect():
        w = r["text"].lower().split(" ")
        turned = [i > 0 and w[i - 1] in texts.NEGATORS for i in range(len(w))]
        pos = sum(x in (texts.NEGATIVE if t else texts.POSITIVE) for x, t in zip(w, turned, strict=True))
        neg = sum(x in (texts.POSITIVE if t else texts.NEGATIVE) for x, t in zip(w, turned, strict=True))
        assert (r["pos"], r["neg"]) == (pos, neg)
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1  # none for each word


def test_class_terms_take_texts_apart_once_and_count_topics_without_key(spark):
    from pulse.operators import texts

    rows = [("a", "the red fox saw the red fox"), ("a", None), ("b", "a red hen"), ("b", "of"), (None, "red owl")]
    df = spark.createDataFrame(rows, "topic string, text string")
    terms = texts.class_terms(df, n=50, stop_words=texts.STOP_WORDS, pairs=True)
    counts = {"a": {"red": 2, "fox": 2, "saw": 1, "red fox": 2, "fox saw": 1, "saw red": 1}, "b": {"red": 1, "hen": 1, "red hen": 1}, None: {"red": 1, "owl": 1, "red owl": 1}}
    mean = sum(sum(c.values()) for c in counts.values()) / 3
    total = lambda t: sum(c.get(t, 0) for c in counts.values())
    want = {(k, t): n / sum(c.values()) * math.log(1 + mean / total(t)) for k, c in counts.items() if k for t, n in c.items()}
    got = {(r["topic"], r["term"]): r["weight"] for r in terms.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    plan = terms._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(") + plan.count("split(") == 0  # done before, once


def test_sentiment_turns_round_after_a_negator(spark):
    from pulse.operators import texts

    rows = [("a good day",), ("not good, no harm",), ("never bad and not awful",), ("bad but lovely",), ("", ), ("x " * 4000 + "happy",)]
    got = [(r["pos"], r["neg"], r["score"]) for r in texts.sentiment(spark.createDataFrame(rows, "text string")).collect()]
    assert got == [(1, 0, 1.0), (0, 1, -1.0), (2, 0, 1.0), (1, 1, 0.0), (0, 0, 0.0), (1, 0, 1.0)]


def test_entities_by_the_words_around_them(spark):
    from pulse.operators import texts

    df = spark.createDataFrame([("w", 1, "said Jane Doe in Ulm, by World Bank near Old City and It. Then " + "x " * 3000 + "with Max")], "window_id string, text_id bigint, text string")
    got = sorted((r["entity_text"], r["entity_label"]) for r in texts.entities(df).collect())
    assert got == [("Jane Doe", "PERSON"), ("Max", "PERSON"), ("Old City", "GPE"), ("Ulm", "GPE"), ("World Bank", "ORG")]


def test_topics_are_clusters_with_noise(spark):
    from pulse.operators import texts

    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in (np.eye(3)[i % 3] * 10 + rng.normal(0, 0.1, 3))], "the " + ("red apple", "blue sky", "green sea")[i % 3]) for i in range(90)]
    rows += [(200, [14.0, 0.0, 0.0], "far"), (201, None, "none"), (202, [float("nan"), 0.0, 0.0], "nan")]
    df = spark.createDataFrame(rows, "i bigint, v array<double>, text string")
    got = {r["i"]: r["topic"] for r in texts.assign_topics(df, "i", "v", k=3).collect()}
    assert set(got) == set(range(90)) | {200} and got[200] == -1
    kinds = [{got[i] for i in range(k, 90, 3)} - {-1} for k in range(3)]
    assert all(len(k) == 1 for k in kinds) and len(set.union(*kinds)) == 3 and sum(t == -1 for t in got.values()) < 10
    told = spark.createDataFrame([(t, dict((r[0], r[2]) for r in rows)[i]) for i, t in got.items()], "topic int, text string")
    report = {r["topic"]: r for r in texts.topic_report(told).collect()}
    assert {report[next(iter(k))]["terms"] for k in kinds} == {"apple, red, red apple", "blue, blue sky, sky", "green, green sea, sea"}
    assert texts.assign_topics(df.where("i > 200"), "i", "v").count() == 0


def test_a_failing_model_says_so(spark):
    from pulse.operators import texts

    df = spark.createDataFrame([("w", 1, "one")], "window_id string, text_id bigint, text string")
    assert [tuple(r)[2:] for r in texts.score_with(df, lambda cs: 1 / 0).collect()] == [(0.0, True)]


def test_binary_metrics_by_hand(spark):
    rows = [(0.9, 1.0, 1.0), (0.8, 0.0, 1.0), (0.8, 1.0, 1.0), (0.3, 0.0, 0.0), (0.1, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "probability double, label double, prediction double")
    r = learning.binary_metrics(df).first()
    assert (r["n"], r["positives"]) == (5, 3)
    assert r["auc"] == pytest.approx((2 + 1.5 + 0) / 6) and r["average_precision"] == pytest.approx((1 / 1 + 2 / 3 + 3 / 5) / 3)
    assert (r["precision"], r["recall"], r["f1"]) == pytest.approx((2 / 3, 2 / 3, 2 / 3))
    one = learning.binary_metrics(df.where("label = 0")).first()
    assert (one["auc"], one["average_precision"], one["precision"], one["recall"], one["f1"]) == (None, None, 0.0, 0.0, 0.0)


def test_unlabelled_windows_get_the_category_of_their_kind(spark):
    rows = [(f"w{i}", float(i % 2), float(i), ("b", "a")[i % 2] if i < 24 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "window_id string, x double, y double, category string")
    got = {r["window_id"]: r for r in learning.predict_unlabelled(df, ["x", "y"], "window_id", trees=20).collect()}
    assert len(got) == 40 and all(got[f"w{i}"]["predicted_category"] == ("b", "a")[i % 2] and got[f"w{i}"]["is_labeled"] == (i < 24) for i in range(40))
    assert learning.predict_unlabelled(df.where("y < 5"), ["x", "y"], "window_id").count() == 0


def test_splits_fall_back_to_strata(spark):
    df = spark.createDataFrame([(f"i{i}", i, float(i < 10)) for i in range(40)], "window_id string, at bigint, label double")
    train, test = learning.time_or_stratified_split(df, "at", "label", "window_id")
    assert train.count() == 32 and test.where("label = 1").count() == 2 and not {r[0] for r in train.select("window_id").collect()} & {r[0] for r in test.select("window_id").collect()}


def test_scopes_leave_nothing_behind(spark):
    import os

    from pulse.functions import storage

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(base))
    with storage.scope():
        inner = storage.stored(spark.range(3))
        with storage.scope():
            storage.stored(inner)
            kept = storage.lasting(inner.where("id > 0"))
        assert len(set(os.listdir(base)) - before) == 2 and kept.count() == 2
        with storage.scope():
            edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "src bigint, dst bigint")
            assert connected_components(edges).where("component = 1").count() == 3
    assert set(os.listdir(base)) == before


def test_readers_and_sinks(spark, tmp_path):
    from pulse.sources import readers

    rows = [(2024, 1, "a", 1.0), (2024, 2, "a", 2.0), (2024, 2, "b", 3.0)]
    df = spark.createDataFrame(rows, "yyyy int, mm int, channel string, score double")
    base = str(tmp_path / "posts")
    readers.write_months(df, base)
    readers.write_months(spark.createDataFrame([(2024, 2, "c", 9.0)], df.schema), base)
    got = readers.read_posts(spark, base, ["channel", "score"])
    assert sorted(map(tuple, got.collect())) == [("a", 1.0), ("c", 9.0)]
    some = readers.read_posts(spark, base, ["score"], [(2024, 2)], ["c", "d"])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert some.columns == ["score"] and some.count() == 1 and "PartitionFilters: [" in plan and "PushedFilters: [" in plan and "ReadSchema: struct<channel:string,score:double>" in plan
    assert readers.is_done(spark, base) and not readers.is_done(spark, base, str(tmp_path / "none"))
    assert readers.read_optional(spark, str(tmp_path / "none"), df.schema).count() == 0 and readers.read_optional(spark, base, df.schema).count() == 2
    readers.write_table(df, str(tmp_path / "two" / "t"))
    assert readers.read_local_first(spark, "t", str(tmp_path / "one"), str(tmp_path / "two")).count() == 3
    with pytest.raises(FileNotFoundError):
        readers.read_local_first(spark, "u", str(tmp_path / "two"))
    (tmp_path / "events.csv").write_text("event_id,date,name,category,relevant_channels\n1,2024-01-03,launch,technology,a|b\n")
    event = readers.read_event_catalogue(spark, str(tmp_path / "events.csv")).first()
    assert (event["event_id"], str(event["date"]), event["relevant_channels"]) == (1, "2024-01-03", "a|b")
    assert readers.write_summary(df.where("channel = 'b'"), str(tmp_path / "out" / "s.json")) == {"yyyy": 2024, "mm": 2, "channel": "b", "score": 3.0}
    assert readers.write_summary(df.limit(0), str(tmp_path / "s.json")) == {}


def test_texts_by_month_are_read_from_their_source_once(spark, tmp_path):
    from pulse.sources import readers

    asked = []
    jan, feb = 1704067200 + 3600, 1706745600 + 3600

    def source():
        asked.append(1)
        return spark.createDataFrame([("a", jan, 1, "one"), ("a", feb, 2, "two")], "channel string, sec bigint, text_id bigint, text string")

    path = f"file://{tmp_path}/texts"
    assert [r["text"] for r in readers.cached_texts(spark, path, source, [(2024, 1)]).collect()] == ["one"]
    assert {r["text"] for r in readers.cached_texts(spark, path, source, [(2024, 2), (2024, 3), (2024, 1)]).collect()} == {"one", "two"}
    before = len(asked)
    assert [r["text"] for r in readers.cached_texts(spark, path, source, [(2024, 2)]).collect()] == ["two"]
    assert len(asked) == before + 1  # for the columns only


def test_bernoulli_sample(spark):
    from pulse.functions.stats import bernoulli

    df = spark.range(2000)
    got = bernoulli(df, 500, ["id"])
    assert 400 < got.count() < 600 and got.collect() == bernoulli(df, 500, ["id"]).collect()
    assert bernoulli(df, 5000, ["id"]).count() == 2000 and bernoulli(df.limit(0), 5, ["id"]).count() == 0

def test_folds_are_stratified_and_stable(spark):
    df = spark.range(40).select(F.col("id").cast("string").alias("i"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    a = learning.folds(df, "label", "i", 5)
    counts = {(r[0], r[1]): r[2] for r in a.groupBy("label", "fold").count().collect()}
    assert set(counts.values()) == {2, 6} and len(counts) == 10


def test_streaming_equals_batch(spark, tmp_path):
    from pulse.streaming.live import hourly_stream, session_stream

    posts = spark.createDataFrame([("a", i * 1200, f"u{i % 3}", 1.0) for i in range(30)], "channel string, sec bigint, author string, score double")
    posts = posts.select("channel", F.timestamp_seconds("sec").alias("ts"), "author", "score")
    posts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(posts.schema).parquet(str(tmp_path / "in"))
    q = hourly_stream(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["hour"].timestamp(), r["post_count"]) for r in spark.table("hours").collect())
    assert len(got) == 10 and {n for _, n in got} == {3}
    marks = spark.createDataFrame([("a", h * H, 4.0) for h in (0, 6, 13)], "channel string, s bigint, z double").select("channel", F.timestamp_seconds("s").alias("hour"), "z")
    marks.write.parquet(str(tmp_path / "m"))
    q = session_stream(spark.readStream.schema(marks.schema).parquet(str(tmp_path / "m"))).writeStream.format("memory").queryName("wins").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["anomaly_hours"] for r in spark.table("wins").collect()) == [1, 2]


def test_models_read_whole_texts_in_chunks(spark):
    from pulse.operators import texts

    for t in ("", "short", "a" * 25, "ab cd " * 9, "x" * 12 + " y", " " * 30):
        got = texts.chunks(t, 10)
        assert "".join(got) == t and all(len(c) <= 10 for c in got)
    df = spark.createDataFrame([("w", 1, "bad " * 5 + "good " * 4 + "End"), ("w", 2, "ok")], "window_id string, text_id bigint, text string")
    found = texts.extract_with(df, lambda cs: [[(x, "K") for x in c.split() if x == "End"] for c in cs], 10)
    assert [tuple(r) for r in found.collect()] == [("w", 1, "End", "K")]
    scored = texts.score_with(df, lambda cs: [(1.0, 0.0, 0.0) if "bad" in c else (0.0, 0.0, 1.0) for c in cs], 20)
    got = {r["text_id"]: r["score"] for r in scored.collect()}
    assert -1 < got[1] < 1 and got[2] == 1.0


def test_clean_documents_equals_sql_on_long_null_and_foreign_texts(spark, tmp_path):
    import duckdb

    from pulse import registry

    rows = [(1, None), (2, ""), (3, "[removed]"), (4, "see\u00a0https://a.b/\u00e9\u3000now"), (5, "u/na\u00efve_\u4e2d\u0301\u203f9 r/x-y \u00a0\u2003 z"), (6, "[x](a\nb) *b* ~#> \x1c\x0b`"), (7, "word https://c.d [l](m)  /r/q\t" * 3000), (8, "\U0001f642 /u/\U0001f170\u24b6 \u200d\x85 e")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(c.execute(registry.oracle_sql()["clean_documents"]).fetchall())
    got = {r["doc_id"]: r["cleaned"] for r in registry.queries()["clean_documents"](spark, str(tmp_path)).collect()}
    assert got == want and got[1] == got[3] == "" and got[7] == " ".join(["word l"] * 3000)


def test_release_gives_back_memory_beside_the_heap(spark):
    """Buffers freed between ones that stay: without a trim glibc keeps them for the JVM."""
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()

    def resident():
        with open(f"/proc/{pid}/statm") as f:
            return int(f.read().split()[1]) * 4096

    held = [spark._jvm.java.util.zip.Deflater() for _ in range(600)]  # a quarter of a MB each
    storage.release(spark)
    for i, x in enumerate(held):
        if i % 6:
            x.end()
    before = resident()
    storage.release(spark)
    assert resident() < before - (32 << 20)
