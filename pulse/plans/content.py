"""Queries on texts, features and models."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from pulse.functions.storage import stored
from pulse.functions.text import clean, usable
from pulse.operators import features as feats
from pulse.operators import labels, learning, rollup, texts
from pulse.plans.common import DETECT12, VOLUME, Catalogue, detected, hours12, sql, windows12
from pulse.sources import activity
from pulse.sources.activity import FIRST, catalogue, catalogue_sql

C = Catalogue()
_TEXT = f"texts AS (SELECT 'ch' || (doc_id % 12) AS channel, {FIRST} + (doc_id * 7 % 720) * 3600 AS sec, doc_id AS text_id, text FROM documents), good AS (SELECT * FROM texts WHERE text IS NOT NULL AND text NOT IN ('[deleted]', '[removed]') AND length(trim(text)) >= 1)"
_WT = f"{DETECT12}, {_TEXT}, wt AS (SELECT window_id, w.channel, text_id, sec, text FROM wins w JOIN good t ON t.channel = w.channel AND t.sec BETWEEN w.window_start AND w.window_end), bt AS (SELECT window_id, w.channel, text_id, sec, text FROM wins w JOIN good t ON t.channel = w.channel AND t.sec BETWEEN w.window_start - 1209600 AND w.window_start - 604800)"


def _wt(spark, sf_dir):
    return texts.window_texts(windows12(spark, sf_dir), activity.texts(spark, sf_dir))


def _turns(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(F.col("role").alias("channel"), F.lit(FIRST).cast("long").alias("sec"), (F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), "text")


@C.add(sql(f"{_TEXT}, turns AS (SELECT role AS channel, {FIRST}::bigint AS sec, conv_id * 1000 + turn AS text_id, text FROM conversations WHERE text IS NOT NULL AND text NOT IN ('[deleted]', '[removed]') AND length(trim(text)) >= 1)", "SELECT channel, sec, text_id, length(text)::bigint AS n FROM good UNION ALL SELECT channel, sec, text_id, length(text)::bigint FROM turns"))
def union_text(spark, sf_dir):
    u = activity.union_texts(activity.texts(spark, sf_dir), _turns(spark, sf_dir))
    return u.select("channel", "sec", "text_id", F.length("text").cast("long").alias("n"))


# Fixed inputs that show each cleaning rule.
_SAMPLES = ("[deleted]", "[removed]", "", "see https://a.b/c now", "/r/news and /u/some_one say per hour/day or r/x", "a [link](page) b", "*bold* _it_ ~x~ `c` # h > q", "two   blanks\tand tab ", "see [x](http://a.b) now (ok) end")


@C.add(
    "SELECT i::bigint AS i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN t IN ('[deleted]', '[removed]') THEN '' ELSE t END, 'https?://\\S+', '', 'g'), '/r/\\w+', '', 'g'), '/u/\\w+', '', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '[*_~`#>]', '', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM (VALUES "
    + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_SAMPLES)).replace("\t", "' || chr(9) || '")
    + ") v(i, t)"
)
def clean_text(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(_SAMPLES)), "i bigint, t string").select("i", clean(F.col("t")).alias("cleaned"))


# White space and word characters as clean() takes them, written out for engines whose \\s and \\w know ASCII only.
_BLANK = r"\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{24b6}-\x{24e9}\x{200c}\x{200d}\x{1f130}-\x{1f149}\x{1f150}-\x{1f169}\x{1f170}-\x{1f189}"


@C.add(
    f"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN text IS NULL OR text IN ('[deleted]', '[removed]') THEN '' ELSE text END, 'https?://[^{_BLANK}]+', '', 'g'), '/r/[{_WORD}]+', '', 'g'), '/u/[{_WORD}]+', '', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '[*_~`#>]', '', 'g'), '[{_BLANK}]+', ' ', 'g'), ' ') AS cleaned FROM documents"
)
def clean_documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", clean(F.col("text")).alias("cleaned"))


@C.add("SELECT doc_id, (length(trim(text)) >= 1 AND length(text) >= 10 AND text NOT IN ('[deleted]', '[removed]')) AS ok FROM documents")
def valid_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", usable(F.col("text"), 10).alias("ok"))


@C.add(sql(_WT, "SELECT window_id, text_id FROM wt"))
def window_texts(spark, sf_dir):
    return _wt(spark, sf_dir).select("window_id", "text_id")


@C.add(sql(_WT, "SELECT window_id, text_id FROM bt"))
def baseline_texts(spark, sf_dir):
    return texts.baseline_texts(windows12(spark, sf_dir), activity.texts(spark, sf_dir)).select("window_id", "text_id")


@C.add(sql(_TEXT, "SELECT channel, text_id FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY (text_id * 7919) % 10007, text_id) AS n FROM texts) WHERE n <= 5"))
def sample_texts_modulo(spark, sf_dir):
    return texts.modulo_sample(activity.texts(spark, sf_dir), "channel", "text_id", 5).select("channel", "text_id")


@C.add()
def sample_texts(spark, sf_dir):
    return texts.sample_per_group(activity.texts(spark, sf_dir), "channel", "text_id", 5).select("channel", "text_id")


#: Entity and sentiment queries take channels as windows, so that they run over all texts.
_in = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"
_GROUPS = (
    f"{_TEXT}, raw AS (SELECT channel AS window_id, text_id, string_split(unnest(regexp_extract_all(text, '([a-z]+,? [A-Z][a-z]{{2,}}(?: [A-Z][a-z]{{2,}})*)', 1)), ' ') AS words FROM good), "
    f"found AS (SELECT window_id, text_id, array_to_string(words[2:], ' ') AS entity_text, CASE WHEN words[-1] IN {_in(texts.ORGANISATIONS)} THEN 'ORG' WHEN words[-1] IN {_in(texts.PLACES)} OR words[1] IN {_in(texts.PLACE_CONTEXT)} THEN 'GPE' ELSE 'PERSON' END AS entity_label FROM raw)"
)
_COUNTS = f"{_GROUPS}, c0 AS (SELECT window_id, entity_text, entity_label, count(*)::bigint AS n FROM found GROUP BY ALL), counts AS (SELECT window_id, entity_text, entity_label, n FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY n DESC, entity_text, entity_label) AS r FROM c0) WHERE r <= 200)"


def _found(spark, sf_dir):
    t = activity.texts(spark, sf_dir).where(usable(F.col("text")))
    return texts.entities(t.select(F.col("channel").alias("window_id"), "text_id", "text"))


@C.add(sql(_COUNTS, "SELECT * FROM counts"))
def entity_counts(spark, sf_dir):
    return texts.entity_counts(_found(spark, sf_dir))


@C.add(sql(f"{_GROUPS}, e AS (SELECT DISTINCT window_id, text_id, entity_text, entity_label FROM found), p AS (SELECT a.window_id, a.entity_text AS entity1, a.entity_label AS label1, b.entity_text AS entity2, b.entity_label AS label2, count(*)::bigint AS n FROM e a JOIN e b ON a.window_id = b.window_id AND a.text_id = b.text_id AND (a.entity_text, a.entity_label) < (b.entity_text, b.entity_label) GROUP BY ALL)", "SELECT window_id, entity1, label1, entity2, label2, n FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY n DESC, entity1, label1, entity2, label2) AS r FROM p) WHERE r <= 100"))
def entity_pairs(spark, sf_dir):
    return texts.entity_pairs(_found(spark, sf_dir))


@C.add(sql(f"{_GROUPS}, t AS (SELECT entity_label, entity_text, count(*)::bigint AS n FROM found GROUP BY ALL)", "SELECT entity_label, entity_text, n, rank::int AS rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_label ORDER BY n DESC, entity_text) AS rank FROM t) WHERE rank <= 10"))
def top_entities(spark, sf_dir):
    return texts.top_per_label(_found(spark, sf_dir))


@C.add(sql(_COUNTS, "SELECT window_id, sum(n)::bigint AS entity_count, count(DISTINCT entity_text)::bigint AS unique_entities, coalesce(sum(n) FILTER (entity_label = 'PERSON'), 0)::bigint AS persons, coalesce(sum(n) FILTER (entity_label = 'ORG'), 0)::bigint AS orgs FROM c0 GROUP BY window_id"))
def entity_features(spark, sf_dir):
    return texts.entity_features(texts.entity_totals(_found(spark, sf_dir)))


@C.add(sql(f"{_COUNTS}, per AS (SELECT lower(entity_text) AS entity, entity_label, sum(n)::bigint AS n FROM c0 GROUP BY ALL)", "SELECT entity, sum(n)::bigint AS total, arg_max(entity_label, (n, entity_label)) AS label FROM per GROUP BY entity"))
def entity_totals(spark, sf_dir):
    return texts.dominant_label(texts.entity_totals(_found(spark, sf_dir)))


@C.add(sql(_COUNTS, "SELECT entity_label, count(*)::bigint AS n_rows, count(DISTINCT entity_text)::bigint AS n_entities, count(DISTINCT window_id)::bigint AS n_windows FROM c0 GROUP BY entity_label"))
def entity_summary(spark, sf_dir):
    c = texts.entity_totals(_found(spark, sf_dir))
    return c.groupBy("entity_label").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity_text").alias("n_entities"), F.countDistinct("window_id").alias("n_windows"))


_list = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
_side = lambda own, other: f"len(list_filter(words, lambda w, i: CASE WHEN coalesce(list_contains({_list(texts.NEGATORS)}, words[i - 1]), false) THEN list_contains({_list(other)}, w) ELSE list_contains({_list(own)}, w) END))::bigint"
_S = f"SELECT *, CASE WHEN pos + neg > 0 THEN (pos - neg) / (pos + neg)::double ELSE 0.0 END AS score FROM (SELECT *, {_side(texts.POSITIVE, texts.NEGATIVE)} AS pos, {_side(texts.NEGATIVE, texts.POSITIVE)} AS neg FROM (SELECT *, regexp_split_to_array(lower(text), '[^a-z]+') AS words FROM {{t}}))"
_SENT = f"{_TEXT}, half AS (SELECT channel AS window_id, text_id, sec, text FROM good), scored AS ({_S.replace('{t}', 'half')})"


def _scored(spark, sf_dir):
    t = activity.texts(spark, sf_dir).where(usable(F.col("text")))
    return texts.sentiment(t.select(F.col("channel").alias("window_id"), "text_id", "sec", "text"))


@C.add(sql(_SENT, "SELECT window_id, text_id, pos, neg, round(score, 6) AS score FROM scored"))
def sentiment_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("window_id", "text_id", "pos", "neg", "score")


@C.add(sql(_SENT, "SELECT window_id, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(stddev_pop(score), 6) AS std, round(avg(CASE WHEN score > 0.1 THEN 1.0 ELSE 0.0 END), 6) AS prop_positive, round(avg(CASE WHEN score < -0.1 THEN 1.0 ELSE 0.0 END), 6) AS prop_negative, count(*)::bigint AS n_texts, round(1.0 - avg(CASE WHEN score > 0.1 THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN score < -0.1 THEN 1.0 ELSE 0.0 END), 6) AS prop_neutral FROM scored GROUP BY window_id"))
def sentiment_stats(spark, sf_dir):
    return texts.sentiment_stats(_scored(spark, sf_dir))


_MID = FIRST + 15 * 86400
_SHIFT = f"{_SENT}, a AS (SELECT window_id, count(*)::bigint AS n1, avg(score) AS m1, var_samp(score) AS v1 FROM scored WHERE sec >= {_MID} GROUP BY window_id), b AS (SELECT window_id, count(*)::bigint AS n2, avg(score) AS m2, var_samp(score) AS v2 FROM scored WHERE sec < {_MID} GROUP BY window_id), j AS (SELECT window_id, n1, coalesce(n2, 0) AS n2, m1, m2, v1 / n1 AS e1, v2 / n2 AS e2 FROM a LEFT JOIN b USING (window_id))"


def _shift(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return texts.sentiment_shift(s.where(F.col("sec") >= _MID), s.where(F.col("sec") < _MID))


@C.add(sql(_SHIFT, "SELECT window_id, n1, n2, round(CASE WHEN n1 >= 2 AND n2 >= 2 THEN m1 - m2 END, 6) AS shift, round(CASE WHEN n1 >= 2 AND n2 >= 2 AND e1 + e2 > 0 THEN (m1 - m2) / sqrt(e1 + e2) END, 6) AS t, round(CASE WHEN n1 >= 2 AND n2 >= 2 AND e1 + e2 > 0 THEN (e1 + e2) ** 2 / (e1 ** 2 / (n1 - 1) + e2 ** 2 / (n2 - 1)) END, 6) AS df FROM j"))
def sentiment_shift(spark, sf_dir):
    return _shift(spark, sf_dir)


@C.add()
def sentiment_significance(spark, sf_dir):
    return texts.significance(_shift(spark, sf_dir))


_TOPIC = "t AS (SELECT label AS topic, text FROM embeddings JOIN documents ON vec_id = doc_id), w AS (SELECT topic, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM t), tf AS (SELECT topic, term, count(*) AS n FROM w WHERE length(term) >= 2 GROUP BY ALL), sz AS (SELECT topic, sum(n) AS size FROM tf GROUP BY topic), tot AS (SELECT term, sum(n) AS total FROM tf GROUP BY term), sc AS (SELECT tf.topic, tf.term, (n / size) * ln(1 + (SELECT avg(size) FROM sz) / total) AS weight FROM tf JOIN sz USING (topic) JOIN tot USING (term))"


def _topics(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("topic"))
    return e.join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")


@C.add(sql(_TOPIC, "SELECT topic, rank::int AS rank, term, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term) AS rank FROM sc) WHERE rank <= 10"))
def topic_terms(spark, sf_dir):
    return texts.class_terms(_topics(spark, sf_dir))


_TERMS = f"""t AS (SELECT label AS topic, text FROM embeddings JOIN documents ON vec_id = doc_id), lw AS (SELECT topic, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) >= 2 AND w NOT IN {_in(texts.STOP_WORDS)}) AS w FROM t),
w AS (SELECT topic, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM lw), {_TOPIC[_TOPIC.index("tf AS") :].replace(" WHERE length(term) >= 2", "")}"""


@C.add(sql(_TERMS, "SELECT topic, rank::int AS rank, term, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term) AS rank FROM sc) WHERE rank <= 10"))
def topic_terms_pairs(spark, sf_dir):
    """Single words and pairs, without stop words."""
    return texts.class_terms(_topics(spark, sf_dir), stop_words=texts.STOP_WORDS, pairs=True)


@C.add()
def topic_model(spark, sf_dir):
    """Topics of all embedded documents by their vectors, noise as -1."""
    return texts.assign_topics(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


@C.add()
def topic_model_details(spark, sf_dir):
    found = stored(topic_model(spark, sf_dir)).withColumnRenamed("vec_id", "doc_id")
    return texts.topic_report(found.join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id"))


_ASSIGNED = f"{DETECT12}, {_TEXT}, near AS (SELECT window_id, text_id FROM wins w JOIN good t ON t.channel = w.channel AND t.sec BETWEEN w.window_start - 86400 AND w.window_end + 86400), asg AS (SELECT window_id, CASE WHEN label = 0 THEN -1 ELSE label END AS topic FROM near JOIN embeddings ON vec_id = text_id), cnt AS (SELECT window_id, topic, count(*)::bigint AS n FROM asg GROUP BY ALL)"


def _assigned(spark, sf_dir):
    near = texts.window_texts(windows12(spark, sf_dir), activity.texts(spark, sf_dir), -86400, 86400)
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return near.join(e.select(F.col("vec_id").alias("text_id"), F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("topic")), "text_id").select("window_id", "topic")


@C.add(sql(_ASSIGNED, "SELECT w.window_id, w.channel, coalesce(arg_max(topic, (n, -topic)) FILTER (topic <> -1), -1) AS dominant_topic, count(topic) FILTER (topic <> -1)::bigint AS n_topics_present FROM wins w LEFT JOIN cnt USING (window_id) GROUP BY ALL"))
def dominant_topic(spark, sf_dir):
    return texts.dominant_topic(_assigned(spark, sf_dir), windows12(spark, sf_dir))


@C.add()
def topic_distribution(spark, sf_dir):
    return texts.topic_distribution(_assigned(spark, sf_dir))


@C.add("SELECT label AS topic, count(*)::bigint AS n FROM embeddings JOIN documents ON vec_id = doc_id GROUP BY label")
def topic_details(spark, sf_dir):
    return _topics(spark, sf_dir).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


_BASE = "bl AS (SELECT channel, median(post_count) AS median_count, avg(post_count) AS mean_count, coalesce(stddev_samp(post_count), 1.0) AS std_count, median(unique_authors) AS median_authors, median(mean_score) AS median_score FROM hourly GROUP BY channel)"


@C.add(sql(f"{DETECT12}, {_BASE}", "SELECT channel, round(median_count, 6) AS median_count, round(mean_count, 6) AS mean_count, round(std_count, 6) AS std_count, round(median_authors, 6) AS median_authors, round(median_score, 6) AS median_score FROM bl"))
def channel_baselines(spark, sf_dir):
    return feats.baselines(hours12(spark, sf_dir))


_SUSTAIN = f"{DETECT12}, {_BASE}, r AS (SELECT window_id, h.hour, h.post_count > 2 * b.median_count AND b.median_count > 0 AS hi FROM wins w JOIN hourly h ON h.channel = w.channel AND h.hour BETWEEN w.window_start AND w.window_start + 172800 JOIN bl b ON b.channel = w.channel), i AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY hour) - row_number() OVER (PARTITION BY window_id, hi ORDER BY hour) AS island FROM r), st AS (SELECT window_id, max(n) AS longest FROM (SELECT window_id, island, count(*)::bigint AS n FROM i WHERE hi GROUP BY ALL) GROUP BY window_id)"


@C.add(sql(_SUSTAIN, "SELECT window_id, coalesce(longest, 0) AS longest_streak, CASE WHEN coalesce(longest, 0) >= 24 THEN 'sustained' ELSE 'decayed' END AS sustain_label FROM wins LEFT JOIN st USING (window_id)"))
def sustain_label(spark, sf_dir, min_streak=24):
    return feats.sustain_label(*detected(spark, sf_dir), min_streak=min_streak)


#: Two hours in place of a day: on the small tables no window stays high for a day, so this is what parts them.
C.add(C.sql["sustain_label"].replace(">= 24", ">= 2"), name="sustain_label_2h")(partial(sustain_label, min_streak=2))


_CONC = f"{DETECT12}, {_BASE}, om AS (SELECT window_id, h.channel, avg(h.post_count) AS m FROM wins w JOIN hourly h ON h.channel <> w.channel AND h.hour BETWEEN w.window_start AND w.window_start + 14400 GROUP BY ALL), md AS (SELECT window_id, median(m) AS mid FROM om GROUP BY window_id), conc AS (SELECT window_id, count(*) FILTER (m > 2 * mid AND median_count > 0)::bigint AS c FROM om JOIN md USING (window_id) JOIN wins w USING (window_id) JOIN bl ON bl.channel = w.channel GROUP BY window_id)"


@C.add(sql(_CONC, "SELECT window_id, coalesce(c, 0) AS concurrent_channels FROM wins LEFT JOIN conc USING (window_id)"))
def concurrent_channels(spark, sf_dir):
    return feats.concurrent_channels(*detected(spark, sf_dir))


_EARLY = f"{_CONC}, {_WT.split(DETECT12 + ', ')[1]}, sw AS ({_S.replace('{t}', 'wt')}), si AS (SELECT window_id, abs(avg(score)) AS intensity FROM sw GROUP BY window_id), e AS (SELECT window_id, w.channel, w.window_start, count(*) AS n, CASE WHEN count(*) >= 2 THEN (arg_max(h.post_count, h.hour) - arg_min(h.post_count, h.hour)) / (count(*) - 1)::double ELSE 0.0 END AS velocity, sum(h.unique_authors) / greatest(sum(h.post_count), 1)::double AS author_diversity, CASE WHEN count(*) >= 2 THEN (arg_max(h.mean_score, h.hour) - arg_min(h.mean_score, h.hour)) / (count(*) - 1) ELSE 0.0 END AS score_acceleration, max(h.post_count) AS peak_count, avg(h.mean_score) AS mean_score FROM wins w JOIN hourly h ON h.channel = w.channel AND h.hour BETWEEN w.window_start AND w.window_start + 14400 GROUP BY ALL)"


@C.add(sql(_EARLY, "SELECT e.window_id, round(velocity, 6) AS velocity, round(author_diversity, 6) AS author_diversity, coalesce(c, 0) AS concurrent_channels, round(coalesce(intensity, 0.0), 6) AS sentiment_intensity, round(score_acceleration, 6) AS score_acceleration, peak_count, round(e.mean_score, 6) AS mean_score, round(peak_count / greatest(median_count, 1), 6) AS spike_ratio, round(median_count, 6) AS baseline, (window_start // 3600) % 24 AS hour_of_day, ((window_start // 86400 + 3) % 7 >= 5)::bigint AS is_weekend FROM e JOIN bl ON bl.channel = e.channel LEFT JOIN conc USING (window_id) LEFT JOIN si USING (window_id)"))
def early_features(spark, sf_dir):
    return _early(spark, sf_dir, *detected(spark, sf_dir))


def _early(spark, sf_dir, wins, hours):
    own = texts.sentiment(texts.window_texts(wins, activity.texts(spark, sf_dir)))
    return feats.early_features(wins, hours, sentiment=texts.sentiment_stats(own))


_PRE = f"{DETECT12}, {catalogue_sql()}, ev AS (SELECT event_id, day_sec, unnest(string_split(relevant_channels, '|')) AS channel, generate_subscripts(string_split(relevant_channels, '|'), 1) AS pos FROM catalogue), pre AS (SELECT event_id, ev.day_sec, ev.channel, pos, hour, post_count, unique_authors, mean_score, row_number() OVER (PARTITION BY event_id ORDER BY pos, hour) - 1 AS i, count(*) OVER (PARTITION BY event_id) AS n, hour >= ev.day_sec - 43200 AS late FROM ev JOIN hourly h ON h.channel = ev.channel AND h.hour BETWEEN ev.day_sec - 172800 AND ev.day_sec - 1)"
_GINI = "gi AS (SELECT event_id, CASE WHEN count(*) > 1 AND sum(post_count) > 0 THEN greatest(0.0, least(1.0, (2.0 * sum(k * post_count) - (count(*) + 1) * sum(post_count)) / (count(*) * sum(post_count)))) ELSE 0.0 END AS gini FROM (SELECT event_id, unique_authors AS post_count, row_number() OVER (PARTITION BY event_id ORDER BY unique_authors) AS k FROM pre) GROUP BY event_id)"
_ACC = "ac AS (SELECT event_id, CASE WHEN count(*) > 3 THEN ((max(post_count) FILTER (i = n - 1) - max(post_count) FILTER (i = n - 2)) - (max(post_count) FILTER (i = 1) - max(post_count) FILTER (i = 0))) / (count(*) - 2)::double ELSE 0.0 END AS acceleration FROM pre GROUP BY event_id)"
_HALF = "hr AS (SELECT event_id, CASE WHEN count(*) > 1 THEN avg(post_count) FILTER (i >= n // 2) / greatest(avg(post_count) FILTER (i < n // 2), 1.0) ELSE 1.0 END AS volume_ratio FROM pre GROUP BY event_id)"


def _pre(spark, sf_dir):
    return feats.precursor_series(catalogue(spark), hours12(spark, sf_dir))


@C.add(sql(f"{_PRE}, {_GINI}", "SELECT event_id, round(gini::double, 6) AS gini FROM gi"))
def gini(spark, sf_dir):
    return feats.gini_of(_pre(spark, sf_dir))


@C.add(sql(f"{_PRE}, {_ACC}", "SELECT event_id, round(acceleration, 6) AS acceleration FROM ac"))
def acceleration(spark, sf_dir):
    return feats.acceleration(_pre(spark, sf_dir))


@C.add(sql(f"{_PRE}, {_HALF}", "SELECT event_id, round(volume_ratio, 6) AS volume_ratio FROM hr"))
def half_ratio(spark, sf_dir):
    return feats.half_ratio(_pre(spark, sf_dir))


_FEATURES = f"{_PRE}, {_GINI}, {_ACC}, {_HALF}, pf AS (SELECT event_id, CASE WHEN count(*) > 2 THEN coalesce(regr_slope(post_count, i), 0.0) ELSE 0.0 END AS trend, CASE WHEN count(*) > 2 THEN coalesce(regr_slope(mean_score, i), 0.0) ELSE 0.0 END AS score_trend, CASE WHEN count(*) > 2 THEN coalesce(regr_slope(unique_authors, i), 0.0) ELSE 0.0 END AS author_growth, avg(post_count) AS mean_activity, stddev_pop(post_count) AS std_activity, max(post_count) AS peak_activity, avg(unique_authors) AS mean_authors, avg(mean_score) AS mean_score, count(*)::bigint AS n_hours FROM pre GROUP BY event_id), cm AS (SELECT channel, avg(post_count) AS mean_count FROM hourly GROUP BY channel), lt AS (SELECT event_id, channel, avg(post_count) FILTER (late) AS late FROM pre GROUP BY ALL), cr AS (SELECT event_id, count(*) FILTER (late > 1.5 * mean_count) / greatest((SELECT count(*) FROM ev WHERE ev.event_id = lt.event_id), 1)::double AS cross_posting_rate FROM lt JOIN cm USING (channel) GROUP BY event_id)"


@C.add(sql(_FEATURES, "SELECT event_id, round(trend, 6) AS trend, round(score_trend, 6) AS score_trend, round(author_growth, 6) AS author_growth, round(mean_activity, 6) AS mean_activity, round(std_activity, 6) AS std_activity, peak_activity, round(mean_authors, 6) AS mean_authors, round(mean_score, 6) AS mean_score, n_hours, 0.0::double AS z_mean, round(CASE WHEN std_activity > 0 THEN (peak_activity - mean_activity) / greatest(std_activity, 1.0) ELSE 0.0 END, 6) AS z_max, round(cross_posting_rate, 6) AS cross_posting_rate, round(gini::double, 6) AS gini, round(acceleration, 6) AS acceleration, round(volume_ratio, 6) AS volume_ratio FROM pf JOIN cr USING (event_id) JOIN gi USING (event_id) JOIN ac USING (event_id) JOIN hr USING (event_id)"))
def precursor_features(spark, sf_dir):
    return feats.precursor_features(catalogue(spark), stored(hours12(spark, sf_dir)))


@C.add(sql(f"{DETECT12}, {catalogue_sql()}, near AS (SELECT day_sec + d * 86400 AS day FROM catalogue, (SELECT unnest(range(-3, 4)) AS d)), ranked AS (SELECT channel, hour, row_number() OVER (ORDER BY (hour // 3600 * 7919 + length(channel) * 104729) % 10007, channel, hour) AS n FROM hourly WHERE hour - hour % 86400 NOT IN (SELECT day FROM near))", "SELECT channel, hour FROM ranked WHERE n <= 3 * (SELECT count(*) FROM catalogue)"))
def negative_candidates(spark, sf_dir):
    """Away from every event of the catalogue, three quiet hours for each."""
    return feats.negative_candidates(hours12(spark, sf_dir), catalogue(spark))


def _matrix(spark, sf_dir):
    wins, hours = detected(spark, sf_dir)
    wins = stored(wins)
    t = texts.window_texts(wins, activity.texts(spark, sf_dir), -86400, 86400)
    ent = texts.entity_features(texts.entity_totals(texts.entities(t)))
    return feats.window_matrix(wins, ent, texts.sentiment_stats(texts.sentiment(t)), texts.dominant_topic(_assigned(spark, sf_dir), wins), rollup.channel_volume(hours), labels.match_first(wins, catalogue(spark)))


_MATRIX = (
    f"{DETECT12}, {VOLUME}, {_ASSIGNED.split(DETECT12 + ', ')[1]}, nt AS (SELECT window_id, t.text_id, t.text FROM near JOIN good t USING (text_id)), "
    + _COUNTS.split(_TEXT + ", ")[1].replace("SELECT channel AS window_id, text_id, string_split", "SELECT window_id, text_id, string_split").replace("FROM good)", "FROM nt)")
    + f", ef AS (SELECT window_id, sum(n)::bigint AS entity_count, count(DISTINCT entity_text)::bigint AS unique_entities, coalesce(sum(n) FILTER (entity_label = 'PERSON'), 0)::bigint AS persons, coalesce(sum(n) FILTER (entity_label = 'ORG'), 0)::bigint AS orgs FROM c0 GROUP BY window_id), sc AS ({_S.replace('{t}', 'nt')}), ss AS (SELECT window_id, avg(score) AS mean_sentiment, stddev_pop(score) AS std_sentiment FROM sc GROUP BY window_id), dt AS (SELECT window_id, count(*) FILTER (topic <> -1)::bigint AS k FROM cnt GROUP BY window_id), {catalogue_sql()}, ev AS (SELECT event_id, day_sec, category, unnest(string_split(relevant_channels, '|')) AS channel FROM catalogue), mt AS (SELECT window_id, event_id, category FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY event_id) AS r FROM wins JOIN ev USING (channel) WHERE window_start <= day_sec + 86400 AND window_end >= day_sec - 86400) WHERE r = 1)"
)


@C.add(sql(_MATRIX, "SELECT w.window_id, w.channel, round(peak_z, 6) AS peak_z, round(mean_z, 6) AS mean_z, anomaly_hours, round(duration_hours, 6) AS duration_hours, peak_post_count, (window_start // 3600) % 24 AS hour_of_day, (window_start // 86400 + 3) % 7 AS day_of_week, ((window_start // 86400 + 3) % 7 >= 5)::bigint AS is_weekend, coalesce(entity_count, 0) AS entity_count, coalesce(unique_entities, 0) AS unique_entities, coalesce(persons, 0) AS persons, coalesce(orgs, 0) AS orgs, round(coalesce(mean_sentiment, 0), 6) AS mean_sentiment, round(coalesce(std_sentiment, 0), 6) AS std_sentiment, coalesce(k, 0) AS n_topics_present, coalesce(total_posts, 0) AS post_count, event_id, category, category IS NOT NULL AS is_labeled FROM wins w LEFT JOIN ef USING (window_id) LEFT JOIN ss USING (window_id) LEFT JOIN dt USING (window_id) LEFT JOIN volume ON volume.channel = w.channel LEFT JOIN mt USING (window_id)"))
def feature_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)


_F = ["peak_z", "mean_z", "anomaly_hours", "duration_hours", "peak_post_count", "hour_of_day", "day_of_week", "is_weekend", "entity_count", "unique_entities", "mean_sentiment", "n_topics_present", "post_count"]


def _labelled(spark, sf_dir):
    return learning.indexed(stored(_matrix(spark, sf_dir)).where("is_labeled"), "category")[0]


@C.add()
def classify_rf(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    train, test = learning.hash_split(rows, "window_id")
    model = learning.forest(_F, "label", 50, 8).fit(train)
    return learning.multiclass_metrics(model.transform(test))


@C.add()
def loocv(spark, sf_dir):
    """Out-of-fold predictions that leave out one event at a time, so windows of an event never teach about each other."""
    rows = _labelled(spark, sf_dir)
    return learning.cross_validate(rows, _F, "window_id", 0, trees=10, fold_col="event_id").select("window_id", "label", "prediction")


def _sustain(spark, sf_dir, min_streak=24):
    wins, hours = detected(spark, sf_dir)
    wins = stored(wins)
    rows = _early(spark, sf_dir, wins, hours).join(feats.sustain_label(wins, hours, min_streak=min_streak), "window_id").join(wins.select("window_id", "window_start"), "window_id")
    return stored(rows.withColumn("label", (F.col("sustain_label") == "sustained").cast("double")))


_E = ["velocity", "author_diversity", "concurrent_channels", "sentiment_intensity", "score_acceleration", "peak_count", "mean_score", "spike_ratio", "baseline", "hour_of_day", "is_weekend"]


@C.add()
def sustain_rf(spark, sf_dir, min_streak=24):
    """Every window by the model of the earlier three quarters."""
    rows = _sustain(spark, sf_dir, min_streak)
    train, _ = learning.time_split(rows, "window_start")
    return learning.predicted(train, rows, _E, 300, 10, True, True).select("window_id", "label", "prediction", "probability")


@C.add()
def importance(spark, sf_dir, min_streak=24):
    """By a model of all windows; zeros where all have one label."""
    rows = _sustain(spark, sf_dir, min_streak)
    several = rows.select("label").distinct().count() > 1
    found = learning.importance(learning.forest(_E, "label", 300, 10).fit(rows), _E) if several else [(f, 0.0) for f in sorted(_E)]
    return spark.createDataFrame(found, "feature string, importance double")


@C.add()
def forecast_cv(spark, sf_dir, min_streak=24):
    """Five-fold predictions of sustained windows from their first hours."""
    return learning.cross_validate(_sustain(spark, sf_dir, min_streak), _E, "window_id", 5, trees=100).select("window_id", "fold", "label", "prediction")


for _f in (sustain_rf, importance, forecast_cv):
    C.add(name=f"{_f.__name__}_2h")(partial(_f, min_streak=2))


_PRED = "pr AS (SELECT toxic::bigint AS actual, (doc_id % 3 = 0)::bigint AS guess, (doc_id % 17) / 16.0::double AS score FROM labels WHERE toxic IS NOT NULL)"


def _fixed_predictions(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic IS NOT NULL")
    return d.select(F.col("toxic").cast("long").alias("actual"), (F.col("doc_id") % 3 == 0).cast("long").alias("guess"), ((F.col("doc_id") % 17) / 16.0).alias("score"))


@C.add(sql(_PRED, "SELECT actual, guess, count(*)::bigint AS n FROM pr GROUP BY ALL"))
def confusion(spark, sf_dir):
    return learning.confusion(_fixed_predictions(spark, sf_dir), "actual", "guess")


@C.add(sql(f"{_PRED}, m AS (SELECT c, sum(s) AS support, sum(tp) AS tp, sum(g) AS guessed FROM (SELECT actual AS c, 1 AS s, (actual = guess)::int AS tp, 0 AS g FROM pr UNION ALL SELECT guess, 0, 0, 1 FROM pr) GROUP BY c), x AS (SELECT *, CASE WHEN guessed > 0 THEN tp / guessed ELSE 0 END AS p, tp / support AS r FROM m)", "SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum(p * support) / sum(support), 6) AS precision, round(sum(r * support) / sum(support), 6) AS recall, round(sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * support) / sum(support), 6) AS f1 FROM x"))
def multiclass_metrics(spark, sf_dir):
    return learning.multiclass_metrics(_fixed_predictions(spark, sf_dir), "actual", "guess")


@C.add(sql(f"{_PRED}, b AS (SELECT score, sum(actual) AS p, sum(1 - actual) AS n FROM pr GROUP BY score)", "SELECT score AS threshold, round(sum(p) OVER d / sum(p) OVER (), 6) AS tpr, round(sum(n) OVER d / sum(n) OVER (), 6) AS fpr FROM b WINDOW d AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)").replace("score AS threshold", "round(score, 6) AS threshold"))
def roc_points(spark, sf_dir):
    return learning.roc_points(_fixed_predictions(spark, sf_dir).withColumnRenamed("actual", "label"))


@C.add("SELECT 'documents' AS stage, count(*)::bigint AS n FROM documents UNION ALL SELECT 'events', count(*)::bigint FROM events UNION ALL SELECT 'labels', count(*)::bigint FROM labels")
def volume_funnel(spark, sf_dir):
    parts = [spark.read.parquet(f"{sf_dir}/{t}.parquet").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("stage"), "n") for t in ("documents", "events", "labels")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
