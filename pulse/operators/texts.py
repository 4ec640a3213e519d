"""Texts inside windows: entities, sentiment, topics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.calendar import DAY
from pulse.functions.stats import t_pvalue, welch
from pulse.functions.storage import stored
from pulse.functions.text import usable
from pulse.operators.intervals import slice_series

# Fixed values of the default word lists: words of good and bad feeling, words that turn them round, and what tells kinds of names apart.
POSITIVE = ("good", "great", "excellent", "amazing", "awesome", "beautiful", "best", "better", "brave", "bright", "calm", "celebrate", "cheer", "clever", "delight", "enjoy", "fair", "fantastic", "fun", "glad", "happy", "helpful", "hope", "joy", "kind", "laugh", "love", "lovely", "lucky", "nice", "peace", "perfect", "pleasant", "proud", "safe", "smile", "strong", "success", "thank", "thanks", "trust", "useful", "win", "winner", "wonderful")
NEGATIVE = ("bad", "awful", "angry", "annoying", "afraid", "attack", "boring", "broken", "cruel", "cry", "damage", "danger", "dead", "death", "disaster", "dumb", "evil", "fail", "failure", "fear", "fool", "garbage", "hate", "horrible", "hurt", "idiot", "kill", "lie", "loser", "loss", "mad", "moron", "nasty", "pain", "pathetic", "poor", "sad", "scum", "shame", "sick", "stupid", "terrible", "trash", "ugly", "weak", "worse", "worst", "wrong")
STOP_WORDS = ("a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been", "but", "by", "can", "could", "did", "do", "does", "for", "from", "had", "has", "have", "he", "her", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "just", "like", "me", "more", "most", "my", "no", "not", "of", "on", "one", "only", "or", "other", "our", "out", "over", "she", "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "to", "up", "was", "we", "were", "what", "when", "which", "who", "will", "with", "would", "you", "your")
NEGATORS = ("not", "no", "never", "without", "hardly", "nothing", "don", "isn", "wasn", "won", "can", "t")
ORGANISATIONS = ("Inc", "Corp", "University", "Council", "Bank", "Party", "Ministry", "Agency", "Club", "Company")
PLACES = ("Berlin", "Paris", "London", "Madrid", "Europe", "City", "County", "Street", "River", "Island")
PLACE_CONTEXT = ("in", "at", "from", "near", "to", "across", "around")


def window_texts(wins: DataFrame, texts: DataFrame, shift_start: int = 0, shift_end: int = 0) -> DataFrame:
    """window_id, channel, text_id, sec, text: usable texts of the window's channel from window_start + shift_start to window_end + shift_end."""
    w = wins.select("window_id", "channel", (F.col("window_start") + shift_start).alias("s"), (F.col("window_end") + shift_end).alias("e"))
    met = slice_series(w, texts.where(usable(F.col("text"))), 0, 0, "s", "e", "sec", width=DAY)
    return met.select("window_id", "channel", "text_id", "sec", "text")


def baseline_texts(wins: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts from 14 to 7 days before the window's start."""
    w = wins.select("window_id", "channel", F.col("window_start"), F.col("window_start").alias("window_end"))
    return window_texts(w, texts, -14 * DAY, -7 * DAY)


def sample_per_group(rows: DataFrame, group: str, ident: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each group, those of smallest hash of seed and id: the same on every run."""
    order = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), F.col(group), F.col(ident)), ident)
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def modulo_sample(rows: DataFrame, group: str, ident: str, n: int) -> DataFrame:
    """As sample_per_group, in the order of a multiplicative hash that any SQL engine can compute."""
    order = Window.partitionBy(group).orderBy((F.col(ident) * 7919) % 10007, ident)
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def entities(texts: DataFrame) -> DataFrame:
    """text_id, window_id, entity_text, entity_label by rule, from whole texts: runs of capitalised words after a word in lower case; the last word and the word before tell the label."""
    found = F.regexp_extract_all("text", F.lit(r"([a-z]+,? [A-Z][a-z]{2,}(?: [A-Z][a-z]{2,})*)"), 1)
    words = texts.select("window_id", "text_id", F.explode(F.transform(found, lambda x: F.split(x, " "))).alias("words"))
    last, before = F.element_at("words", -1), F.element_at("words", 1)
    label = F.when(last.isin(*ORGANISATIONS), "ORG").when(last.isin(*PLACES) | before.isin(*PLACE_CONTEXT), "GPE").otherwise("PERSON")
    return words.select("window_id", "text_id", F.array_join(F.slice("words", 2, F.size("words")), " ").alias("entity_text"), label.alias("entity_label"))


def chunks(text: str, max_chars: int) -> list[str]:
    """The whole text in pieces of max_chars at most, cut at blanks where there are any."""
    out, at = [], 0
    while len(text) - at > max_chars:
        cut = text.rfind(" ", at + 1, at + max_chars + 1)
        out.append(text[at : (cut := cut if cut > 0 else at + max_chars)])
        at = cut
    return [*out, text[at:]]


def extract_with(texts: DataFrame, extractor: Callable[[list[str]], list[list[tuple[str, str]]]], max_chars: int = 5000) -> DataFrame:
    """The same rows from a model: extractor gives (text, label) lists for a batch of chunks of max_chars at most; all chunks of a text count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.to_pydict()
            parts = [(w, i, c) for w, i, x in zip(t["window_id"], t["text_id"], t["text"], strict=True) for c in chunks(x, max_chars)]
            rows = [(w, i, e, k) for (w, i, _), es in zip(parts, extractor([c for _, _, c in parts]), strict=True) for e, k in es if len(e.strip()) > 1]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], ["window_id", "text_id", "entity_text", "entity_label"])

    return texts.select("window_id", "text_id", "text").mapInArrow(run, "window_id string, text_id bigint, entity_text string, entity_label string")


def entity_totals(found: DataFrame) -> DataFrame:
    """How often each entity occurs in a window."""
    return found.groupBy("window_id", "entity_text", "entity_label").agg(F.count(F.lit(1)).alias("n"))


def entity_counts(found: DataFrame, per_window: int = 200) -> DataFrame:
    """A report of the per_window commonest entities of each window."""
    counts = entity_totals(found)
    order = Window.partitionBy("window_id").orderBy(F.desc("n"), "entity_text", "entity_label")
    return counts.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per_window).drop("__n")


def entity_pairs(found: DataFrame, per_window: int = 100) -> DataFrame:
    """Pairs of different entities of one text, in order, counted over the window's texts."""
    sets = found.groupBy("window_id", "text_id").agg(F.array_sort(F.collect_set(F.struct("entity_text", "entity_label"))).alias("es"))
    pairs = F.flatten(F.transform("es", lambda a, i: F.transform(F.slice("es", i + 2, F.size("es")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = sets.select("window_id", F.explode(pairs).alias("p"))
    counts = rows.groupBy("window_id", F.col("p.a.entity_text").alias("entity1"), F.col("p.a.entity_label").alias("label1"), F.col("p.b.entity_text").alias("entity2"), F.col("p.b.entity_label").alias("label2")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("window_id").orderBy(F.desc("n"), "entity1", "label1", "entity2", "label2")
    return counts.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per_window).drop("__n")


def top_per_label(found: DataFrame, n: int = 10) -> DataFrame:
    totals = found.groupBy("entity_label", "entity_text").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("entity_label").orderBy(F.desc("n"), "entity_text")
    return totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def entity_features(counts: DataFrame) -> DataFrame:
    of = lambda k: F.coalesce(F.sum(F.when(F.col("entity_label") == k, F.col("n"))), F.lit(0))
    return counts.groupBy("window_id").agg(F.sum("n").alias("entity_count"), F.countDistinct("entity_text").alias("unique_entities"), of("PERSON").alias("persons"), of("ORG").alias("orgs"))


def dominant_label(counts: DataFrame) -> DataFrame:
    """Totals without regard to case, with the label that has the largest part."""
    per = counts.groupBy(F.lower("entity_text").alias("entity"), "entity_label").agg(F.sum("n").alias("n"))
    return per.groupBy("entity").agg(F.sum("n").alias("total"), F.max_by("entity_label", F.struct("n", "entity_label")).alias("label"))


def sentiment(texts: DataFrame) -> DataFrame:
    """Adds pos, neg and score, (pos - neg) / (pos + neg) over the whole text, from -1 to 1; 0 without any. A word right after a negator counts for the other side.

    A lambda evaluates all that it names for each word, so it is given the word
    before in an array beside the words; no word is in both lists.
    """
    split = texts.withColumn("__words", F.split(F.lower("text"), r"[^a-z]+"))
    before = F.slice(F.concat(F.array(F.lit("")), "__words"), F.lit(1), F.size("__words"))
    own = lambda b, side: F.when(b.isin(*NEGATORS), F.lit(-side)).otherwise(F.lit(side))
    marked = split.withColumn("__sides", F.zip_with("__words", before, lambda w, b: F.when(w.isin(*POSITIVE), own(b, 1)).when(w.isin(*NEGATIVE), own(b, -1)).otherwise(F.lit(0))))
    count = lambda side: F.size(F.filter("__sides", lambda x: x == side)).cast("long")
    counted = marked.withColumn("pos", count(1)).withColumn("neg", count(-1)).drop("__words", "__sides")
    return counted.withColumn("score", F.when(F.col("pos") + F.col("neg") > 0, (F.col("pos") - F.col("neg")) / (F.col("pos") + F.col("neg"))).otherwise(0.0))


def score_with(texts: DataFrame, scorer: Callable[[list[str]], list[tuple[float, float, float]]], max_chars: int = 2048) -> DataFrame:
    """window_id, text_id, score = positive - negative from a model's (negative, neutral, positive), the mean over a text's chunks of max_chars at most by their lengths. Texts of a batch that fails count as neutral, with failed set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [chunks(x, max_chars) for x in b.column(2).to_pylist()]
            flat = [c for cs in parts for c in cs]
            failed = False
            try:
                p = list(scorer(flat))
            except Exception:  # noqa: BLE001  the model is the caller's
                p, failed = [(0.33, 0.34, 0.33)] * len(flat), True
            each = iter(x[2] - x[0] for x in p)
            scores = [sum(next(each) * max(1, len(c)) for c in cs) / sum(max(1, len(c)) for c in cs) for cs in parts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([failed] * len(scores), pa.bool_())], ["window_id", "text_id", "score", "failed"])

    return texts.select("window_id", "text_id", "text").mapInArrow(run, "window_id string, text_id bigint, score double, failed boolean")


def sentiment_stats(scored: DataFrame) -> DataFrame:
    s = F.col("score")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    out = scored.groupBy("window_id").agg(F.avg(s).alias("mean"), F.median(s).alias("median"), F.stddev_pop(s).alias("std"), share(s > 0.1).alias("prop_positive"), share(s < -0.1).alias("prop_negative"), F.count(F.lit(1)).alias("n_texts"))
    return out.withColumn("prop_neutral", 1.0 - F.col("prop_positive") - F.col("prop_negative"))


def sentiment_shift(now: DataFrame, before: DataFrame) -> DataFrame:
    """Welch's test of window scores against baseline scores; null where a side has under two texts."""
    own = lambda df, k: df.groupBy("window_id").agg(F.count("score").alias(f"n{k}"), F.avg("score").alias(f"m{k}"), F.var_samp("score").alias(f"v{k}"))
    both = own(now, 1).join(own(before, 2), "window_id", "left").withColumn("n2", F.coalesce("n2", F.lit(0)))
    t, df = welch(F.col("n1"), F.col("m1"), F.col("v1"), F.col("n2"), F.col("m2"), F.col("v2"))
    return both.select("window_id", "n1", "n2", F.when((F.col("n1") >= 2) & (F.col("n2") >= 2), F.col("m1") - F.col("m2")).alias("shift"), t.alias("t"), df.alias("df"))


def significance(shift: DataFrame, level: float = 0.05) -> DataFrame:
    out = shift.withColumn("p", t_pvalue(F.col("t"), F.col("df")))
    return out.withColumn("significant", F.coalesce(F.col("p") < level, F.lit(False)))


def shift_summary(shift: DataFrame) -> DataFrame:
    """How many windows there are, their mean shift and how many moved either way."""
    count = lambda c: F.count(F.when(c, 1))
    return shift.agg(F.count(F.lit(1)).alias("n_windows"), F.avg("shift").alias("mean_shift"), count(F.col("shift") > 0).alias("n_more_positive"), count(F.col("shift") < 0).alias("n_more_negative"))


def assign_topics(vectors: DataFrame, ident: str, vector_col: str, k: int = 8, noise: float = 2.0, seed: int = 42) -> DataFrame:
    """ident, topic: the nearest of k centres, or -1 where a vector is further from it than the mean of its topic's distances by ``noise`` standard deviations.

    Rows without a vector, or with null or non-finite components, have no row.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    plain = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fit = ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(vector_col).isNotNull() & F.coalesce(fit, F.lit(False))).select(ident, array_to_vector(plain).alias("features"))
    if rows.isEmpty():
        return vectors.where("false").select(ident, F.lit(-1).alias("topic"))
    model = KMeans(k=k, seed=seed, predictionCol="topic").fit(rows)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])  # k rows
    square = F.aggregate(F.zip_with(vector_to_array("features"), F.get(centres, F.col("topic")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    far = model.transform(rows).select(ident, "topic", F.sqrt(square).alias("away"))
    cut = far.groupBy("topic").agg((F.avg("away") + noise * F.stddev_pop("away")).alias("cut"))
    return far.join(F.broadcast(cut), "topic").select(ident, F.when(F.col("away") > F.col("cut") + 1e-9, -1).otherwise(F.col("topic")).alias("topic"))


def topic_report(texts: DataFrame, topic: str = "topic", n: int = 10) -> DataFrame:
    """topic, n_texts, terms: each topic's best words and pairs of words, without stop words."""
    best = class_terms(texts, topic, n, STOP_WORDS, True).groupBy(topic).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
    sizes = texts.groupBy(topic).agg(F.count(F.lit(1)).alias("n_texts"))
    return sizes.join(best, topic, "left").select(topic, "n_texts", F.array_join(F.transform("t", lambda x: x["term"]), ", ").alias("terms"))


def class_terms(texts: DataFrame, topic: str = "topic", n: int = 10, stop_words: tuple[str, ...] = (), pairs: bool = False) -> DataFrame:
    """c-TF-IDF: a word's share of its topic's words times log(1 + mean words per topic / the word's total); the n best of each topic. With ``pairs``, two words in a row (stop words taken out before) are terms as well. The counts of terms are written once to the shared folder."""
    found = F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda w: (F.length(w) >= 2) & (~w.isin(*stop_words) if stop_words else F.lit(True)))
    # dealt out anew, as the texts that have a topic can be few and lie together
    texts = texts.select(topic, "text").repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if pairs:
        two = F.zip_with(F.col("w"), F.slice("w", 2, F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b))
        both = texts.select(topic, found.alias("w")).select(topic, F.concat("w", F.filter(two, lambda x: x.isNotNull())).alias("w"))
        words = both.select(topic, F.explode_outer("w").alias("term"))
    else:
        words = texts.select(topic, F.explode_outer(found).alias("term"))
    # explode_outer, as for explode Spark filters by the size of the words below any join, where it splits all texts
    tf = stored(words.where("term IS NOT NULL").groupBy(topic, "term").agg(F.count(F.lit(1)).alias("n")))
    per_topic = tf.groupBy(topic).agg(F.sum("n").alias("size"))
    mean = per_topic.agg(F.avg("size").alias("mean"))
    whole = tf.withColumn("total", F.sum("n").over(Window.partitionBy("term")))  # a row for each topic
    s = whole.join(F.broadcast(per_topic), topic).crossJoin(F.broadcast(mean))  # few topics
    s = s.withColumn("weight", F.col("n") / F.col("size") * F.log(1 + F.col("mean") / F.col("total")))
    order = Window.partitionBy(topic).orderBy(F.round("weight", 9).desc(), "term")
    return s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(topic, "rank", "term", "weight")


def dominant_topic(assigned: DataFrame, wins: DataFrame, noise: int = -1) -> DataFrame:
    """The most frequent topic of a window's texts that isn't noise (ties: the smaller), -1 if all are or there is none, and how many there are."""
    counts = assigned.groupBy("window_id", "topic").agg(F.count(F.lit(1)).alias("n"))
    real = counts.where(F.col("topic") != noise)
    best = real.groupBy("window_id").agg(F.max_by("topic", F.struct("n", -F.col("topic"))).alias("dominant_topic"), F.count(F.lit(1)).alias("n_topics_present"))
    out = wins.select("window_id", "channel").join(best, "window_id", "left")
    return out.select("window_id", "channel", F.coalesce("dominant_topic", F.lit(noise)).alias("dominant_topic"), F.coalesce("n_topics_present", F.lit(0)).alias("n_topics_present"))


def topic_distribution(assigned: DataFrame, n: int = 5) -> DataFrame:
    """JSON of the n largest shares of each window's texts, noise included, to 3 places."""
    counts = assigned.groupBy("window_id", "topic").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("window_id")
    ranked = counts.withColumn("share", F.round(F.col("c") / F.sum("c").over(w), 3)).withColumn("r", F.row_number().over(w.orderBy(F.desc("c"), "topic"))).where(F.col("r") <= n)
    return ranked.groupBy("window_id").agg(F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("r", "topic", "share"))), lambda x: F.struct(x["topic"].cast("string"), x["share"])))).alias("topic_distribution"))
