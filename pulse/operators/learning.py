"""Models over feature frames: splits by hash, folds, fits, metrics."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.stats import running_totals
from pulse.functions.storage import stored


def hash_split(rows: DataFrame, ident: str, train: float = 0.7, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(ident)), F.lit(10_000))
    return rows.where(draw < int(train * 10_000)), rows.where(draw >= int(train * 10_000))


def time_split(rows: DataFrame, at: str, q: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Rows up to the quantile of time train."""
    cut = rows.agg(F.percentile(at, q)).first()[0]
    return rows.where(F.col(at) <= cut), rows.where(F.col(at) > cut)


def time_or_stratified_split(rows: DataFrame, at: str, label: str, ident: str, q: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """time_split; where a side lacks a class, a fifth of each class by hash is the test side."""
    train, test = time_split(rows, at, q)
    classes = rows.select(label).distinct().count()
    if min(train.select(label).distinct().count(), test.select(label).distinct().count()) == classes:
        return train, test
    marked = stored(folds(rows, label, ident, 5))
    return marked.where("fold <> 0").drop("fold"), marked.where("fold = 0").drop("fold")


def extremes(rows: DataFrame, value: str, ident: str, n: int) -> DataFrame:
    """The n rows of largest and the n of smallest value, with side; a row can be in both."""
    high, low = rows.orderBy(F.desc(value), ident).limit(n), rows.orderBy(value, ident).limit(n)
    return high.withColumn("side", F.lit("high")).unionByName(low.withColumn("side", F.lit("low")))


def folds(rows: DataFrame, label: str, ident: str, k: int) -> DataFrame:
    """Stratified folds 0..k-1 in the order of a hash."""
    order = Window.partitionBy(label).orderBy(F.xxhash64(F.lit(42), F.col(ident)), ident)
    return rows.withColumn("fold", F.pmod(F.row_number().over(order) - 1, F.lit(k)))


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """Adds weight = n / (classes x the class's rows)."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    total = counts.agg(F.sum("__c").alias("__n"), F.count(F.lit(1)).alias("__k"))
    return rows.join(counts, label).crossJoin(F.broadcast(total)).withColumn("weight", F.col("__n") / (F.col("__k") * F.col("__c"))).drop("__c", "__n", "__k")


def forest(features: list[str], label: str, trees: int, depth: int, scale: bool = False, weight: str | None = None) -> Pipeline:
    stages = [VectorAssembler(inputCols=features, outputCol="__raw", handleInvalid="skip")]
    if scale:
        stages.append(StandardScaler(inputCol="__raw", outputCol="__features", withMean=True, withStd=True))
    rf = RandomForestClassifier(featuresCol="__features" if scale else "__raw", labelCol=label, numTrees=trees, maxDepth=depth, seed=42, probabilityCol="__p", rawPredictionCol="__r")
    if weight:
        rf = rf.setWeightCol(weight)
    return Pipeline(stages=[*stages, rf])


def predicted(train: DataFrame, rows: DataFrame, features: list[str], trees: int, depth: int, scale: bool = False, balanced: bool = False) -> DataFrame:
    """rows with prediction and probability (of class 1) by a forest; where train has one class only, that class."""
    classes = [r[0] for r in train.select("label").distinct().limit(2).collect()]
    if len(classes) < 2:
        only = F.lit(float(classes[0]) if classes else None).cast("double")
        return rows.withColumn("prediction", only).withColumn("probability", (only == 1).cast("double"))
    model = forest(features, "label", trees, depth, scale, "weight" if balanced else None).fit(balanced_weights(train, "label") if balanced else train)
    out = model.transform(rows).withColumn("probability", F.get(vector_to_array("__p"), F.lit(1)))
    return out.select(*rows.columns, "prediction", "probability")


def indexed(rows: DataFrame, label: str) -> tuple[DataFrame, list[str]]:
    model = StringIndexer(inputCol=label, outputCol="label", handleInvalid="skip", stringOrderType="alphabetAsc").fit(rows)
    return model.transform(rows), list(model.labels)


def cross_validate(rows: DataFrame, features: list[str], ident: str, k: int, trees: int = 20, depth: int = 8, fold_col: str | None = None, scale: bool = False, balanced: bool = False) -> DataFrame:
    """ident, fold, label, prediction, probability of class 1, each row predicted by the model that hasn't seen its fold. ``fold_col`` keeps given groups together; ``balanced`` weighs classes alike."""
    marked = stored((rows.withColumn("fold", F.col(fold_col)) if fold_col else folds(rows, "label", ident, k)).select(ident, "label", "fold", *features))
    parts = None
    for f in [r[0] for r in marked.select("fold").distinct().orderBy("fold").collect()]:  # k folds
        train, test = marked.where(F.col("fold") != f), marked.where(F.col("fold") == f)
        got = predicted(train, test, features, trees, depth, scale, balanced).select(ident, "fold", "label", "prediction", "probability")
        parts = got if parts is None else parts.unionByName(got)
    return parts


def confusion(predicted: DataFrame, actual: str = "label", guess: str = "prediction") -> DataFrame:
    return predicted.groupBy(actual, guess).agg(F.count(F.lit(1)).alias("n"))


def multiclass_metrics(predicted: DataFrame, actual: str = "label", guess: str = "prediction") -> DataFrame:
    """accuracy, and precision, recall and F1 weighted by the classes' rows."""
    c = confusion(predicted, actual, guess)
    hit = F.when(F.col(actual) == F.col(guess), F.col("n")).otherwise(0)
    rows = c.groupBy(F.col(actual).alias("c")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    cols = c.groupBy(F.col(guess).alias("c")).agg(F.sum("n").alias("guessed"))
    m = rows.join(cols, "c", "left").withColumn("p", F.when(F.col("guessed") > 0, F.col("tp") / F.col("guessed")).otherwise(0.0)).withColumn("r", F.col("tp") / F.col("support"))
    m = m.withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    w = lambda x: F.sum(F.col(x) * F.col("support")) / F.sum("support")
    return m.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), w("p").alias("precision"), w("r").alias("recall"), w("f").alias("f1"))


def roc_points(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """threshold, tpr, fpr for each distinct score, highest first."""
    by = scored.groupBy(score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    whole = by.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))  # one row
    runs = running_totals(by, score, ["p", "n"], descending=True).crossJoin(F.broadcast(whole))
    return runs.select(F.col(score).alias("threshold"), (F.col("run_p") / F.col("all_p")).alias("tpr"), (F.col("run_n") / F.col("all_n")).alias("fpr"))


def binary_metrics(predicted: DataFrame, score: str = "probability", label: str = "label", guess: str = "prediction") -> DataFrame:
    """One row: n, positives, auc (ties count half), average_precision, precision, recall, f1 of class 1.

    The areas are null unless both classes are there; precision, recall and F1 are 0 where they have no rows to divide by.
    """
    by = predicted.groupBy(score).agg(F.sum(label).cast("double").alias("p"), F.sum(1 - F.col(label)).cast("double").alias("n"))
    runs = running_totals(by, score, ["p", "n"], descending=True)
    pairs = F.sum(F.col("n") * (F.col("run_p") - F.col("p") / 2))
    areas = runs.agg(F.sum("p").alias("P"), F.sum("n").alias("N"), pairs.alias("pairs"), F.sum(F.col("p") * F.col("run_p") / (F.col("run_p") + F.col("run_n"))).alias("ap"))
    hit, said = (F.col(label) == 1) & (F.col(guess) == 1), F.col(guess) == 1
    count = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    plain = predicted.agg(count(hit).alias("tp"), count(said).alias("said"))
    out = areas.crossJoin(F.broadcast(plain))  # one row each
    both = (F.col("P") > 0) & (F.col("N") > 0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = ratio(F.col("tp"), F.col("said")), ratio(F.col("tp"), F.col("P"))
    return out.select(
        (F.col("P") + F.col("N")).cast("long").alias("n"), F.col("P").cast("long").alias("positives"), F.when(both, F.col("pairs") / (F.col("P") * F.col("N"))).alias("auc"), F.when(both, F.col("ap") / F.col("P")).alias("average_precision"),
        precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"),
    )


def fold_metrics(predicted: DataFrame) -> DataFrame:
    """binary_metrics of each of the few folds."""
    parts = None
    for f in [r[0] for r in predicted.select("fold").distinct().orderBy("fold").collect()]:
        one = binary_metrics(predicted.where(F.col("fold") == f)).withColumn("fold", F.lit(f).cast("long"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def predict_unlabelled(rows: DataFrame, features: list[str], ident: str, category: str = "category", trees: int = 300, depth: int = 10, least: int = 10) -> DataFrame:
    """ident, predicted_category, is_labeled of all rows: those with a category out of fold, the others by a model of all that have one. With fewer than least of these: no rows."""
    known = rows.where(F.col(category).isNotNull())
    labelled, names = indexed(known, category)
    labelled = stored(labelled)
    back = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("prediction") + 1).cast("int")) if names else F.lit(None).cast("string")
    if labelled.count() < least:
        return rows.where("false").select(ident, F.lit("").alias("predicted_category"), F.lit(True).alias("is_labeled"))
    own = cross_validate(labelled, features, ident, 5, trees, depth, balanced=True)
    model = forest(features, "label", trees, depth, weight="weight").fit(balanced_weights(labelled, "label"))
    rest = model.transform(rows.where(F.col(category).isNull()))
    return own.select(ident, back.alias("predicted_category"), F.lit(True).alias("is_labeled")).unionByName(rest.select(ident, back.alias("predicted_category"), F.lit(False).alias("is_labeled")))


def auc(predicted: DataFrame, score: str = "probability", label: str = "label") -> float:
    return BinaryClassificationEvaluator(rawPredictionCol=score, labelCol=label).evaluate(predicted)


def importance(model, features: list[str]) -> list[tuple[str, float]]:
    """Largest first."""
    return sorted(zip(features, map(float, model.stages[-1].featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))
