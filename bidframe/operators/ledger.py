"""Bid ledger: outcomes, labels, calibration, models."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidframe.operators.joins import dealt
from bidframe.operators.policy import SEGMENTS

FEATURES = ["gap", *(f"gap_{s}" for s in SEGMENTS), "warranty_years", "lead_weeks", "bundled", "repeat", *(f"is_{s}" for s in SEGMENTS[1:])]


def merge_outcomes(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The latest outcome replaces the bid's row; cancelled bids have none (J23). The ledger is counted, so it should be a written table."""
    total = ledger.count()
    ledger, outcomes = dealt(ledger, "rfp_id", total), dealt(outcomes, "rfp_id", total)
    w = Window.partitionBy("rfp_id").orderBy(F.desc("recorded_at"))
    latest = outcomes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    kept = ledger.join(latest.select("rfp_id").hint("merge"), "rfp_id", "left_anti")
    new = latest.where("result <> 'cancelled'").withColumn("won", F.col("result") == "won").withColumn("source", F.lit("outcome"))
    return kept.unionByName(new.select(*ledger.columns))


def merge_labels(labels: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by model and text; empty labels and those equal to the prediction are skipped."""
    clean = new.withColumn("text", F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 2000)).where("label <> '' AND text <> '' AND NOT label <=> predicted")
    w = Window.partitionBy("model", "text").orderBy(F.desc("recorded_at"))
    latest = clean.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*labels.columns)
    return labels.join(latest.select("model", "text"), ["model", "text"], "left_anti").select(*labels.columns).unionByName(latest)


def ledger_stats(deals: DataFrame, keys: list[str]) -> DataFrame:
    return deals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("won").cast("double")).alias("win_rate"))


def learning_status(labels: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Labels of each model and outcomes of each result."""
    a = labels.groupBy(F.lit("labels").alias("kind"), F.col("model").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(outcomes.groupBy(F.lit("outcomes").alias("kind"), F.col("result").alias("name")).agg(F.count(F.lit(1)).alias("n")))


def stale_models(labels: DataFrame, seen: DataFrame, least: int = 5) -> DataFrame:
    """Models with enough new labels, or with labels removed."""
    counts = labels.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    both = counts.join(seen, "model", "full_outer").select("model", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("seen", F.lit(0)).alias("seen"))
    return both.withColumn("stale", (F.col("n") - F.col("seen") >= least) | (F.col("n") < F.col("seen")))


def bid_history(deals: DataFrame, category: str, n: int = 25) -> DataFrame:
    """Newest real outcomes of a category."""
    return deals.where((F.col("source") == "outcome") & (F.col("category") == category)).orderBy(F.desc("closed_on"), "deal_id").limit(n)


def calibration(pred: DataFrame, bins: int = 10) -> DataFrame:
    """Count, mean probability and rate in each bin (lo, hi] (A27); probability 0 is in none."""
    return pred.where("p > 0").groupBy(F.ceil(F.round(F.col("p") * bins, 9)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("predicted"), F.avg("y").alias("actual"))


def calibration_error(pred: DataFrame, bins: int = 10) -> DataFrame:
    table = calibration(pred, bins)
    return table.agg((F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("actual"))) / F.sum("n")).alias("ece"))


def classification_metrics(pred: DataFrame) -> DataFrame:
    """Accuracy, Brier score, log loss, base rate and rank AUC of (p, y), one row.

    Equal probabilities are aggregated first, so the rank sum orders distinct
    probabilities in four decimals, at most 10001 rows.
    """
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("p")))
    sums = pred.groupBy(F.round("p", 4).alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), F.sum(((F.round("p", 9) >= 0.5).cast("int") == F.col("y")).cast("long")).alias("right"),
        F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.sum(-(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))).alias("loss"))
    below = F.coalesce(F.sum(F.col("n") - F.col("pos")).over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sums.withColumn("wins", F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2))
    n, pos = F.sum("n"), F.sum("pos")
    return ranked.agg(
        (F.sum("right") / n).alias("accuracy"), (F.sum("brier") / n).alias("brier"), (F.sum("loss") / n).alias("log_loss"), (pos / n).alias("base_rate"),
        (F.sum("wins") / F.nullif(pos * (n - pos), F.lit(0))).alias("auc"))


def split_by_group(df: DataFrame, key: str, held_out_pct: int = 25) -> DataFrame:
    """Adds ``held_out``, the same for all rows of a group (M7)."""
    return df.withColumn("held_out", F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 100 < held_out_pct)


def fit_win_model(deals: DataFrame, real_weight: float = 10.0, least: int = 50):
    """Standardised logistic regression over the bid features; real outcomes weigh more (M2). None below ``least`` deals."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(deals.withColumn("w", F.when(F.col("source") == "outcome", real_weight).otherwise(1.0)).withColumn("label", F.col("won").cast("double")))
    n, total = rows.agg(F.count(F.lit(1)), F.sum("w")).first()
    if n < least:
        return None
    return LogisticRegression(featuresCol="x", weightCol="w", standardization=True, regParam=1 / total, elasticNetParam=0.0, maxIter=200, tol=1e-10).fit(rows)


def win_model_moments(deals: DataFrame, model, real_weight: float = 10.0) -> DataFrame:
    """``feature, fitted``: what the model says of each feature's weighted sum over won deals.

    At the optimum of the penalised likelihood the sum over all deals of
    weight, feature and probability, plus the coefficient's penalty, equals
    the sum of weight and feature over the won ones; the intercept has no
    penalty. One pass over the deals, one row in the driver.
    """
    weight = F.when(F.col("source") == "outcome", real_weight).otherwise(1.0)
    z = sum((F.col(f) * float(c) for f, c in zip(FEATURES, model.coefficients)), F.lit(float(model.intercept)))
    rows = deals.withColumn("_w", weight).withColumn("_p", 1 / (1 + F.exp(-z)))
    sums = [F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_w")).alias("w2"), F.sum(F.col("_w") * F.col("_p")).alias("intercept")]
    for f in FEATURES:
        sums += [F.sum(F.col("_w") * F.col(f) * F.col("_p")).alias(f"p_{f}"), F.sum(F.col("_w") * F.col(f)).alias(f"x_{f}"), F.sum(F.col("_w") * F.col(f) * F.col(f)).alias(f"xx_{f}")]
    one = rows.agg(*sums)
    spread = lambda f: (F.col(f"xx_{f}") - F.col(f"x_{f}") * F.col(f"x_{f}") / F.col("w")) / (F.col("w") - F.col("w2") / F.col("w"))
    found = [F.struct(F.lit("intercept").alias("feature"), F.col("intercept").alias("fitted"))]
    found += [F.struct(F.lit(f).alias("feature"), (F.col(f"p_{f}") + float(c) * spread(f)).alias("fitted")) for f, c in zip(FEATURES, model.coefficients)]
    return one.select(F.inline(F.array(*found)))


def describe_win_model(spark, model) -> DataFrame:
    """Coefficients in original units with their odds ratios (M4)."""
    rows = [("intercept", float(model.intercept))] + [(f, float(c)) for f, c in zip(FEATURES, model.coefficients)]
    return spark.createDataFrame(rows, "feature string, coefficient double").withColumn("odds_ratio", F.exp("coefficient"))


def fit_text_classifier(df: DataFrame, text: str = "text", label: str = "label", vocabulary: int = 20_000, least_docs: float = 2.0):
    """Word and word-pair TF-IDF into a multinomial logistic regression (M5); ``weight`` is used where present.

    The many coefficients end after 40 iterations, before their optimum. A
    second regression takes the margins as they are, each with coefficient 1
    in its own class, and brings the intercepts, which carry no penalty, to
    their optimum.
    """
    rows = df.withColumn("w", F.col("weight") if "weight" in df.columns else F.lit(1.0))
    total, last = rows.agg(F.sum("w"), F.max(label)).first()
    margins = DenseMatrix(int(last) + 1, int(last) + 1, np.eye(int(last) + 1).ravel())
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+"), NGram(n=2, inputCol="_words", outputCol="_pairs"),
        CountVectorizer(inputCol="_words", outputCol="_wc", vocabSize=vocabulary, minDF=least_docs), IDF(inputCol="_wc", outputCol="_wf"),
        CountVectorizer(inputCol="_pairs", outputCol="_pc", vocabSize=vocabulary, minDF=least_docs), IDF(inputCol="_pc", outputCol="_pf"),
        VectorAssembler(inputCols=["_wf", "_pf"], outputCol="x"),
        LogisticRegression(featuresCol="x", labelCol=label, weightCol="w", family="multinomial", regParam=1 / (8 * total), standardization=False, maxIter=40,
                           rawPredictionCol="_margins", probabilityCol="_first", predictionCol="_guess"),
        LogisticRegression(featuresCol="_margins", labelCol=label, weightCol="w", family="multinomial", regParam=0.0, standardization=False, maxIter=200, tol=1e-12,
                           lowerBoundsOnCoefficients=margins, upperBoundsOnCoefficients=margins)]).fit(rows)


def predict_distribution(model, df: DataFrame) -> DataFrame:
    """Label, confidence and probabilities (M6)."""
    rows = model.transform(df.withColumn("w", F.lit(1.0)) if "w" not in df.columns else df).withColumn("distribution", vector_to_array("probability"))
    return rows.withColumn("confidence", F.array_max("distribution"))


def label_moments(predicted: DataFrame) -> DataFrame:
    """``label, expected``: the sum of each label's probability over rows of ``predict_distribution``.

    Over the rows that fitted the model it equals the label's count, as the
    intercepts carry no penalty.
    """
    return predicted.select(F.posexplode("distribution").alias("label", "p")).groupBy(F.col("label").cast("double").alias("label")).agg(F.sum("p").alias("expected"))


def leave_one_group_out(df: DataFrame, key: str, fit, score, max_groups: int = 12) -> DataFrame:
    """Predictions for each of the largest groups by a model fitted on all others (M8); the bound on groups is the feature."""
    groups = [r[0] for r in df.groupBy(key).count().orderBy(F.desc("count"), key).limit(max_groups).collect()]
    out = None
    for g in groups:
        rows = score(fit(df.where(F.col(key) != g)), df.where(F.col(key) == g))
        out = rows if out is None else out.unionByName(rows)
    return out


def outcome_deltas(lines: DataFrame) -> DataFrame:
    """Median warranty and lead-time difference, any bundle, clamped price ratio of each bid."""
    return lines.groupBy("bid_id").agg(
        F.median(F.col("warranty_months") - F.col("best_warranty")).cast("int").alias("warranty_delta"), F.median(F.col("lead_time_days") - F.col("best_lead")).cast("int").alias("lead_delta"),
        F.bool_or(F.col("bundle").isNotNull()).alias("bundled"), F.greatest(F.lit(0.6), F.least(F.lit(1.6), F.sum(F.col("price") * F.col("quantity")) / F.sum(F.col("best_price") * F.col("quantity")))).alias("price_ratio"))
