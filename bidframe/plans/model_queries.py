"""Registered queries of fitted models and of aggregate states, each with SQL that needs no fit of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bidframe.operators import ledger, pricing, states
from bidframe.operators.policy import LEAD_CLIP, SEGMENTS, WARRANTY_CLIP
from bidframe.plans.bindings import bound, cte, table
from bidframe.plans.queries import _PRED, fit_rows, query
from bidframe.sources.scratch import folder
from bidframe.sources.tabular import append_batch

_GAP = "(price_ratio - 1.0)"
_FEATURE_SQL = {"intercept": "1.0", "gap": _GAP} | {f"gap_{s}": f"{_GAP} * CAST(segment = '{s}' AS INT)" for s in SEGMENTS}
_FEATURE_SQL |= {
    "warranty_years": f"greatest(-{WARRANTY_CLIP}, least({WARRANTY_CLIP}, warranty_delta_months)) / 12.0", "lead_weeks": f"greatest(-{LEAD_CLIP}, least({LEAD_CLIP}, lead_time_delta_days)) / 7.0",
    "bundled": "CAST(bundled_value_add AS INT)", "repeat": "CAST(repeat_customer AS INT)"}
_FEATURE_SQL |= {f"is_{s}": f"CAST(segment = '{s}' AS INT)" for s in SEGMENTS[1:]}
_MOMENTS = " UNION ALL ".join(f"SELECT '{f}' AS feature, round(sum(CASE WHEN won THEN w * {x} ELSE 0.0 END), 1) AS fitted FROM d" for f, x in _FEATURE_SQL.items())


@query("win_model_moments", f"WITH {cte('deals')}, d AS (SELECT *, CASE WHEN source = 'outcome' THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM deals) SELECT feature, CAST(fitted AS DOUBLE) AS fitted FROM ({_MOMENTS})")
def q_win_moments(spark, d):
    """The fitted model's sums against the won deals' own: they agree only where the likelihood has its maximum."""
    deals = fit_rows(spark, d)
    # the fit ends within some 1e-9 of the optimum: a sum that lies half-way must not be decided by its last digits
    return ledger.win_model_moments(deals, ledger.fit_win_model(deals)).withColumn("fitted", F.round(F.round("fitted", 3), 1))


@query("calibration_states", f"""WITH {cte('deals')}, s AS ({_PRED}), b AS (SELECT segment, count(*) AS n, avg(p) AS m, avg(y) AS a FROM s WHERE p > 0 GROUP BY segment, ceil(round(p * 10, 9)))
SELECT segment, CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(m - a)) / sum(n), 6) AS ece, round(max(abs(m - a)), 6) AS max_gap FROM b GROUP BY 1""")
def q_calibration_states(spark, d):
    """One table of states a year of closing, the last one written twice; the report reads the states."""
    path = f"{folder(spark)}/states-{uuid.uuid4().hex}"
    deals = bound(spark, d, "deals")
    p = pricing.win_probability(F.col("price_ratio"), F.col("warranty_delta_months"), F.col("lead_time_delta_days"), F.col("bundled_value_add"), F.col("repeat_customer"), F.col("segment"))
    dated = deals.select("segment", F.year("closed_on").alias("year"), F.col("won").cast("int").alias("y"), p.alias("p"))
    low, high = dated.agg(F.min("year"), F.max("year")).first()
    for year in [*range(low, high + 1), high]:
        append_batch(states.calibration_states(dated.where(F.col("year") == year), ["segment"]), path, year)
    report = states.finish_calibration(spark.read.parquet(path), ["segment"])
    return report.withColumns({"ece": F.round("ece", 6), "max_gap": F.round("max_gap", 6)})


@query("text_classifier_moments", """SELECT CAST(quality AS DOUBLE) AS label, CAST(count(*) AS BIGINT) AS expected FROM documents JOIN labels USING (doc_id)
WHERE ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 100 >= 25 GROUP BY 1""")
def q_classifier_moments(spark, d):
    """Sums of the probabilities over the rows that fitted the classifier are the labels' counts."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = ledger.split_by_group(docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id"), "doc_id")
    known = rows.where("NOT held_out")
    moments = ledger.label_moments(ledger.predict_distribution(ledger.fit_text_classifier(known), known))
    return moments.withColumn("expected", F.round("expected").cast("long"))
