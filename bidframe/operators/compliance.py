"""Compliance: clause matrix, eligibility checks, risks, verdicts, item alignment."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidframe.functions.scalars import jaccard
from bidframe.functions.text import fold, tokens
from bidframe.sources.scratch import stored

#: Verdicts of a check from worst to best; fixed values.
VERDICTS = ("Does not meet", "Needs review", "Documents required", "Meets")
SEVERITY = {"high": 0, "medium": 1, "low": 2}


def matrix_requirements(reqs: DataFrame, long_document: Column) -> DataFrame:
    """Bidder-side clauses that the matrix answers (P10). Rows: actor, strength, category, type.

    Informational clauses of the type ``scope`` go in every document; in long
    ones informational clauses of categories other than warranty, standards
    and delivery go too. A null type is no scope, a null strength or length is
    none.
    """
    told = F.coalesce(F.col("strength") == "information", F.lit(False))
    kept = F.coalesce(F.col("category").isin("warranty", "standards", "delivery"), F.lit(False)) | ~F.coalesce(long_document, F.lit(False))
    return reqs.where((F.col("actor") == "bidder") & (~told | (kept & ~F.coalesce(F.col("type") == "scope", F.lit(False)))))


def compliance_counts(items: DataFrame) -> DataFrame:
    """Items by status, and mandatory ones in all and met, of each bid."""
    statuses = ["Complies", "Complies with note", "Deviation", "Noted", "Needs review"]
    mandatory = F.col("mandatory") & (F.col("status") != "Noted")
    return items.groupBy("bid_id").agg(
        *(F.sum((F.col("status") == s).cast("long")).alias(s.lower().replace(" ", "_")) for s in statuses),
        F.sum(mandatory.cast("long")).alias("mandatory_total"), F.sum((mandatory & F.col("status").startswith("Complies")).cast("long")).alias("mandatory_met"))


def eligibility_verdict(bids: DataFrame, checks: DataFrame) -> DataFrame:
    """The worst check decides; without checks a bid is not assessed."""
    rank = F.create_map(*(F.lit(x) for i, v in enumerate(VERDICTS) for x in (v, i)))
    worst = checks.groupBy("bid_id").agg(F.min(F.element_at(rank, F.col("verdict"))).alias("_w"))
    names = F.array(*map(F.lit, VERDICTS))
    return bids.join(worst, "bid_id", "left").withColumn("eligibility", F.coalesce(F.get(names, F.col("_w")), F.lit("Not assessed"))).drop("_w")


def bid_recommendation(bids: DataFrame, items: DataFrame, risks: DataFrame) -> DataFrame:
    """Do not bid, bid with clarifications, or bid; with reasons (A15). ``bids`` have ``eligibility``."""
    a = items.groupBy("bid_id").agg(F.bool_or(F.col("mandatory") & (F.col("status") == "Deviation")).alias("_dev"), F.bool_or(F.col("status") == "Needs review").alias("_rev"))
    b = risks.groupBy("bid_id").agg(F.bool_or(F.col("severity") == "high").alias("_high"))
    rows = bids.join(a, "bid_id", "left").join(b, "bid_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    failed = F.col("eligibility") == "Does not meet"
    review = F.col("eligibility") == "Needs review"
    reasons = F.array_compact(F.array(F.when(failed, "eligibility not met"), F.when(yes("_dev"), "mandatory deviation"), F.when(yes("_high"), "high risk"), F.when(yes("_rev") | review, "review open")))
    return rows.withColumn("recommendation", F.when(failed, "Do not bid").when(F.size(reasons) > 0, "Bid with clarifications").otherwise("Bid")).withColumn("reasons", reasons).drop("_dev", "_rev", "_high")


def recent_credentials(cred: DataFrame, as_of: Column, years: float, sectors: list[str]) -> DataFrame:
    """Completed within ``years`` and in a wanted sector; no sectors mean all."""
    out = cred.where(F.datediff(as_of, "completed_on") <= years * 365.25)
    return out.where(F.col("sector").isin(sectors)) if sectors else out


def turnover_check(turnover: DataFrame, criteria: DataFrame) -> DataFrame:
    """Least (each year) or mean turnover of the latest ``years`` against the requirement."""
    w = Window.partitionBy("bid_id").orderBy(F.desc("fiscal_year"))
    latest = criteria.join(turnover, "bid_id").withColumn("_n", F.row_number().over(w)).where("_n <= years")
    out = latest.groupBy("bid_id", "required", "each_year").agg(F.min("amount").alias("_min"), F.avg("amount").alias("_avg"))
    value = F.when(F.col("each_year"), F.col("_min")).otherwise(F.col("_avg"))
    return out.select("bid_id", value.alias("value"), "required", F.when(value >= F.col("required"), "Meets").otherwise("Does not meet").alias("verdict"))


def similar_works_check(cred: DataFrame, options: DataFrame) -> DataFrame:
    """An option asks for ``n`` works of at least ``threshold``; the first satisfied one wins.

    Each work meets the few options of its own bid, and the pairs are counted
    with map-side combine.
    """
    counts = options.hint("merge").join(cred, "bid_id", "left").groupBy("bid_id", "option_no", "n", "threshold").agg(F.sum(F.coalesce((F.col("value") >= F.col("threshold")).cast("long"), F.lit(0))).alias("works"))
    return counts.groupBy("bid_id").agg(F.min(F.when(F.col("works") >= F.col("n"), F.col("option_no"))).alias("option_no")).withColumn(
        "verdict", F.when(F.col("option_no").isNotNull(), "Meets").otherwise("Does not meet"))


def supplied_quantity_check(cred: DataFrame, criteria: DataFrame) -> DataFrame:
    """Devices of a category supplied in all credentials against the requirement (A18). ``devices``: map of category to quantity."""
    rows = criteria.join(cred, "bid_id", "left").groupBy("bid_id", "category", "required").agg(F.sum(F.coalesce(F.try_element_at("devices", F.col("category")), F.lit(0))).alias("supplied"))
    return rows.withColumn("verdict", F.when(F.col("supplied") >= F.col("required"), "Meets").otherwise("Does not meet"))


def threshold_check(profile: DataFrame, value: str, required: str) -> DataFrame:
    """Net worth, age or staff against a requirement; unknown values need review."""
    return profile.withColumn("verdict", F.when(F.col(value).isNull(), "Needs review").when(F.col(value) >= F.col(required), "Meets").otherwise("Does not meet"))


def age_years(since: Column, as_of: Column) -> Column:
    return F.datediff(as_of, since) / 365.25


def unauthorised_brands(lines: DataFrame, authorised: DataFrame) -> DataFrame:
    """Offered brands, services aside, that are not authorised, folded."""
    known = authorised.select(fold(F.col("brand")).alias("_b")).distinct()
    offered = lines.where("category <> 'services'").withColumn("_b", fold(F.col("brand")))
    return offered.join(known, "_b", "left_anti").groupBy("bid_id").agg(F.sort_array(F.collect_set("brand")).alias("brands"))


def standards_held(required: DataFrame, held: DataFrame, as_of: Column) -> DataFrame:
    """Required standards of each bid split into held and missing."""
    valid = held.where(F.col("valid_until").isNull() | (F.col("valid_until") >= as_of)).select(F.lower("standard").alias("_s")).distinct()
    rows = required.join(valid, F.lower("standard") == F.col("_s"), "left")
    return rows.groupBy("bid_id").agg(F.sort_array(F.collect_list(F.when(F.col("_s").isNotNull(), F.col("standard")))).alias("held"), F.sort_array(F.collect_list(F.when(F.col("_s").isNull(), F.col("standard")))).alias("missing"))


def local_presence(criteria: DataFrame, offices: DataFrame) -> DataFrame:
    """Offices whose state or city is a required place (J21): two equi semi joins."""
    places = criteria.select(fold(F.col("place")).alias("_p")).distinct()
    a = offices.join(places, fold(F.col("state")) == F.col("_p"), "left_semi")
    return a.unionByName(offices.join(places, fold(F.col("city")) == F.col("_p"), "left_semi")).distinct()


def spec_fit(asked: Column, offered: Column, fields: dict[str, str]) -> Column:
    """Mean score of the attributes asked for (TX16); null if none is.

    ``fields`` name a rule each: ``least`` (enough is 1, unknown 0.5),
    ``equal`` (1 or 0.2, unknown 0.5), ``near`` (screen: within 0.5 is 1,
    within 1.5 is 0.6, unknown is left out), ``power`` (oversize is worth less,
    0.5 at least, unknown is 0).
    """
    scores = []
    for name, rule in fields.items():
        w, g = asked[name], offered[name]
        if rule == "least":
            score = F.when(g >= w, 1.0).otherwise(0.0)
        elif rule == "equal":
            score = F.when(g == w, 1.0).otherwise(0.2)
        elif rule == "near":
            score = F.when(F.abs(g - w) <= 0.5, 1.0).when(F.abs(g - w) <= 1.5, 0.6).otherwise(0.0)
        else:
            score = F.when(g < w, 0.0).otherwise(F.greatest(F.lit(0.5), 1 - (g - w) / w))
        scores.append(F.when(w.isNull(), None).when(g.isNull(), {"near": None, "power": 0.0}.get(rule, 0.5)).otherwise(score))
    known = F.array_compact(F.array(*scores))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


#: Words that carry no requirement in a specification row; fixed values.
_FILLER = ["minimum", "maximum", "least", "most", "up", "above", "below", "better", "higher", "required", "type", "model", "make", "least"]


def attribute_check(requirement: Column, catalogue: Column, limits: dict[str, Column]) -> Column:
    """True, false, or null where the catalogue is silent (TX17).

    A measured limit (number with a unit in ``limits``) is compared in its
    direction; otherwise each alternative's words must occur in the catalogue
    text. No shared word at all means silence.
    """
    low = F.lower(requirement)
    most = low.rlike(r"\b(max|maximum|up to|not more than|at most)\b")
    measured = F.lit(None).cast("boolean")
    for unit, value in limits.items():
        asked = F.regexp_extract(low, rf"(\d+(?:\.\d+)?)\s*{unit}\b", 1).try_cast("double")
        measured = F.when(asked.isNotNull() & value.isNotNull(), F.when(most, value <= asked).otherwise(value >= asked)).otherwise(measured)
    held = tokens(catalogue, True, True)
    parts = F.filter(F.split(low, r",|;|\band\b|\bwith\b"), lambda p: F.trim(p) != "")
    words = lambda p: F.array_except(tokens(p, True, True), F.array(*map(F.lit, _FILLER)))
    met = F.forall(parts, lambda p: F.exists(F.split(p, r"\bor\b|/"), lambda q: (F.size(words(q)) > 0) & (F.size(F.array_except(words(q), held)) == 0)))
    shared = F.size(F.array_intersect(words(requirement), held))
    return F.coalesce(measured, F.when(met, True).when(shared == 0, None))


def compliant_alternative(rows: DataFrame, products: DataFrame, fit: Column, least: float = 0.99) -> DataFrame:
    """The first product, by SKU, of the row's category with a fit of at least ``least`` (PR20).

    ``fit`` sees what is asked and what is held, so rows that ask the same and
    products that hold the same are compared once.
    """
    asked = [c for c in rows.columns if c != "row_id"]
    wanted = rows.select(*asked).distinct()
    held = products.groupBy(*(c for c in products.columns if c != "sku")).agg(F.min("sku").alias("sku"))
    pairs = wanted.hint("merge").join(held, "category").withColumn("fit", fit).where(F.col("fit") >= least)
    best = pairs.groupBy(*asked).agg(F.min("sku").alias("alternative")).select(*(F.col(c).alias(f"_{c}") for c in asked), "alternative")
    return rows.join(best, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in asked))).select("row_id", "alternative").groupBy("row_id").agg(F.min("alternative").alias("alternative"))


def risk_flags(bids: DataFrame) -> DataFrame:
    """``bid_id, severity, title`` of each risk, worst first, one a title (PR21, O9)."""
    rules = [
        ("high", "Liability without limit", F.col("unlimited_liability")), ("high", "Liquidated damages above 10 %", F.col("ld_cap_pct") > 10), ("medium", "Payment after more than 45 days", F.col("payment_days") > 45),
        ("medium", "Reverse auction", F.col("reverse_auction")), ("medium", "Deadline within seven days", F.col("days_left") <= 7), ("low", "Quantities may vary", F.col("quantity_variation_pct") > 0)]
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(SEVERITY[s]).alias("rank"), F.lit(s).alias("severity"), F.lit(t).alias("title"))) for s, t, c in rules)))
    return bids.select("bid_id", F.explode(F.array_sort(found)).alias("r")).select("bid_id", "r.severity", "r.title")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key: checklists by folded name (U4), risks by title."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def document_checklist(checks: DataFrame, lines: DataFrame) -> DataFrame:
    """The document of each failed or open criterion, and one authorisation form a brand (PR23, U4)."""
    a = checks.where("document IS NOT NULL").select("bid_id", F.col("document").alias("name"), F.lit(0).alias("part"))
    b = lines.select("bid_id", F.concat(F.lit("Manufacturer authorisation: "), F.col("brand")).alias("name"), F.lit(1).alias("part")).distinct()
    return first_by(a.unionByName(b).withColumn("_f", fold(F.col("name"))), ["bid_id", "_f"], F.col("part"), F.col("name")).drop("_f", "part")


def incremental(stage_output: DataFrame, changed: DataFrame, recomputed: DataFrame) -> DataFrame:
    """A stage's table with the changed bids' rows replaced (PR24)."""
    return stage_output.join(changed.select("bid_id").distinct(), "bid_id", "left_anti").unionByName(recomputed)


def _greedy(pairs: DataFrame) -> DataFrame:
    """Rows of ``doc_id, left_no, right_no, score`` chosen one-to-one: by left line, each takes its best right line that is free.

    One pass over a document's sorted pairs; many documents share a batch.
    """
    def choose(batches):
        doc, lefts, rights = None, set(), set()
        for batch in batches:
            kept = []
            for i, (d, left, right) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "left_no", "right_no")))):
                if d != doc:
                    doc, lefts, rights = d, set(), set()
                if left not in lefts and right not in rights:
                    lefts.add(left)
                    rights.add(right)
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    return pairs.repartition("doc_id").sortWithinPartitions("doc_id", "left_no", F.desc("score"), "right_no").mapInArrow(choose, pairs.schema)


def align_items(gold: DataFrame, parsed: DataFrame, least: float = 0.25) -> DataFrame:
    """One-to-one pairs of equal quantity and description Jaccard above ``least``, greedy in gold order.

    Rows: doc_id, line_no, description, quantity. A group is one document's pairs.
    """
    a = gold.select("doc_id", F.col("line_no").alias("left_no"), "quantity", tokens(F.col("description")).alias("t"))
    b = parsed.select("doc_id", F.col("line_no").alias("right_no"), "quantity", tokens(F.col("description")).alias("u"))
    pairs = a.join(b.hint("merge"), ["doc_id", "quantity"]).withColumn("score", jaccard(F.array_distinct("t"), F.array_distinct("u"))).where(F.col("score") > least)
    return _greedy(pairs.select("doc_id", "left_no", "right_no", "score"))


def reconcile_items(a: DataFrame, b: DataFrame, least: float = 0.3, bonus: float = 0.2) -> DataFrame:
    """Two readings as agreed, quantity change, only in the first, only in the second."""
    left = a.select("doc_id", F.col("line_no").alias("left_no"), F.col("quantity").alias("q"), tokens(F.col("description")).alias("t"))
    right = b.select("doc_id", F.col("line_no").alias("right_no"), F.col("quantity").alias("r"), tokens(F.col("description")).alias("u"))
    score = jaccard(F.array_distinct("t"), F.array_distinct("u")) + F.when(F.col("q") == F.col("r"), bonus).otherwise(0.0)
    pairs = left.join(right.hint("merge"), "doc_id").withColumn("score", score).where((F.col("score") >= least) & (F.size(F.array_intersect("t", "u")) > 0))
    chosen = stored(_greedy(pairs.select("doc_id", "left_no", "right_no", "score", F.coalesce(F.col("q") == F.col("r"), F.lit(False)).alias("same"))).drop("score"), "chosen").hint("merge")
    outcome = F.when(F.col("right_no").isNull(), "only first").when(F.col("same"), "agreed").otherwise("quantity change")
    first = left.select("doc_id", "left_no").join(chosen, ["doc_id", "left_no"], "left").select("doc_id", "left_no", "right_no", outcome.alias("outcome"))
    only_b = right.select("doc_id", "right_no").join(chosen, ["doc_id", "right_no"], "left_anti").select("doc_id", F.lit(None).cast("int").alias("left_no"), "right_no", F.lit("only second").alias("outcome"))
    return first.unionByName(only_b)


def route_clauses(units: DataFrame) -> DataFrame:
    """Where a sentence goes: an item, else its best other label, else scope (TX25). Rows: has_quantity, p_item, label, confidence, category_confidence."""
    item = F.col("has_quantity") & ((F.col("p_item") >= 0.4) | ((F.col("p_item") >= 0.2) & (F.col("category_confidence") >= 0.7)))
    return units.withColumn("route", F.when(item, "line_item").when(F.col("confidence") < 0.45, "scope").otherwise(F.col("label")))
