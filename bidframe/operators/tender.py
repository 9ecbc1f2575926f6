"""Tenders: facts, dates, evaluation, eligibility criteria, tables, sections, evidence; and what a proposal reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidframe.functions.scalars import first_match, parse_amount, parse_inr
from bidframe.functions.text import fold, tokens

# ---- proposal and report aggregates


def category_scope(lines: DataFrame, soft: tuple[str, ...] = ("software", "services", "cabling")) -> DataFrame:
    """Quantity of each category of a bid; hardware by volume first."""
    w = Window.partitionBy("bid_id").orderBy(F.col("category").isin(*soft).cast("int"), F.desc("quantity"), "category")
    return lines.groupBy("bid_id", "category").agg(F.sum("quantity").alias("quantity")).withColumn("position", F.row_number().over(w))


def delivery_extremes(lines: DataFrame, domestic: Column, installed: Column) -> DataFrame:
    """Longest lead time, least hardware warranty and completion day of each bid."""
    out = lines.groupBy("bid_id").agg(
        F.max("lead_time_days").alias("lead_time_days"), F.min(F.when(~F.col("category").isin("software", "services"), F.col("warranty_months"))).alias("warranty_months"),
        F.max(domestic.cast("int")).alias("_home"), F.max(installed.cast("int")).alias("_install"))
    days = F.col("lead_time_days") + F.when(F.col("_home") == 1, 2).otherwise(6) + F.when(F.col("_install") == 1, 5).otherwise(0)
    return out.withColumn("completion_days", days).drop("_home", "_install")


def market_digest(priced: DataFrame) -> DataFrame:
    """Lines, rivals below cost and lines of each strategy of a bid."""
    counts = priced.groupBy("bid_id", "strategy").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("best_price") < F.col("unit_cost")).cast("long")).alias("below"))
    return counts.groupBy("bid_id").agg(F.sum("n").alias("lines"), F.sum("below").alias("rivals_below_cost"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("strategy", "n")))).alias("strategies"))


def bundle_inclusions(priced: DataFrame) -> DataFrame:
    """Services included in a bid with their lines, quantity and value."""
    return priced.where("bundle IS NOT NULL").groupBy("bid_id", "bundle").agg(
        F.sort_array(F.collect_list("line_no")).alias("lines"), F.sum("quantity").alias("quantity"), F.sum(F.col("bundle_cost") * F.col("quantity")).alias("value"))


def tiers_by_category(tiers: DataFrame) -> DataFrame:
    """Ordered steps of each category."""
    return tiers.groupBy("category").agg(F.sort_array(F.collect_list(F.struct("min_qty", "discount_pct"))).alias("steps"))


def requirement_counts(reqs: DataFrame) -> DataFrame:
    """Clauses of each section: all and mandatory ones."""
    return reqs.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("strength") == "mandatory").cast("long")).alias("mandatory"))


def weighted_union(synthetic: DataFrame, real: DataFrame, weight: float) -> DataFrame:
    """Both sets with ``weight`` for real rows instead of repeating them."""
    return synthetic.withColumn("weight", F.lit(1.0)).unionByName(real.withColumn("weight", F.lit(weight)), allowMissingColumns=True)


def apply_review_edits(bids: DataFrame, edits: DataFrame, lines: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Field corrections; a new country clears city and, unless given, region; a reviewer's lines replace their earlier ones."""
    fields = [c for c in edits.columns if c != "bid_id"]
    joined = bids.join(edits.select("bid_id", *(F.col(c).alias(f"_{c}") for c in fields)), "bid_id", "left")
    moved = F.col("_country").isNotNull() & ~F.col("_country").eqNullSafe(F.col("country")) if "country" in fields else F.lit(False)
    out = []
    for c in bids.columns:
        new = F.col(f"_{c}") if c in fields else F.lit(None)
        kept = F.when(moved, None).otherwise(F.col(c)) if c in ("city", "region") else F.col(c)
        out.append(F.coalesce(new, kept).alias(c) if c != "bid_id" else F.col(c))
    rest = lines.join(added.select("bid_id").distinct().withColumn("origin", F.lit("reviewer")), ["bid_id", "origin"], "left_anti").select(lines.columns)
    return joined.select(*out), rest.unionByName(added)


#: Currency words, longest first; fixed values.
CURRENCY_WORDS = [("USD", r"us dollars?|\busd\b|us\$"), ("AUD", r"australian dollars?|\baud\b"), ("CAD", r"canadian dollars?|\bcad\b"), ("SGD", r"singapore dollars?|\bsgd\b"), ("AED", r"dirhams?|\baed\b"), ("GBP", r"pounds? sterling|\bgbp\b|£"),
                  ("EUR", r"euros?\b|\beur\b|€"), ("JPY", r"\byen\b|\bjpy\b"), ("INR", r"rupees?|\binr\b|₹|\brs\.?\b")]
DOLLARS = {"US": "USD", "AU": "AUD", "CA": "CAD", "SG": "SGD"}


def extract_currency(sentences: DataFrame) -> DataFrame:
    """Currency named in the first sentence about prices; a bare dollar sign by country (TX8). Rows: doc_id, pos, sentence, country."""
    low = F.lower("sentence")
    table = F.create_map(*(F.lit(x) for kv in DOLLARS.items() for x in kv))
    found = F.coalesce(first_match(low, CURRENCY_WORDS), F.when(low.contains("$"), F.try_element_at(table, F.col("country"))))
    rows = sentences.where(low.rlike(r"pric|quot|amount|cost|payment|currency|budget|value")).withColumn("currency", found).where("currency IS NOT NULL")
    return rows.groupBy("doc_id").agg(F.min_by("currency", "pos").alias("currency"))


def extract_table_items(lines: DataFrame) -> DataFrame:
    """``doc_id, pos, description, quantity`` of tables led by a header with description and quantity (TX14). Rows: doc_id, pos, line.

    Cells are cut by bars, tabs or three blanks; a table ends at the first row
    whose quantity is no number.
    """
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\||\t| {3,}"), lambda c: F.trim(c))
    rows = lines.withColumn("cells", cells).where(F.size("cells") >= 2)
    role = lambda p: F.filter(F.transform("cells", lambda c, i: F.when(F.lower(c).rlike(p), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_d", F.get(role(r"description|item|particular|product"), F.lit(0))).withColumn("_q", F.get(role(r"qty|quantity|nos"), F.lit(0)))
    is_head = F.col("_d").isNotNull() & F.col("_q").isNotNull() & (F.col("_d") != F.col("_q"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_head", is_head).withColumn("_at", F.last(F.when(is_head, F.struct("pos", "_d", "_q")), ignorenulls=True).over(w)).where("_at IS NOT NULL AND NOT _head")
    rows = rows.withColumn("quantity", F.regexp_extract(F.get("cells", F.col("_at._q")), r"^([\d,]+)", 1)).withColumn("quantity", F.regexp_replace("quantity", ",", "").try_cast("int"))
    table = Window.partitionBy("doc_id", "_at.pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    broken = F.max(F.col("quantity").isNull().cast("int")).over(table)
    return rows.withColumn("_broken", broken).where("_broken = 0").select("doc_id", "pos", F.get("cells", F.col("_at._d")).alias("description"), "quantity")


def resolve_location(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Country of each document: one named on the address line wins, else the vote of all mentions (TX10). Mentions: doc_id, country, pos, on_address."""
    counts = mentions.groupBy("doc_id", "country").agg(F.max(F.col("on_address").cast("int")).alias("a"), F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    best = counts.groupBy("doc_id").agg(F.max_by("country", F.struct("a", "n", -F.col("first"))).alias("country"))
    return docs.select("doc_id").join(best, "doc_id", "left")


def type_sections(sections: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Kind and confidence of each section by weighted words (TX19).

    ``sections``: doc_id, section, title, body; ``lexicon``: kind, word,
    weight. A title hit counts its weight, body hits a quarter of it each, at
    most four, and need 1.5 in sum. Words meet sections by an equi join.
    """
    hits = lambda column, part: sections.select("doc_id", "section", F.explode(tokens(F.col(column), True, True)).alias("word"), F.lit(part).alias("part"))
    joined = hits("title", "title").unionByName(hits("body", "body")).groupBy("doc_id", "section", "word", "part").agg(F.count(F.lit(1)).alias("n")).join(lexicon, "word")
    scores = joined.groupBy("doc_id", "section", "kind").agg(
        F.max(F.when(F.col("part") == "title", F.col("weight"))).alias("t"), F.sum(F.when(F.col("part") == "body", 0.25 * F.col("weight") * F.least(F.col("n"), F.lit(4)))).alias("b"))
    scores = scores.withColumn("score", F.coalesce("t", F.when(F.col("b") >= 1.5, F.col("b")))).where("score IS NOT NULL")
    w = Window.partitionBy("doc_id", "section").orderBy(F.desc("score"), "kind")
    ranked = scores.withColumn("_n", F.row_number().over(w)).withColumn("_second", F.lead("score").over(w)).where("_n = 1")
    best = ranked.select("doc_id", "section", "kind", (F.col("score") / (F.col("score") + F.coalesce("_second", F.lit(0.0)) + 0.5)).alias("confidence"))
    return sections.join(best.hint("merge"), ["doc_id", "section"], "left")


def link_specs(lines: DataFrame, sections: DataFrame, least: float = 0.6) -> DataFrame:
    """The specification section of each line: a section number it names, else the best overlap of words.

    ``lines``: doc_id, line_no, description, category; ``sections``: doc_id,
    number, title, category. The overlap is the share of the title's words,
    plus 0.35 for the same category and 0.3 where a document has one section.
    """
    named = lines.withColumn("number", F.nullif(F.regexp_extract(F.lower("description"), r"spec(?:ification)?s?\.?\s*(?:no\.?\s*)?(\d+(?:\.\d+)*)", 1), F.lit("")))
    exact = named.hint("merge").join(sections.select("doc_id", "number"), ["doc_id", "number"]).select("doc_id", "line_no", "number", F.lit(2.0).alias("score"))
    alone = Window.partitionBy("doc_id")
    held = sections.withColumn("_have", F.array_distinct(tokens(F.col("title"), True, True))).withColumn("_sole", F.count(F.lit(1)).over(alone) == 1)
    want = lines.withColumn("_want", F.array_distinct(tokens(F.col("description"), True, True)))
    pairs = want.hint("merge").join(held.select("doc_id", "number", "_have", "_sole", F.col("category").alias("_cat")), "doc_id")
    score = F.size(F.array_intersect("_want", "_have")) / F.size("_have") + F.when(F.col("category") == F.col("_cat"), 0.35).otherwise(0.0) + F.when(F.col("_sole"), 0.3).otherwise(0.0)
    fuzzy = pairs.withColumn("score", score).where(F.col("score") >= least).select("doc_id", "line_no", "number", "score")
    best = exact.unionByName(fuzzy).groupBy("doc_id", "line_no").agg(F.max(F.struct("score", "number")).alias("m"))
    return best.select("doc_id", "line_no", F.col("m.number").alias("number"))


def scope_text(blocks: DataFrame, priority: dict[str, int]) -> DataFrame:
    """Text of each document by section kinds in fixed priority; kinds that are not listed are left out (TX27)."""
    rank = F.create_map(*(F.lit(x) for kv in priority.items() for x in kv))
    rows = blocks.withColumn("_p", F.try_element_at(rank, F.col("kind"))).where("_p IS NOT NULL")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_p", "pos", "text"))), lambda x: x["text"])
    return rows.groupBy("doc_id").agg(F.array_join(ordered, "\n").alias("text"))


# ---- evidence

#: Words too common in the field to be evidence; fixed values.
GENERIC = (
    "bidder supplier purchaser shall must provide supply supplied within days day order purchase contract tender bid "
    "equipment item items goods all each per required requirement including include successful work works period")


def evidence(sections: DataFrame, sentences: DataFrame, least: float = 0.1, pool: int = 60) -> DataFrame:
    """Best sentences of the best sections: 0.55 section + 0.45 sentence score.

    ``sections``: query_id, section_id, score; ``sentences``: query_id,
    sentence_id, section_id, score.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "sentence_id")
    best = sentences.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= pool).drop("_n")
    kept = sections.where(F.col("score") >= least).select("query_id", "section_id", F.col("score").alias("_s"))
    return best.join(kept, ["query_id", "section_id"]).withColumn("score", 0.55 * F.col("_s") + 0.45 * F.col("score")).drop("_s")


def relevant_evidence(hits: DataFrame) -> DataFrame:
    """Hits with enough score and enough shared stems that are not generic (R11). Rows: score, query, passage and, where known, section."""
    stems = lambda c: F.array_distinct(tokens(c, True, True))
    said = F.concat_ws(" ", *(F.col(c) for c in ("passage", "section") if c in hits.columns))
    rows = hits.withColumn("_q", F.array_except(stems(F.col("query")), stems(F.lit(GENERIC)))).withColumn("_s", F.size(F.array_intersect("_q", stems(said))))
    return rows.where((F.col("score") >= 0.4) & (F.col("_s") >= 2) & (F.col("_s") / F.greatest(F.lit(1), F.least(F.size("_q"), F.lit(8))) >= 0.35)).drop("_q", "_s")


def retrieval_log(hits: DataFrame) -> DataFrame:
    """Passages of each purpose and query, best first."""
    ordered = F.transform(F.reverse(F.sort_array(F.collect_list(F.struct("score", "passage")))), lambda x: x["passage"])
    return hits.groupBy("purpose", "query").agg(ordered.alias("passages"))


def match_catalogue(hits: DataFrame, k: int = 4) -> DataFrame:
    """Catalogue score of each hit and the ``k`` best of an item.

    Rows: query_id, doc_id, score, fit, p_category, p_top, brand_asked, brand.
    """
    asked = F.col("brand_asked")
    brand = F.when(asked.isNull(), 0.0).when(fold(asked) == fold(F.col("brand")), 0.08).otherwise(-0.10)
    base = F.when(F.col("fit").isNull(), F.col("score")).otherwise(0.6 * F.col("score") + 0.4 * F.col("fit")) + brand
    weight = 0.55 + 0.45 * F.least(F.lit(1.0), F.col("p_category") / F.col("p_top"))
    w = Window.partitionBy("query_id").orderBy(F.desc("match"), "doc_id")
    return hits.withColumn("match", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * weight)), 9)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def amounts(units: DataFrame) -> DataFrame:
    """Amounts of label: value units as numbers (F1 over units)."""
    return units.withColumn("amount", parse_amount(F.regexp_extract("text", r":\s*(.+)$", 1)))
