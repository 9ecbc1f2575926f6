"""Catalogue imports: plan, counts, commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidframe.functions.scalars import first_match, gst_slab_valid, hsn_valid, pct_change_flag

#: Product words to category, in order; fixed values.
CATEGORY_RULES = [
    ("laptop", r"(?i)laptop|notebook"), ("monitor", r"(?i)monitor|display"), ("printer", r"(?i)printer|scanner"), ("network", r"(?i)switch|router|access point|firewall"),
    ("power", r"(?i)\bups\b|inverter"), ("audio", r"(?i)headset|speaker|microphone"), ("peripheral", r"(?i)mouse|keyboard|webcam|dock"), ("software", r"(?i)licen[cs]e|software"),
]


def infer_category(given, name):
    """A known category, else the first fitting rule (F19, rule part)."""
    known = [c for c, _ in CATEGORY_RULES]
    return F.coalesce(F.when(F.lower(given).isin(known), F.lower(given)), first_match(name, CATEGORY_RULES))


def match_existing(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Adds ``matched``: the product with the SKU, else the part number, else the name, without case; the last product of a key wins."""
    out = rows
    for key in ("sku", "mpn", "name"):
        last = products.where(F.col(key).isNotNull()).groupBy(F.lower(key).alias(f"_{key}")).agg(F.max_by("sku", "product_no").alias(f"_by_{key}"))
        out = out.join(last, F.lower(F.trim(F.col(key))) == F.col(f"_{key}"), "left").drop(f"_{key}")
    return out.withColumn("matched", F.coalesce("_by_sku", "_by_mpn", "_by_name")).drop("_by_sku", "_by_mpn", "_by_name")


def import_plan(rows: DataFrame, products: DataFrame) -> DataFrame:
    """``action`` (create, update, unchanged, skip), ``changes`` and ``issues`` of each sheet row (PR17).

    Rows: row_no, sku, mpn, name, category, unit_cost, list_price, stock_qty,
    hsn, gst_rate_pct. Names are never overwritten; a missing list price is
    cost plus 15 percent.
    """
    old = products.select(F.col("sku").alias("_sku"), F.col("unit_cost").alias("_cost"), F.col("list_price").alias("_list"), F.col("stock_qty").alias("_stock"))
    plan = match_existing(rows, products).join(old, F.col("matched") == F.col("_sku"), "left")
    plan = plan.withColumn("list_price", F.when(F.col("matched").isNull(), F.coalesce("list_price", F.round(F.col("unit_cost") * 1.15, 2))).otherwise(F.col("list_price")))
    plan = plan.withColumn("category", infer_category(F.col("category"), F.col("name")))
    fields = [("unit_cost", "_cost"), ("list_price", "_list"), ("stock_qty", "_stock")]
    changed = lambda new, was: F.col(new).isNotNull() & (F.abs(F.col(new) - F.coalesce(was, F.lit(0))) >= 0.005)
    changes = F.array_compact(F.array(*(F.when(F.col("matched").isNotNull() & changed(n, o), F.struct(F.lit(n).alias("field"), F.col(o).cast("double").alias("old"), F.col(n).cast("double").alias("new"))) for n, o in fields)))
    same = Window.partitionBy("matched").orderBy("row_no")
    again = F.col("matched").isNotNull() & (F.row_number().over(same) > 1)
    plan = plan.withColumn("changes", changes).withColumn("_again", again)
    issues = F.array_compact(F.array(
        F.when(F.col("name").isNull() & F.col("matched").isNull(), "no name"), F.when(F.col("unit_cost").isNull() & F.col("matched").isNull(), "no cost"), F.when(F.col("_again"), "second row of a product"),
        F.when(F.col("list_price") < F.col("unit_cost"), "price below cost"), F.when(F.col("hsn").isNotNull() & ~hsn_valid(F.col("hsn")), "HSN of odd length"),
        F.when(F.col("gst_rate_pct").isNotNull() & ~gst_slab_valid(F.col("gst_rate_pct")), "no tax slab"),
        F.when(F.col("matched").isNotNull() & pct_change_flag(F.col("_list"), F.col("list_price")), "price change of 25 % or more")))
    blocked = F.col("_again") | (F.col("matched").isNull() & (F.col("name").isNull() | F.col("unit_cost").isNull()))
    action = F.when(blocked, "skip").when(F.col("matched").isNull(), "create").when(F.size("changes") > 0, "update").otherwise("unchanged")
    return plan.withColumn("issues", issues).withColumn("action", action).drop("_sku", "_cost", "_list", "_stock", "_again")


def plan_counts(plan: DataFrame) -> DataFrame:
    """Rows of each action and issues, one row."""
    return plan.agg(*(F.coalesce(F.sum((F.col("action") == a).cast("long")), F.lit(0)).alias(a) for a in ("create", "update", "unchanged", "skip")), F.coalesce(F.sum(F.size("issues")), F.lit(0)).alias("issues"))


def import_commit(plan: DataFrame, products: DataFrame, at) -> tuple[DataFrame, DataFrame]:
    """``(catalogue, versions)``: the new snapshot and a version for each create and update (PR18)."""
    live = plan.where("action IN ('create', 'update')").withColumn("sku", F.coalesce("matched", "sku"))
    new = live.select("sku", *(F.col(c).alias(f"_{c}") for c in ("mpn", "name", "category", "unit_cost", "list_price", "stock_qty")), F.col("action").alias("_action"))
    kept = products.join(new.where("_action = 'update'"), "sku", "left").select(
        "sku", "mpn", "name", F.coalesce("category", "_category").alias("category"), *(F.coalesce(f"_{c}", c).alias(c) for c in ("unit_cost", "list_price", "stock_qty")), "product_no")
    created = new.where("_action = 'create'").select("sku", *(F.col(f"_{c}").alias(c) for c in ("mpn", "name", "category", "unit_cost", "list_price", "stock_qty")), F.lit(None).cast("long").alias("product_no"))
    versions = live.select("sku", "unit_cost", "list_price", "stock_qty", at.alias("effective_from"))
    return kept.unionByName(created), versions
