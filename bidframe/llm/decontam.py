"""Benchmark decontamination by template windows, native DataFrame operations only.

Numbers, units after numbers and names become typed placeholders, so that a
question with other numbers or names has the same template. Windows of
template tokens of the documents are hash-joined with those of the benchmark.
A run of matches on one diagonal (document position less item position) is
one occurrence; it counts if its slots are consistent: each value of the item
stands for one value of the document (two values may become equal). A
capitalised word where a sentence starts is a slot of its own kind, which any
other such word fits. A document leaks an item if consistent occurrences cover
enough of the item's windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidframe.llm._common import written

#: Marks of number, unit and name slots and of capitalised words where a sentence starts, from the private use area.
NUMBER, UNIT, NAME, START = "\ue000", "\ue001", "\ue002", "\ue003"
#: Units that are slots after a number; fixed values.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ounce ounces gram grams kilogram kilograms "
    "ton tons tonne tonnes ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days "
    "week weeks month months year years dollar dollars cent cents euro euros pound pounds usd eur inr rupee rupees percent degree degrees "
    "meter meters metre metres kilometer kilometers kilometre kilometres kmh kph mph kb mb gb tb w kw kwh v volts watt watts"
).split()
#: Most benchmark windows that are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 2_000_000


def template_tokens(text: F.Column) -> F.Column:
    """Lower-case tokens; slot tokens carry their mark before their value."""
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(t, r"(?<=[\p{L}\p{N},;:] )(\p{Lu}\p{Ll}+)", f"{NAME}$1")
    t = F.regexp_replace(t, rf"(?<![\p{{L}}\p{{N}}_{NAME}])(\p{{Lu}}\p{{Ll}}+)", f"{START}$1")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}])(\p{N}+)(?:[.,](\p{N}+))?(?:[.,](\p{N}+))?", f"{NUMBER}$1_$2_$3")
    t = F.regexp_replace(t, rf"({NUMBER}[\p{{N}}_]+[ -]?)({'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))})(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2")
    return F.filter(F.split(F.lower(t), rf"[^\p{{L}}\p{{N}}_{NUMBER}{UNIT}{NAME}{START}]+"), lambda x: x != "")


def _is_slot(token: F.Column) -> F.Column:
    return F.substring(token, 1, 1).isin(NUMBER, UNIT, NAME, START)


def _windows(df: DataFrame, ids: list[str], size: int) -> DataFrame:
    """``ids, tokens, pos, window``: a row for each window of ``size`` template tokens."""
    rows = df.withColumn("template", F.transform("tokens", lambda x: F.when(_is_slot(x), F.substring(x, 1, 1)).otherwise(x)))
    last = F.size("template") - size
    hashes = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get("template", i + k) for k in range(size)))))
    return rows.select(*ids, "tokens", F.posexplode(hashes).alias("pos", "window"))


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, coverage: float = 0.5) -> DataFrame:
    """``doc_id, text_key, item_id, matched, windows, coverage, reparameterised``, a row for each document and item that it leaks.

    An item's windows are its distinct places; ``matched`` counts those that
    consistent occurrences cover, ``reparameterised`` tells if a slot's value
    differs. ``text_key`` is a hash of the text, which tells rows with equal or
    null ids apart; repeated rows give one row. Null and empty texts have no
    windows; items of fewer than ``size`` tokens leak nowhere. Equal items all
    match. Texts of any length are read whole. No documents or no items give no
    rows; other columns of ``docs``, of any name, are ignored.
    """
    side = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), template_tokens(F.col("text")).alias("tokens"))
    items = written(_windows(side, ["item_id"], size).select(
        "item_id", F.col("pos").alias("item_pos"), "window", F.slice("tokens", F.col("pos") + 1, size).alias("item_tokens")).dropDuplicates(["item_id", "item_pos", "window"]), "items")
    counts = items.groupBy("item_id").agg(F.countDistinct("item_pos").alias("windows"))
    few = items.count() <= BROADCAST_ROWS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), template_tokens(F.col("text")).alias("tokens"))
    found = _windows(rows, ["doc_id", "text_key"], size).join(items.hint("broadcast" if few else "shuffle_hash"), "window")
    slots = F.filter(F.arrays_zip(F.col("item_tokens").alias("i"), F.slice("tokens", F.col("pos") + 1, size).alias("d")), lambda x: _is_slot(x["i"]) | _is_slot(x["d"]) | (x["i"] != x["d"]))
    matched = written(found.select("doc_id", "text_key", "item_id", "item_pos", (F.col("pos") - F.col("item_pos")).alias("diagonal"), slots.alias("slots")), "matched")
    pairs = F.array_distinct(F.flatten(F.collect_set("slots")))
    runs = matched.groupBy("doc_id", "text_key", "item_id", "diagonal").agg(F.collect_set("item_pos").alias("places"), pairs.alias("pairs"))

    # A capitalised word at a sentence's start may be a name or not, so it may change but is no witness.
    judged = F.filter("pairs", lambda x: F.substring(x["i"], 1, 1) != START)
    distinct = F.size(F.array_distinct(F.transform(judged, lambda x: x["i"])))
    same_kind = F.forall("pairs", lambda x: F.substring(x["i"], 1, 1) == F.substring(x["d"], 1, 1))
    runs = runs.where(same_kind & (distinct == F.size(judged)))
    by_item = runs.groupBy("doc_id", "text_key", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("matched"),
        F.max(F.exists("pairs", lambda x: x["i"] != x["d"])).alias("reparameterised"))
    return by_item.join(counts.hint("merge"), "item_id").withColumn("coverage", F.col("matched") / F.col("windows")).where(F.col("coverage") >= coverage).select(
        "doc_id", "text_key", "item_id", "matched", "windows", "coverage", "reparameterised")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns, whatever their names.

    Rows with null or empty texts stay, repeated rows stay or go together,
    texts of any length are read whole, and no rows give no rows.
    """
    found = written(leaks(docs, benchmark, **settings).select(F.col("doc_id").alias("leak_id"), F.col("text_key").alias("leak_key")).distinct(), "leaks").hint("merge")
    return docs.join(found, docs.doc_id.eqNullSafe(found.leak_id) & (F.xxhash64(docs.text) == found.leak_key), "left_anti")
