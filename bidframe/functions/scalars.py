"""Numbers, money, dates, names."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Currencies without two decimals; fixed values.
CURRENCY_DECIMALS = {"JPY": 0, "IDR": 0, "KWD": 3, "BHD": 3, "OMR": 3}
#: Valid goods-tax slabs in percent; fixed values.
GST_SLABS = (0.0, 0.25, 3.0, 5.0, 12.0, 18.0, 28.0, 40.0)
#: Number words; fixed values.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
SCALES = {"dozen": 12, "score": 20, "hundred": 100, "thousand": 1_000, "lakh": 100_000, "million": 1_000_000, "crore": 10_000_000}
#: Date layouts tried in order; fixed values.
DATE_LAYOUTS = ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "yyyy/MM/dd")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def parse_amount(s: Column) -> Column:
    """Money text to a number: currency signs and separators go, lakh and crore multiply; blanks give null."""
    t = F.lower(F.trim(s))
    number = F.regexp_extract(F.regexp_replace(t, ",", ""), r"(-?\d+(?:\.\d+)?)", 1)
    scale = F.when(t.rlike(r"\bcrores?\b|\bcr\b"), 1e7).when(t.rlike(r"\blakhs?\b|\blacs?\b"), 1e5).otherwise(1.0)
    return F.when(t.isin("", "-", "na", "n/a", "nil"), None).when(number != "", number.cast("double") * scale)


def let(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made(value)`` with the value worked out once, however often ``made`` names it."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def parse_inr(s: Column) -> Column:
    """The first rupee amount, or the first number with crore, lakh or million."""
    pattern = r"(?:rs\.?|inr|₹)\s*(\d+(?:\.\d+)?)\s*(crore|cr|lakh|lac|million)?|(\d+(?:\.\d+)?)\s*(crore|cr|lakh|lac|million)"

    def amount(m: Column) -> Column:
        scale = F.when(m["unit"].startswith("cr"), 1e7).when(m["unit"].startswith("l"), 1e5).when(m["unit"] == "million", 1e6).otherwise(1.0)
        return F.when(m["number"] != "", m["number"]).cast("double") * scale

    part = lambda t, i: F.regexp_extract(t, pattern, i)
    # of both alternatives one matches, the other's groups are empty
    parts = lambda t: F.struct(F.concat(part(t, 1), part(t, 3)).alias("number"), F.concat(part(t, 2), part(t, 4)).alias("unit"))
    return let(F.lower(F.regexp_replace(s, ",", "")), lambda t: let(parts(t), amount))


def parse_months(s: Column) -> Column:
    """Warranty text to months: years times twelve, none is 0, lifetime is 120."""
    t = F.lower(F.trim(s))
    number = F.regexp_extract(t, r"(\d+(?:\.\d+)?)", 1)
    months = F.round(number.cast("double") * F.when(t.rlike(r"year|yr"), 12).otherwise(1)).cast("int")
    return F.when(t.rlike(r"no warranty|^nil$"), 0).when(t.contains("lifetime"), 120).when(number != "", months)


def parse_int(s: Column) -> Column:
    number = F.regexp_extract(F.regexp_replace(s, ",", ""), r"(-?\d+(?:\.\d+)?)", 1)
    return F.when(number != "", F.round(number.cast("double")).cast("long"))


def parse_number_words(s: Column) -> Column:
    """English number words to a number; digits with k or a scale word too; null without any number."""
    t = F.lower(F.trim(s))
    digits = F.regexp_replace(t, ",", "")
    value = F.create_map(*(F.lit(x) for kv in NUMBER_WORDS.items() for x in (kv[0], float(kv[1]))))
    scale = F.create_map(*(F.lit(x) for kv in SCALES.items() for x in (kv[0], float(kv[1]))))
    words = F.filter(F.split(F.regexp_replace(digits, r"[-\s]+", " "), " "), lambda w: (w != "") & (w != "and"))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("current"), F.lit(False).alias("seen"))

    def step(acc: Column, w: Column) -> Column:
        plain = F.coalesce(F.try_element_at(value, w), w.try_cast("double"), F.regexp_extract(w, r"^(\d+(?:\.\d+)?)k$", 1).try_cast("double") * 1000)
        big = F.try_element_at(scale, w)
        current = F.when(plain.isNotNull(), acc["current"] + plain).when(
            big.isNotNull() & (big <= 100), F.when(acc["current"] == 0, 1.0).otherwise(acc["current"]) * big).when(big.isNotNull(), 0.0).otherwise(acc["current"])
        total = F.when(big > 100, acc["total"] + F.when(acc["current"] == 0, 1.0).otherwise(acc["current"]) * big).otherwise(acc["total"])
        return F.struct(total.alias("total"), current.alias("current"), (acc["seen"] | plain.isNotNull() | big.isNotNull()).alias("seen"))

    return F.aggregate(words, start, step, lambda acc: F.when(acc["seen"], acc["total"] + acc["current"]))


def duration_days(n: Column, unit: Column) -> Column:
    u = F.lower(unit)
    return (n * F.when(u.startswith("week"), 7).when(u.startswith("month"), 30).when(u.startswith("year"), 365).otherwise(1)).cast("int")


def parse_date_multi(s: Column) -> Column:
    """The first layout that fits the whole text, then its first ten characters."""
    t = F.trim(s)
    return F.coalesce(*(F.to_date(F.try_to_timestamp(x, F.lit(f))) for x in (t, F.substring(t, 1, 10)) for f in DATE_LAYOUTS))


def norm_header(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), r"[^a-z0-9%]+", " "))


def slug(s: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), 1, 48)


def round_money(x: Column, currency: Column) -> Column:
    """Round half up to the decimals of the currency, past the noise of binary products."""
    x = F.round(x, 9)
    three = F.lit(False)
    for code in [c for c, d in CURRENCY_DECIMALS.items() if d == 3]:
        three = three | (currency == code)
    none = currency.isin([c for c, d in CURRENCY_DECIMALS.items() if d == 0])
    return F.when(none, F.round(x, 0)).when(three, F.round(x, 3)).otherwise(F.round(x, 2))


def price_sensitivity(weight: Column, default_weight: float = 50.0) -> Column:
    return clamp(weight / F.lit(default_weight), 0.6, 2.0)


def volume_discount(quantity: Column) -> Column:
    return F.when(quantity >= 200, 6.0).when(quantity >= 100, 4.5).when(quantity >= 50, 3.0).when(quantity >= 20, 1.5).otherwise(0.0)


def hsn_valid(code: Column) -> Column:
    return F.length(F.regexp_replace(code, r"\D", "")).isin(4, 6, 8)


def gst_slab_valid(rate: Column) -> Column:
    return rate.isin(*GST_SLABS)


def pct_change_flag(old: Column, new: Column, limit: float = 25.0) -> Column:
    """True where the change is at least ``limit`` percent; changes below half a cent are none."""
    return F.when(F.abs(new - old) < 0.005, F.lit(False)).otherwise(F.abs(new / F.nullif(old, F.lit(0.0)) - 1) * 100 >= limit)


def age_reliability(source_weight: Column, competitor: Column, age: Column, max_age: float = 180.0) -> Column:
    # nine decimals first, so that binary noise cannot decide a half-way case
    return F.round(F.round(F.greatest(F.lit(0.0), F.least(competitor, F.lit(1.0)) * source_weight * (1 - 0.35 * age / F.lit(max_age))), 9), 3)


def saturate(x: Column, k: float = 6.0) -> Column:
    return x / (x + F.lit(k))


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / either)


def content_fingerprint(texts: Column) -> Column:
    """SHA-1 over sorted texts, joined by the unit separator."""
    return F.sha1(F.concat_ws("\x1f", F.sort_array(texts)))


def first_match(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first rule whose expression occurs."""
    rest = F.lit(default)
    return reduce(lambda acc, rule: F.when(text.rlike(rule[1]), rule[0]).otherwise(acc), reversed(rules), rest)
