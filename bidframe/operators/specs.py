"""Specification rows of a tender against the catalogue: what is asked, what is offered, what fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidframe.functions.text import fold
from bidframe.operators.compliance import attribute_check
from bidframe.operators.matrix import typed_specs

# How a text names an attribute, over its folded form; the first group that is not empty counts.
MEMORY = (r"(\d{1,3})\s*gb\s*(?:of\s*)?(?:ddr\d\s*)?(?:ram|memory)", r"(?:ram|memory)\s*[:\-]?\s*(?:min(?:imum)?\.?\s*)?(\d{1,3})\s*gb")
STORAGE = r"(\d+(?:\.\d+)?)\s*(gb|tb)\s*(?:nvme\s*|m\.2\s*|sata\s*)?(ssd|hdd|storage|disk|nvme|drive)"
SCREEN = r"(\d{2}(?:\.\d)?)\s*(?:\"|''|-?\s*inch(?:es)?|in\b)"
PORTS, POWERED, CAPACITY = r"(\d{1,2})[\s-]*port", r"\bpoe\+?|power over ethernet", r"(\d+(?:\.\d+)?)\s*(kva|va)\b"
PROCESSOR, XEON = r"\b(?:core\s*)?(i[3579])\b|core\s*ultra\s*([579])", r"\bxeon\b"
FOUR_K, FULL_HD = r"\b(4k|uhd|3840\s*x\s*2160)\b", r"\b(fhd|full hd|1080p|1920\s*x\s*1080)\b"
WIRELESS, ONLINE, BAYS = r"wi-?fi\s*(6e|6|7)", r"\b(online|double[- ]conversion)\b", r"(\d{1,2})\s*(?:-?\s*)?bays?"
THROUGHPUT = r"(?:throughput|firewall)[^.;\n]{0,40}?(\d+(?:\.\d+)?)\s*gbps|(\d+(?:\.\d+)?)\s*gbps[^.;\n]{0,20}throughput"
UPLINK = r"(\d+)\s*g(?:b|be)?\s*sfp\+?|(\d+)\s*g\s*uplink|sfp\+"
SENSOR, PRINT_SPEED = r"(\d{3,5})\s*dpi", r"(\d{2,3})\s*ppm"
RACK_UNITS, TOWER = r"\b([124])\s?u\b(?!\w)", r"form factor[^.;\n]{0,10}\btower\b|\btower\b(?! server)"
GRAPHICS, VIDEO_MEMORY = r"graphics card|\bgpu\b|\brtx\b|\bgddr\d", r"(\d{1,2})\s*gb\s*(?:of\s*)?(?:gddr\d\w*|vram|video memory)?"
#: Scores of an unknown value, of a screen or port count that is close, and of a class that differs; fixed values.
UNKNOWN, CLOSE, OTHER = 0.5, 0.6, 0.2


def asked_specs(text: Column, category: Column | None = None) -> Column:
    """Nineteen typed attributes that a text asks for (TX15), each null where it is silent.

    A graphics card's memory is video memory, and its form factor is that of
    the host machine and goes, as for lines of the ``category`` component.
    """
    t = fold(F.coalesce(text, F.lit("")))
    got = lambda p, g=1: F.nullif(F.regexp_extract(t, p, g), F.lit(""))
    either = lambda p: F.coalesce(got(p), got(p, 2))
    amount = lambda p, unit, large: (got(p).cast("double") * F.when(got(p, 2) == large, 1000).otherwise(1)).cast(unit)
    graphics, kind = t.rlike(GRAPHICS), got(STORAGE, 3)
    memory = F.coalesce(*(got(p) for p in MEMORY)).cast("int")
    host = graphics if category is None else graphics | F.coalesce(category == "component", F.lit(False))
    form = F.when(got(RACK_UNITS).isNotNull(), F.concat(got(RACK_UNITS), F.lit("U"))).when(t.rlike(TOWER), "tower")
    return F.struct(
        F.when(~graphics, memory).alias("ram_gb"), F.when(graphics, F.coalesce(memory, got(VIDEO_MEMORY).cast("int"))).alias("vram_gb"), amount(STORAGE, "long", "tb").alias("storage_gb"),
        F.when(kind.isin("ssd", "nvme"), "SSD").when(kind == "hdd", "HDD").alias("storage_type"), got(SCREEN).cast("double").alias("screen_in"), got(PORTS).cast("int").alias("ports"),
        F.when(t.rlike(POWERED), True).alias("poe"), amount(CAPACITY, "long", "kva").alias("capacity_va"), F.right(either(PROCESSOR), F.lit(1)).cast("int").alias("cpu_tier"), F.when(t.rlike(XEON), "xeon").alias("cpu_family"),
        F.when(t.rlike(FOUR_K), "4K").when(t.rlike(FULL_HD), "FHD").alias("resolution"), F.concat(F.lit("Wi-Fi "), F.upper(got(WIRELESS))).alias("wifi"), F.when(t.rlike(ONLINE), "online").alias("topology"),
        got(BAYS).cast("int").alias("bays"), either(THROUGHPUT).cast("double").alias("throughput_gbps"), F.when(t.rlike(UPLINK), F.coalesce(either(UPLINK).cast("int"), F.lit(10))).alias("uplink_gbps"),
        got(SENSOR).cast("int").alias("dpi"), got(PRINT_SPEED).cast("int").alias("ppm"), F.when(~host, form).alias("form_factor"))


def spec_findings(asked: Column, offered: Column) -> Column:
    """Attribute, finding and score of each attribute that ``asked_specs`` names, against ``typed_specs`` (TX16).

    A finding is meets, below, near, more, fewer, far, differs or unknown. A
    screen or port count that the product does not state is left out; an
    unknown capacity is below.
    """
    def finding(name, *cases):
        out = F.when(asked[name].isNull(), None)
        for condition, word, score in cases:
            out = out.when(condition, F.struct(F.lit(name).alias("attribute"), F.lit(word).alias("finding"), (score if isinstance(score, Column) else F.lit(score)).cast("double").alias("score")))
        return out

    def least(name):
        w, g = asked[name], offered[name]
        return finding(name, (g.isNull(), "unknown", UNKNOWN), (g >= w, "meets", 1.0), (g < w, "below", 0.0))

    def same(name):
        w, g = asked[name], offered[name]
        if name == "poe":
            g = g.try_cast("boolean")
        return finding(name, (offered[name].isNull(), "unknown", UNKNOWN), (g.eqNullSafe(w), "meets", 1.0), (F.lit(True), "differs", OTHER))

    power, held = asked["capacity_va"], offered["capacity_va"]
    off, ports, given = F.abs(asked["screen_in"] - offered["screen_in"]), asked["ports"], offered["ports"]
    return F.array_compact(F.array(
        *map(least, ("ram_gb", "storage_gb", "bays", "vram_gb", "dpi", "cpu_tier", "throughput_gbps", "uplink_gbps", "ppm")),
        finding("capacity_va", (held.isNull() | (held < power), "below", 0.0), (held >= power, "meets", F.greatest(F.lit(0.5), 1 - (held - power) / power))),
        finding("screen_in", (off <= 0.5, "meets", 1.0), (off <= 1.5, "near", CLOSE), (off > 1.5, "far", 0.0)),
        finding("ports", (given == ports, "meets", 1.0), (given > ports, "more", CLOSE), (given < ports, "fewer", 0.0)),
        *map(same, ("poe", "resolution", "wifi", "topology", "cpu_family", "form_factor"))))


def findings_fit(findings: Column) -> Column:
    """Mean score of the findings; null if nothing is asked."""
    return F.when(F.size(findings) > 0, F.aggregate(findings, F.lit(0.0), lambda a, x: a + x["score"]) / F.size(findings))


def findings_failed(findings: Column) -> Column:
    """A finding is below or differs."""
    return F.exists(findings, lambda x: x["finding"].isin("below", "differs"))


def spec_rows(reqs: DataFrame, lines: DataFrame, products: DataFrame) -> DataFrame:
    """``reqs`` with ``fit, failed, findings, met, product_os`` of each specification row against its line's product.

    ``reqs``: bid_id, line_no, text (``parameter: value``); ``lines``: bid_id,
    line_no, sku, category; ``products``: sku, specs (map), described (the
    catalogue's text). ``met`` is the wording's check (TX17), where the typed
    attributes are silent. ``product_os`` is '' where the product records none.
    Rows without a line, and lines without a product, have nulls and are kept.
    One equi join for the line, one for the product.
    """
    own = lines.select("bid_id", "line_no", F.col("sku").alias("_sku"), F.col("category").alias("_category"))
    # what is asked is read before, what is offered beside the product join: once a row and once a product
    wanted = reqs.join(own, ["bid_id", "line_no"], "left").withColumn("_asked", asked_specs(F.regexp_replace("text", r"^([^:]*):", "$1 "), F.col("_category")))
    described = F.concat_ws(" ", "described", F.array_join(F.map_values("specs"), " "))
    held = products.select(F.col("sku").alias("_sku"), typed_specs(F.col("specs")).alias("_offered"), described.alias("_described"), F.coalesce(F.try_element_at("specs", F.lit("os")), F.lit("")).alias("product_os"))
    rows = wanted.join(held, "_sku", "left").withColumn("findings", F.when(F.col("product_os").isNotNull(), spec_findings(F.col("_asked"), F.col("_offered"))))
    rows = rows.withColumn("fit", findings_fit(F.col("findings")))
    met = attribute_check(F.regexp_replace("text", r"^[^:]*:?\s*", ""), F.col("_described"), {"dpi": F.col("_offered.dpi"), "ppm": F.col("_offered.ppm")})
    silent = F.col("product_os").isNotNull() & F.col("fit").isNull()
    return rows.select(*reqs.columns, "fit", F.coalesce(findings_failed(F.col("findings")), F.lit(False)).alias("failed"), "findings", F.when(silent, met).alias("met"), "product_os")
