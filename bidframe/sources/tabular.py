"""Sheets, stock exports, reference data, documents, pages; and the writers of versions and partitions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidframe.functions.scalars import norm_header

DELIMITERS = {",": ",", ";": ";", "\t": "\t", "|": r"\|"}


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """``file, row_no, cells``: the delimiter is the commonest of comma, semicolon, tab and bar; blank rows go, cells are trimmed.

    Each file finds its own delimiter by a census of its lines, so a folder of
    mixed sheets is one job. Cells in quotes are taken out of their quotes.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row_no"), F.regexp_replace("value", "^﻿", "").alias("line"))
    counts = [F.sum(F.size(F.split("line", p)) - 1).alias(str(i)) for i, p in enumerate(DELIMITERS.values())]
    census = lines.groupBy("file").agg(*counts)
    best = F.greatest(*(F.struct(F.col(str(i)).alias("n"), F.lit(-i).alias("i")) for i in range(len(DELIMITERS))))
    census = census.select(F.col("file").alias("_f"), (-best["i"]).alias("_d"))
    rows = lines.join(census, lines.file == F.col("_f"))
    cells = F.lit(None).cast("array<string>")
    for i, p in enumerate(DELIMITERS.values()):
        cells = F.when(F.col("_d") == i, F.split("line", rf'{p}(?=(?:[^"]*"[^"]*")*[^"]*$)')).otherwise(cells)
    rows = rows.select("file", "row_no", F.transform(cells, lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), '^"|"$', ""), '""', '"'))).alias("cells"))
    return rows.where(F.exists("cells", lambda c: c != ""))


def detect_header(rows: DataFrame) -> DataFrame:
    """The header of each file: of its first ten rows the one with most cells that hold no number; the earliest wins."""
    order = Window.partitionBy("file").orderBy("row_no")
    first = rows.withColumn("_n", F.row_number().over(order)).where("_n <= 10")
    score = F.size(F.filter("cells", lambda c: (c != "") & ~c.rlike(r"^[₹$€£]?\s*-?[\d.,]+%?$")))
    w = Window.partitionBy("file").orderBy(F.desc("_score"), "row_no")
    best = first.withColumn("_score", score).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    names = F.transform("cells", lambda c, i: F.when(c == "", F.concat(F.lit("Column "), (i + 1).cast("string"))).otherwise(c))
    return best.select("file", F.col("row_no").alias("header_row"), names.alias("header"))


def map_headers(rows: DataFrame, headers: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """Rows below the header as one column a field (S3).

    A field takes the column whose normalised header equals a synonym, else
    one that holds all of a synonym's words; earlier fields choose first.
    """
    joined = rows.join(headers, "file").where("row_no > header_row").withColumn("_h", F.transform("header", norm_header))
    used, out = F.array().cast("array<int>"), {}
    index = F.sequence(F.lit(0), F.size("_h") - 1)

    def free(test, taken):
        return F.filter(index, lambda i: test(i) & ~F.array_contains(taken, i))

    def equal(words):
        return lambda i: F.get("_h", i) == words

    def holds(words):
        return lambda i: F.size(F.array_except(F.split(F.lit(words), " "), F.split(F.get("_h", i), " "))) == 0

    for field, words in synonyms.items():
        exact, subset = (F.flatten(F.array(*(free(test(w), used) for w in words))) for test in (equal, holds))
        pick = F.coalesce(F.get(exact, F.lit(0)), F.get(subset, F.lit(0)))
        out[field] = F.when(pick.isNotNull(), F.get("cells", pick))
        used = F.when(pick.isNotNull(), F.concat(used, F.array(pick))).otherwise(used)
    return joined.select("file", "row_no", *(F.nullif(c, F.lit("")).alias(f) for f, c in out.items()))


STOCK_SCHEMA = """_NAME string, BASEUNITS string, OPENINGBALANCE string, OPENINGRATE string, STANDARDPRICE string, HSNCODE string,
`GSTDETAILS.LIST` array<struct<RATEDETAILS:array<struct<GSTRATEDUTYHEAD:string,GSTRATE:double>>>>"""


def read_stock_xml(spark: SparkSession, path: str) -> DataFrame:
    """Stock items of an XML export with their integrated-tax rate (S4). Files that declare entities are refused."""
    if not spark.read.text(path).where(F.col("value").rlike("(?i)<!(DOCTYPE|ENTITY)")).isEmpty():
        raise ValueError("DOCTYPE and ENTITY declarations are not read")
    items = spark.read.format("xml").option("rowTag", "STOCKITEM").schema(STOCK_SCHEMA).load(path)
    rates = F.filter(F.flatten(F.col("`GSTDETAILS.LIST`.RATEDETAILS")), lambda r: F.lower(r["GSTRATEDUTYHEAD"]).rlike("integrated|igst"))
    return items.select(F.col("_NAME").alias("name"), F.col("BASEUNITS").alias("unit"), F.col("OPENINGBALANCE").alias("stock"), F.col("OPENINGRATE").alias("cost"),
                        F.col("STANDARDPRICE").alias("price"), F.col("HSNCODE").alias("hsn"), F.get(rates, F.size(rates) - 1)["GSTRATE"].alias("gst_rate_pct"))


def read_reference_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_tiers(spark: SparkSession, path: str) -> DataFrame:
    """Tiers as a JSON map of category to steps, to rows."""
    steps = "array<struct<min_qty:int,discount_pct:double>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{steps}>").alias("m"))
    return text.select(F.explode("m").alias("category", "steps")).select("category", F.inline("steps"))


def load_if_empty(df: DataFrame, name: str, path: str | None = None) -> bool:
    """Save as a table unless it exists with rows (S6); tells if it wrote. ``path`` places the files outside the warehouse."""
    spark = df.sparkSession
    if spark.catalog.tableExists(name) and not spark.table(name).isEmpty():
        return False
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return True


def read_markdown_sections(spark: SparkSession, path: str) -> DataFrame:
    """``file, title, pos, heading, body`` of files with ``# title`` and ``## `` sections."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    title = F.trim(F.regexp_extract("value", r"(?m)^# (.+)$", 1))
    # the title and the parts first: a file's text must not go along with each of its sections
    read = files.select("file", title.alias("title"), F.split("value", r"(?m)^## ").alias("_parts"))
    parts = read.select("file", "title", F.posexplode("_parts").alias("pos", "part")).where("pos > 0")
    return parts.select("file", "title", "pos", F.trim(F.substring_index("part", "\n", 1)).alias("heading"), F.btrim(F.expr("substring(part, instr(part, '\n') + 1)"), F.lit(" \n\r\t")).alias("body"))


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes as text: UTF-8, UTF-16 with a mark, Windows-1252, Latin-1."""

    def one(b: bytes) -> str:
        if b[:2] in (b"\xff\xfe", b"\xfe\xff"):
            return b.decode("utf-16", "replace")
        for name in ("utf-8-sig", "cp1252"):
            try:
                return b.decode(name)
            except UnicodeDecodeError:
                continue
        return b.decode("latin-1")

    return content.map(one)


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", decoded("content").alias("text"))  # (S8)


def extract_page_prices(pages: DataFrame) -> DataFrame:
    """``page_id, name, price, currency, source`` of saved product pages.

    A schema.org offer in JSON-LD goes first, then a price meta tag, then a
    visible rupee amount; the name is the product's or the title.
    """
    ld = F.regexp_extract("html", r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>', 1)
    offer = F.coalesce(*(F.get_json_object(ld, p) for p in ("$.offers.price", "$.offers.lowPrice", "$.offers[0].price", "$['@graph'][0].offers.price")))
    currency = F.coalesce(*(F.get_json_object(ld, p) for p in ("$.offers.priceCurrency", "$.offers[0].priceCurrency")))
    meta = F.regexp_extract("html", r'(?i)<meta[^>]*(?:product:price:amount|og:price:amount|itemprop="price")[^>]*content="([\d.,]+)"', 1)
    visible = F.regexp_extract(F.regexp_replace("html", r"(?s)<[^>]+>", " "), r"(?:₹|\bRs\.?|\bINR)\s*([\d,]+(?:\.\d+)?)", 1)
    number = lambda c: F.regexp_replace(c, ",", "").try_cast("double")
    price = F.coalesce(number(offer), number(meta), number(visible))
    source = F.when(number(offer).isNotNull(), "schema.org offer").when(number(meta).isNotNull(), "price meta tag").when(number(visible).isNotNull(), "visible text")
    name = F.coalesce(F.get_json_object(ld, "$.name"), F.nullif(F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")))
    return pages.select("page_id", name.alias("name"), price.alias("price"), F.coalesce(currency, F.lit("INR")).alias("currency"), source.alias("source"))


def read_jdbc(spark: SparkSession, url: str, name: str, column: str | None = None, low: int | None = None, high: int | None = None, parts: int = 1, quote: str = '"', **options) -> DataFrame:
    """A table of any SQL database (S11); filters and columns are pushed to it.

    With a numeric ``column`` the table is read in ``parts`` ranges at once;
    the bounds come from the database itself where they are not given, by the
    column's name between ``quote`` signs. Rows outside the bounds and null
    keys are read by the outer ranges.
    """
    source = lambda: spark.read.format("jdbc").options(url=url, **options)
    ranges = {}
    if column and parts > 1:
        if low is None or high is None:
            found = source().option("query", f"SELECT MIN({quote}{column}{quote}) AS low, MAX({quote}{column}{quote}) AS high FROM {name}").load().first()
            low, high = (found[0] if low is None else low), (found[1] if high is None else high)
        if low is not None:
            ranges = {"partitionColumn": column, "lowerBound": low, "upperBound": max(high, low + 1), "numPartitions": parts}
    return source().options(dbtable=name, **ranges).load()


OFFER_SCHEMA = "competitor_id string, competitor string, mpn string, unit_price double, currency string, warranty_months int, lead_time_days int, in_stock boolean, reliability double, country string, observed_at timestamp"


def read_feed(spark: SparkSession, path: str, country: str | None = None, streaming: bool = False) -> DataFrame:
    """Landed feed offers, of one country where given.

    A record that does not fit the schema keeps what fits and its whole text in
    ``rescued``, which is null for all others.
    """
    reader = (spark.readStream if streaming else spark.read).schema(f"{OFFER_SCHEMA}, rescued string").option("columnNameOfCorruptRecord", "rescued").option("mode", "PERMISSIVE")
    rows = reader.json(path)
    return rows.where(F.col("country") == country) if country else rows


def append_batch(df: DataFrame, path: str, batch: int, partition_by: tuple[str, ...] = ()) -> None:
    """Append ``df`` under the number ``batch``; writing the same batch again replaces it, so a repeated run leaves its rows once.

    The numbered folder is replaced as a whole: rows of an attempt that died
    are gone with it. An empty batch leaves what other batches wrote.
    """
    rows = df.drop("batch").write.mode("overwrite").option("partitionOverwriteMode", "static")
    (rows.partitionBy(*partition_by) if partition_by else rows).parquet(f"{path.rstrip('/')}/batch={int(batch)}")


def write_price_versions(df: DataFrame, path: str, batch: int | None = None) -> None:
    """Append versions, partitioned by the month in which they take effect (S13); with ``batch``, a repeated append replaces itself."""
    rows = df.withColumn("effective_month", F.date_format("effective_from", "yyyy-MM"))
    if batch is None:
        rows.write.mode("append").partitionBy("effective_month").parquet(path)
    else:
        append_batch(rows, path, batch, ("effective_month",))


def replace_partition(df: DataFrame, path: str, key: str) -> None:
    """Replace the rows of the keys that ``df`` holds, keep the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
