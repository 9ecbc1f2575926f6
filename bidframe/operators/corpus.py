"""Jobs over whole document tables: sentences, contacts, pages, boilerplate, terms, dates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidframe.functions.scalars import duration_days, first_match, parse_number_words
from bidframe.functions.text import fold, line_shape, sentences, warranty_months
from bidframe.sources.scratch import stored

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE = r"(?:\+|00)[0-9][0-9 ().-]{7,}[0-9]"
#: Buyer segments by cues in the name, then in the text, in order; fixed values.
SEGMENT_RULES = [
    ("education", r"(?i)\b(universit\w*|college|school|institute of technology|academy|campus|students?)\b"),
    ("healthcare", r"(?i)\b(hospital|health\w*|medical|clinic\w*|patients?)\b"),
    ("public", r"(?i)\b(municipal\w*|city of|council|ministry|government|authority|public sector|department of|district|smart city|nagar|zilla|parishad|panchayat|\bpsu\b|development corporation)\b"),
    ("enterprise", r"(?i)\b(enterprise|group|corporation|multinational|global operations|\d{4,}\s+employees)\b"),
]
#: Delivery terms; fixed values.
INCOTERMS = "EXW FCA FAS FOB CFR CIF CPT CIP DAP DPU DDP"
_NUM = r"(\d+|[a-z]+(?:[ -][a-z]+)?)"


def split_sentences(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, sentence`` (TX1)."""
    return docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))


def extract_contacts(docs: DataFrame) -> DataFrame:
    """First e-mail, phone with an international prefix, contact name and tax id (TX2); null where absent."""
    first = lambda pattern, group=0: F.nullif(F.regexp_extract("text", pattern, group), F.lit(""))
    return docs.select("doc_id", first(EMAIL).alias("email"), first(PHONE).alias("phone"), first(r"(?im)^\s*contact(?: person)?\s*[:\-]\s*(.+)$", 1).alias("contact"),
                       first(r"(?i)\b(?:GSTIN|VAT|TRN|Tax ID)\s*(?:no\.?)?\s*[:\-]?\s*([A-Z0-9]{8,15})\b", 1).alias("tax_id"))


def labelled_values(docs: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Value of the first ``Label: value`` line of each label (TX3)."""
    return docs.select("doc_id", *(F.nullif(F.trim(F.regexp_extract("text", rf"(?im)^\s*(?:{words})\s*[:\-]\s*(.+)$", 1)), F.lit("")).alias(name) for name, words in labels.items()))


def extract_client(docs: DataFrame) -> DataFrame:
    """The labelled client, else the first of 25 lines with an organisation's suffix (TX4)."""
    lines = F.slice(F.split("text", "\n"), 1, 25)
    named = F.get(F.filter(lines, lambda x: x.rlike(r"(?i)\b(ltd|limited|university|college|hospital|gmbh|inc|llc|school|corporation|ministry)\b")), F.lit(0))
    labelled = F.nullif(F.trim(F.regexp_extract("text", r"(?im)^\s*(?:client|buyer|customer|purchaser|organisation|company)\s*[:\-]\s*(.+)$", 1)), F.lit(""))
    return docs.select("doc_id", F.coalesce(labelled, F.trim(named)).alias("client"))


_MONTH_NAMES = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_MONTHS = f"(?:{_MONTH_NAMES})[a-z]*"
_DATES = rf"(?i)\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b\d{{1,2}}(?:st|nd|rd|th)? {_MONTHS},? \d{{4}}\b|\b{_MONTHS} \d{{1,2}},? \d{{4}}\b|\b\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{4}}\b"


def raw_dates(text: Column) -> Column:
    """All that looks like a date, in the order of the text."""
    return F.regexp_extract_all(text, F.lit(_DATES), F.lit(0))


def dated(text: Column, month_first: bool = False) -> Column:
    """``pos, raw, date`` of the valid dates of a text, an array in its order; ``pos`` also counts invalid ones.

    A match has three parts, which are taken as numbers: no layout is tried in
    vain. Each step names what the next one uses more than once.
    """
    digits = lambda x: F.translate(F.lower(x), "abcdefghijklmnopqrstuvwxyz", "")
    number = lambda x: F.when(digits(x) != "", digits(x).cast("int"))  # noqa: E731 - a cast that fails is slow
    month = lambda x: F.array_position(F.lit(_MONTH_NAMES.split("|")), F.lower(F.left(x, F.lit(3)))).cast("int")
    keep = lambda m: (m["pos"].alias("pos"), m["raw"].alias("raw"))

    def numbers(m: Column) -> Column:
        a, b, c = (F.get(m["p"], F.lit(k)) for k in range(3))
        return F.struct(*keep(m), (F.length(a) == 4).alias("iso"), number(a).alias("a"), number(b).alias("b"), number(c).alias("c"), F.greatest(month(a), month(b)).alias("named"))

    def ordered(m: Column) -> Column:
        a, b, named, iso = m["a"], m["b"], m["named"] > 0, m["iso"]
        swapped = (b > 12) | (F.lit(month_first) & (a <= 12))
        day = F.when(named, F.coalesce(a, b)).when(iso, m["c"]).when(swapped, b).otherwise(a)
        mon = F.when(named, m["named"]).when(iso, b).when(swapped, a).otherwise(b)
        return F.struct(*keep(m), day.alias("d"), mon.alias("m"), F.when(~named & iso, a).otherwise(m["c"]).alias("y"))

    def date(m: Column) -> Column:
        d, mon = m["d"], m["m"]
        most = F.when(mon.isin(4, 6, 9, 11), 30).when(mon != 2, 31).when((m["y"] % 4 == 0) & ((m["y"] % 100 != 0) | (m["y"] % 400 == 0)), 29).otherwise(28)
        return F.struct(*keep(m), F.when(mon.between(1, 12) & (d >= 1) & (d <= most), F.make_date(m["y"], mon, d)).alias("date"))

    steps = F.transform(raw_dates(text), lambda x, i: F.struct(i.alias("pos"), x.alias("raw"), F.split(x, "[ ,/.-]+").alias("p")))
    for step in (numbers, ordered, date):
        steps = F.transform(steps, step)
    return F.filter(steps, lambda m: m["date"].isNotNull())


def find_dates(docs: DataFrame, month_first: bool = False) -> DataFrame:
    """``doc_id, pos, raw, date``: ISO, day-month-name, month-name-day and numeric dates; invalid ones go (TX5)."""
    return docs.select("doc_id", F.explode(dated(F.col("text"), month_first)).alias("m")).select("doc_id", "m.pos", "m.raw", "m.date")


def date_roles(contexts: DataFrame) -> DataFrame:
    """First date of each role by the words left of it on its line (TX6). Rows: doc_id, pos, date, context."""
    role = first_match(F.lower(F.right("context", F.lit(90))), [("due", r"due|deadline|submi|closing|last date|on or before"), ("delivery", r"deliver|supply by|completion"), ("issued", r"issued|dated|date of issue|published")])
    w = Window.partitionBy("doc_id", "role").orderBy("pos")
    return contexts.withColumn("role", role).where("role IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "context")


def date_contexts(docs: DataFrame, month_first: bool = False) -> DataFrame:
    """Dates with the text of their line up to them: the input of ``date_roles``."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("_key", F.struct("doc_id", "line"))
    dates = find_dates(lines.select(F.col("_key").alias("doc_id"), "text"), month_first).select(F.col("doc_id").alias("_of"), F.col("pos").alias("_pos"), "raw", "date")
    joined = dates.hint("merge").join(lines, F.col("_of") == F.col("_key"))
    return joined.select("doc_id", (F.col("line") * 1000 + F.col("_pos")).alias("pos"), "date", F.expr("substring(text, 1, instr(text, raw) - 1)").alias("context"))


def extract_terms(docs: DataFrame) -> DataFrame:
    """Delivery term, delivery and payment days, advance, warranty, price weight, lowest-price flag (TX11)."""
    low = F.lower("text")
    delivery, pay = rf"deliver\w*[^.\n]{{0,40}}?within {_NUM} (day|week|month)s?", r"payment[^.\n]{0,30}?(?:net|within)\s*(\d+)"
    number = lambda p, g: F.coalesce(F.regexp_extract(low, p, g).try_cast("double"), parse_number_words(F.regexp_extract(low, p, g)))
    return docs.select(
        "doc_id", F.nullif(F.regexp_extract("text", rf"\b({'|'.join(INCOTERMS.split())})\b", 1), F.lit("")).alias("incoterm"),
        F.when(low.rlike(delivery), duration_days(number(delivery, 1), F.regexp_extract(low, delivery, 2))).alias("delivery_days"),
        F.regexp_extract(low, pay, 1).try_cast("int").alias("payment_days"), F.regexp_extract(low, r"(\d+)\s*% advance|advance[^.\n%]{0,20}?(\d+)\s*%", 1).try_cast("int").alias("advance_pct"),
        warranty_months(F.regexp_extract(low, r"[^.\n]*warrant[^.\n]*", 0)).alias("warranty_months"),
        F.regexp_extract(low, r"(?:price|financial)[^.\n%]{0,30}?(\d+)\s*%", 1).try_cast("int").alias("price_weight_pct"), low.rlike(r"\bl1\b|lowest (?:price|bid|quot)").alias("lowest_price"))


def infer_segment(name: Column, text: Column | None = None) -> Column:
    """Buyer segment by the name, then by cues in the text; else smb (TX12). The caller cuts the text where only its head counts."""
    by_name = first_match(name, SEGMENT_RULES)
    if text is None:
        return F.coalesce(by_name, F.lit("smb"))
    return F.coalesce(by_name, first_match(text, SEGMENT_RULES), F.lit("smb"))


#: Words that make a number a specification, not a quantity; fixed values.
SPEC_UNITS = r"(?i)gb|tb|mb|inch|-inch|ghz|hz|w|va|kva|dpi|port|-port|years?|months?|days?|mp|mm|cm|k"


def quantity(sentence: Column) -> Column:
    """Quantity of a requested item by the first cue: label, N x, N units of, N units, leading, trailing, number words (TX13)."""
    s = F.regexp_replace(sentence, r"^\s*(?:[-*•]|\d+[.)])\s+", "")
    units = r"(?:units?|nos\.?|pcs|pieces|sets?|numbers?)"
    spec = SPEC_UNITS[4:]
    cues = [
        (r"(?i)\b(?:qty|quantity)\s*[:.\-]?\s*(\d+)", 1), (r"(?i)^\s*(\d+)\s*[x×]\s", 1), (rf"(?i)\b(\d+)\s*{units} of\b", 1), (rf"(?i)\b(\d+)\s*{units}\b", 1),
        (rf"(?i)^\s*(\d+)\s+(?!(?:{spec})\b)[a-z]", 1), (r"(?i)\s[-–x]\s*(\d+)\s*$", 1)]

    def named(s: Column) -> Column:
        return F.regexp_extract(F.lower(s), r"\b((?:twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|dozen|ten|eleven|twelve|two|three|four|five|six|seven|eight|nine)(?:[ -](?:one|two|three|four|five|six|seven|eight|nine|hundred|dozen))*)\b(?! (?:year|month|week|day))", 1)

    def cue(s: Column) -> Column:
        digits = F.coalesce(*(F.regexp_extract(s, p, g).try_cast("int") for p, g in cues))
        spelled = _once(named(s), lambda w: F.when(w != "", parse_number_words(w).cast("int")))
        return F.when(~s.rlike(r"(?i)\b(rfq|ref|reference|tender) no|warranty"), F.coalesce(digits, F.when(~s.rlike(r"\d+\s*(?:gb|tb)\b(?i)"), spelled)))

    # the sentence without its bullet and the number found in it are made once each, not once for every pattern that looks at them
    return _once(_once(s, cue), lambda q: F.when((q > 0) & (q < 100_000), q))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed a single time, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def extract_line_items(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, description, quantity``: sentences with a quantity (TX13), numbered within their row; one row a document."""
    found = F.filter(F.transform(sentences(F.col("text")), lambda s: F.struct(s.alias("sentence"), quantity(s).alias("quantity"))), lambda x: x["quantity"].isNotNull())
    rows = docs.select("doc_id", F.posexplode(found).alias("pos", "x")).select("doc_id", (F.col("pos") + 1).alias("line_no"), "x.sentence", "x.quantity")
    described = F.trim(F.regexp_replace(F.regexp_replace("sentence", r"(?i)\b(?:qty|quantity)\s*[:.\-]?\s*\d+|^\s*\d+\s*[x×]\s*|\(\s*\d+\s*(?:units?|nos\.?|pcs)\s*\)", ""), r"[-:,\s]+$", ""))
    return rows.select("doc_id", "line_no", described.alias("description"), "quantity")


def extract_specs(s: Column) -> Column:
    """Typed attributes of an item text (TX15); null where the text is silent. Graphics cards name video memory."""
    low = F.lower(s)
    num = lambda p, kind="double": F.regexp_extract(low, p, 1).try_cast(kind)
    memory, gpu = num(r"(\d+)\s*gb(?:\s*(?:ddr\d?)?\s*(?:ram|memory|vram))", "int"), low.rlike(r"graphics card|\bgpu\b|geforce|radeon")
    storage = F.coalesce(num(r"(\d+(?:\.\d+)?)\s*tb\s*(?:ssd|hdd|nvme)?") * 1000, num(r"(\d+)\s*gb\s*(?:ssd|hdd|nvme)"))
    family = F.nullif(F.regexp_extract(low, r"(xeon|epyc|ryzen|core i\d|i[3579]|celeron|pentium)", 1), F.lit(""))
    return F.struct(
        F.when(~gpu, memory).alias("ram_gb"), F.when(gpu, memory).alias("vram_gb"), F.when(storage == 1920, 1920).otherwise(storage).cast("int").alias("storage_gb"),
        num(r"(\d+(?:\.\d+)?)[- ]?(?:inch|\")").alias("screen_inch"), num(r"(\d+)[- ]?port", "int").alias("ports"), low.contains("poe").alias("poe"),
        F.coalesce(num(r"(\d+(?:\.\d+)?)\s*kva") * 1000, num(r"(\d+)\s*va\b")).cast("int").alias("va"), family.alias("cpu_family"), num(r"wi-?fi\s*(\d)", "int").alias("wifi"), num(r"(\d+)\s*dpi", "int").alias("dpi"))


def page_chunks(docs: DataFrame, size: int = 3200) -> DataFrame:
    """``doc_id, page, pos, line``: lines dealt greedily to pages of about ``size`` characters."""
    lines = F.split("text", "\n")
    start = F.struct(F.lit(0).alias("used"), F.lit(1).alias("page"), F.array().cast("array<int>").alias("pages"))

    def step(acc: Column, n: Column) -> Column:
        turn = (acc["used"] > 0) & (acc["used"] + n + 1 > size)
        page = F.when(turn, acc["page"] + 1).otherwise(acc["page"])
        return F.struct(F.when(turn, n + 1).otherwise(acc["used"] + n + 1).alias("used"), page.alias("page"), F.concat(acc["pages"], F.array(page)).alias("pages"))

    pages = F.aggregate(F.transform(lines, F.length), start, step, lambda acc: acc["pages"])
    return docs.select("doc_id", F.posexplode(F.arrays_zip(lines.alias("line"), pages.alias("page"))).alias("pos", "x")).select("doc_id", "x.page", "pos", "x.line")


def strip_boilerplate(lines: DataFrame, share: float = 0.4, least: int = 2, min_pages: int = 3) -> DataFrame:
    """Drop lines whose digit-free shape is among the first or last two lines on enough distinct pages (TX18).

    Rows: doc_id, page, pos, line. Documents of fewer than ``min_pages`` pages stay whole.
    """
    shaped = lines.withColumn("shape", line_shape(F.col("line")))
    page = Window.partitionBy("doc_id", "page")
    edge = (F.row_number().over(page.orderBy("pos")) <= 2) | (F.row_number().over(page.orderBy(F.desc("pos"))) <= 2)
    edges = shaped.withColumn("edge", edge).where("edge AND shape <> ''").groupBy("doc_id", "shape").agg(F.countDistinct("page").alias("on"))
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= min_pages)
    gone = edges.join(pages, "doc_id").where((F.col("on") >= least) & (F.col("on") >= share * F.col("pages"))).select("doc_id", "shape")
    return shaped.join(gone, ["doc_id", "shape"], "left_anti").drop("shape")


def leak_check(texts: DataFrame, forbidden: list[str], allowed: Column | None = None) -> DataFrame:
    """Texts that name a forbidden term, or an amount of 10 000 or more off every allowed one by more than 1 (TX24)."""
    low = F.lower("text")
    terms = F.filter(F.array(*(F.lit(t) for t in forbidden)), lambda t: F.contains(low, t))
    amounts = F.transform(F.regexp_extract_all("text", F.lit(r"\b\d[\d,]*(?:\.\d+)?"), F.lit(0)), lambda a: F.regexp_replace(a, ",", "").try_cast("double"))
    odd = F.filter(amounts, lambda a: (a >= 10_000) & ~F.exists(allowed, lambda x: F.abs(x - a) <= 1)) if allowed is not None else F.filter(amounts, lambda a: a >= 10_000)
    return texts.withColumn("terms", terms).withColumn("amounts", odd).where((F.size("terms") > 0) | (F.size("amounts") > 0))


def content_digest(docs: DataFrame, keys: list[str], text: str = "text", digits: int = 3) -> DataFrame:
    """``keys, digest``: one digest of all whole texts of a key, whatever their order (F28 for sets of any size).

    Texts are hashed in their row and equal ones counted. The hashes of a key
    are digested in order by blocks of their first hex digits, the blocks by
    larger blocks, ``digits`` digits a level; a key has as many levels as keep
    its blocks at about 16^digits entries. So no group holds a text or grows
    with the key. Null texts count as empty.
    """
    counted = docs.select(*keys, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_h")).groupBy(*keys, "_h").agg(F.count(F.lit(1)).alias("_n"))
    counted = stored(counted, "hashes")
    width = 16**digits
    levels = F.greatest(F.lit(1), F.ceil(F.log(F.count(F.lit(1)) / width) / F.log(F.lit(float(width)))))
    depths = stored(counted.groupBy(*keys).agg((digits * levels).cast("int").alias("_depth")), "depths")
    deepest = depths.agg(F.max("_depth")).first()[0] or digits
    same = [counted[k].eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    depths = depths.withColumnsRenamed({k: f"_key_{k}" for k in keys}).hint("merge")
    rows = counted.join(depths, reduce(and_, same)).select(*keys, "_depth", "_h", F.concat_ws(":", F.col("_h"), F.col("_n").cast("string")).alias("_e"))
    joined = F.sha2(F.array_join(F.sort_array(F.collect_list("_e")), ","), 256)
    for level in range(deepest, 0, -digits):
        block = F.left("_h", F.lit(level)).alias("_b")
        done = rows.where(F.col("_depth") >= level).groupBy(*keys, "_depth", block).agg(joined.alias("_d"))
        done = done.select(*keys, "_depth", F.col("_b").alias("_h"), F.concat_ws(":", "_b", "_d").alias("_e"))
        rows = done if level == deepest and deepest == digits else done.unionByName(rows.where(F.col("_depth") < level))
    return rows.groupBy(*keys).agg(joined.alias("digest"))


def section_owner(blocks: DataFrame) -> DataFrame:
    """Each block with the last heading above it; text before the first heading has none (W15). Rows: doc_id, pos, level (null: text), title."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("owner", F.last(F.when(F.col("level").isNotNull(), F.col("pos")), ignorenulls=True).over(w))


def section_paths(blocks: DataFrame, depth: int = 6) -> DataFrame:
    """Headings with ``path``: positions of all headings that enclose them, outermost first (TX20)."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heads = blocks.where("level IS NOT NULL")
    at = {k: F.last(F.when(F.col("level") == k, F.col("pos")), ignorenulls=True).over(w) for k in range(1, depth + 1)}
    heads = heads.withColumns({f"_l{k}": c for k, c in at.items()})
    path, low = F.array().cast("array<int>"), F.lit(-1)
    for k in range(1, depth + 1):  # a level counts while it opened after the level around it
        own = F.col(f"_l{k}")
        ok = own.isNotNull() & (F.lit(k) <= F.col("level")) & (own > low)
        path, low = F.when(ok, F.concat(path, F.array(own.cast("int")))).otherwise(path), F.when(ok, own).otherwise(low)
    return heads.withColumn("path", path).drop(*(f"_l{k}" for k in range(1, depth + 1)))


def section_rollup(paths: DataFrame, items: DataFrame) -> DataFrame:
    """Items in each section and all below it (A21). ``items``: doc_id, owner."""
    exploded = items.join(paths.select("doc_id", F.col("pos").alias("owner"), "path"), ["doc_id", "owner"]).select("doc_id", F.explode("path").alias("section"))
    return exploded.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("items"))


def stitch_tables(rows: DataFrame) -> DataFrame:
    """Adds ``table_id``: a table whose header equals the one before it continues it (W16). Rows: doc_id, pos, header."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    new = F.coalesce(F.col("header") != F.lag("header").over(w), F.lit(True)).cast("int")
    return rows.withColumn("_new", new).withColumn("table_id", F.sum("_new").over(w)).drop("_new")


def country_vote(mentions: DataFrame) -> DataFrame:
    """The country mentioned most; the earliest mention breaks ties (A30). Rows: doc_id, country, pos."""
    counts = mentions.groupBy("doc_id", "country").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return counts.groupBy("doc_id").agg(F.max_by("country", F.struct("n", -F.col("first"))).alias("country"))


def find_places(docs: DataFrame, gazetteer: DataFrame, longest: int = 3) -> DataFrame:
    """``doc_id, pos, place``: aliases of one to ``longest`` words, longest first, not overlapping (TX9).

    An equi join of word n-grams with the alias table; ``gazetteer``: alias
    (folded), place. Shorter matches inside longer ones go by an anti join.
    """
    words = F.filter(F.split(fold(F.col("text")), r"[^a-z0-9]+"), lambda w: w != "")
    base = docs.select("doc_id", words.alias("w"))
    parts = None
    for n in range(1, longest + 1):
        grams = F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.array_join(F.slice("w", i + 1, n), " ")))
        rows = base.select("doc_id", F.posexplode(grams).alias("pos", "alias")).withColumn("n", F.lit(n))
        parts = rows if parts is None else parts.unionByName(rows)
    hits = parts.join(gazetteer, "alias").select("doc_id", "pos", "n", "place")
    covered = hits.where("n > 1").select("doc_id", F.col("n").alias("_n"), F.explode(F.sequence(F.col("pos") - longest + 1, F.col("pos") + F.col("n") - 1)).alias("pos"), F.col("pos").alias("_from"))
    inside = hits.join(covered.hint("merge"), ["doc_id", "pos"]).where("_n > n AND pos + n > _from AND pos < _from + _n").select("doc_id", "pos", "n").distinct()
    return hits.join(inside.hint("merge"), ["doc_id", "pos", "n"], "left_anti")
