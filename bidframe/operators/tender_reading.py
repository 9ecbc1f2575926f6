"""Facts, key dates, award method and eligibility criteria read from the units of tender documents.

A unit is a row ``doc_id, pos, source, text, cells, header, kind``: a sentence
or clause (source ``text`` or ``field``), or a table row with its cells and
its table's header; ``kind`` is the kind of its section. Every rule is a
column expression; what a document says first wins, by one aggregation a
document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidframe.functions.scalars import first_match, let, parse_inr, parse_number_words
from bidframe.operators.corpus import dated, find_places
from bidframe.sources.scratch import stored

_WORDS = {w: n for n, w in enumerate("one two three four five six seven eight nine ten".split(), 1)}


def _says(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}")


def _take(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the leftmost match; null where it matches nothing."""
    return F.nullif(F.regexp_extract(text, f"(?i){pattern}", group), F.lit(""))


def _every(text: Column, pattern: str, made) -> Column:
    """``made(match)`` of all matches in turn."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(0)), made)


def _number(word: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in _WORDS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.lower(word)), parse_number_words(word).cast("int"))


def format_inr(amount: Column) -> Column:
    """Rupees in crore or lakh with two decimals, or whole."""
    scaled = lambda by, unit: F.concat(F.lit("Rs. "), F.format_number(amount / by, 2), F.lit(unit))
    return F.when(amount >= 1e7, scaled(1e7, " crore")).when(amount >= 1e5, scaled(1e5, " lakh")).when(amount.isNotNull(), F.concat(F.lit("Rs. "), F.format_number(amount, 0)))


# ---- label and value pairs

#: A line that states ``Label: value``; fixed value.
LABELLED = r"^([A-Z][A-Za-z ()./'&-]{2,60}?)\s*[:–-]\s+(.{2,200})$"


def _labelled(units: DataFrame) -> DataFrame:
    """``units`` with ``label`` and ``value``: the last two filled cells of a table row, or the sides of a ``Label: value`` line; null where there are none."""
    filled = F.filter("cells", lambda c: c.isNotNull() & (c != ""))
    in_table = (F.col("source") == "table") & (F.coalesce(F.size("cells"), F.lit(0)) > 0)
    numbered = F.element_at("_filled", -2).rlike(r"^\d{1,3}\.?$")
    paired = (F.size("_filled") >= 3) | ((F.size("_filled") == 2) & ~F.when(F.size("_filled") == 2, numbered).otherwise(False))
    of_line = lambda k: F.nullif(F.regexp_extract("text", LABELLED, k), F.lit(""))
    rows = units.withColumn("_filled", F.when(in_table, filled))
    cell = lambda k: F.when(paired, F.try_element_at("_filled", F.lit(k)))
    return rows.withColumn("label", F.when(in_table, cell(-2)).otherwise(of_line(1))).withColumn("value", F.when(in_table, cell(-1)).otherwise(of_line(2))).drop("_filled")


def labelled_pairs(units: DataFrame) -> DataFrame:
    """``doc_id, pos, label, value``: a table row's last two filled cells, unless the first of two is a row number, and both sides of ``Label: value`` lines."""
    return _labelled(units).where("label IS NOT NULL AND value IS NOT NULL").select("doc_id", "pos", "label", "value")


# ---- key dates

#: Roles of dates in the order in which a date is offered to them; fixed values.
DATE_ROLES = [
    ("queries", "Last date for queries", r"quer(?:y|ies)|clarifications?"),
    ("prebid", "Pre-bid meeting", r"pre-?(?:bid|proposal)\s+(?:meeting|conference)"),
    ("opening", "Bid opening", r"\bopening\b"),
    ("submission", "Bid submission deadline",
     r"(?:last|closing|end|due)\s+date.*(?:submission|receipt)|submission of (?:bids?|proposals?|offers?|tenders?)|bid (?:submission )?(?:end|due|closing)|bids? due|proposals? (?:are )?due"),
    ("publication", "Date of publication", r"publi(?:cation|shed)|date of issue|issue date|\bissued\b"),
]
#: A time of day; fixed value.
TIME = r"\b(\d{1,2})[:.](\d{2})\s*(?:hrs|hours|am|pm|a\.m\.|p\.m\.)?"


def key_dates(units: DataFrame, month_first: bool = False) -> DataFrame:
    """``doc_id, key, label, date, time, pos, evidence``: the dates of a tender's events (TX7).

    Pairs come first, then running text; a unit's first date goes to the first
    role in order that its label, or the text up to the date, names and that
    has none yet. The time is the first one behind the date.
    """
    pairs = labelled_pairs(units).select("doc_id", F.lit(0).alias("stage"), "pos", "label", "value")
    texts = units.where(F.col("source").isin("text", "field")).select("doc_id", F.lit(1).alias("stage"), "pos", F.col("text").alias("label"), F.col("text").alias("value"))
    rows = pairs.unionByName(texts).select("*", F.explode(F.slice(dated(F.col("value"), month_first), 1, 1)).alias("_d")).withColumn("_at", F.instr("value", F.col("_d.raw")))
    own = F.col("label") != F.col("value")
    named = F.when(own, F.col("label")).otherwise(F.substring(F.col("value"), F.lit(1), F.col("_at")))
    behind = F.substring(F.col("value"), F.col("_at") + F.length("_d.raw"), F.length("value"))
    hour = _take(behind, TIME).cast("int")
    time = F.when(hour < 24, F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), _take(behind, TIME, 2)))
    offer = F.struct("stage", "pos", F.array(*(_says(named, p) for _, _, p in DATE_ROLES)).alias("fits"), F.col("_d.date").alias("date"), time.alias("time"),
                     F.substring(F.when(own, F.concat_ws(": ", "label", "value")).otherwise(F.col("value")), 1, 220).alias("evidence"))
    fitting = F.filter(F.array(offer), lambda o: F.exists(o["fits"], lambda x: x))  # a condition on the row would match every role twice
    offers = rows.select("doc_id", F.explode(fitting).alias("o")).groupBy("doc_id").agg(F.sort_array(F.collect_list("o")).alias("offers"))
    none = F.array().cast("array<struct<role:int,pos:int,date:date,time:string,evidence:string>>")

    def take(taken: Column, offer: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0), F.lit(len(DATE_ROLES) - 1)), lambda i: F.get(offer["fits"], i) & ~F.exists(taken, lambda t: t["role"] == i))
        new = F.struct(F.get(free, F.lit(0)).alias("role"), offer["pos"].cast("int").alias("pos"), offer["date"].alias("date"), offer["time"].alias("time"), offer["evidence"].alias("evidence"))
        return F.when(F.size(free) > 0, F.concat(taken, F.array(new))).otherwise(taken)

    taken = offers.select("doc_id", F.explode(F.aggregate("offers", none, take)).alias("t"))
    text = lambda k: F.get(F.array(*(F.lit(r[k]) for r in DATE_ROLES)), F.col("t.role"))
    return taken.select("doc_id", text(0).alias("key"), text(1).alias("label"), "t.date", "t.time", "t.pos", "t.evidence")


# ---- facts

#: Facts read from the label of a pair: key, name, cue; fixed values.
PAIR_FACTS = [
    ("estimated_value", "Estimated value", r"estimated (?:cost|value)|tender value|project value|approximate (?:cost|value)"),
    ("emd", "Earnest money (EMD)", r"\bemd\b|earnest money|bid security"),
    ("tender_fee", "Tender fee", r"tender (?:document )?fee|document fee|cost of (?:tender|bid) document"),
    ("bid_validity", "Bid validity", r"(?:bid|proposal|offer|tender)s? validity|valid(?:ity)? for\b|shall remain valid"),
    ("completion", "Completion period", r"completion period|period of completion|contract period|go live within"),
]
MONEY_FACTS = ("estimated_value", "emd", "tender_fee")
#: Cues of the facts in running text; fixed values.
ESTIMATE, DEPOSIT = r"estimated (?:cost|value)", r"\bemd\b|earnest money|bid security"
VALIDITY = r"(?:bids?|proposals?|offers?|tenders?)\s+(?:shall|will|must)\s+(?:remain\s+)?valid[^.]{0,40}?(\d{2,3})\s*days"
SECURITY = r"performance (?:security|bank guarantee|guarantee)[^.]{0,80}?(\d{1,2}(?:\.\d+)?)\s*%"
DAMAGES = r"liquidated damages[^.]{0,80}?(\d(?:\.\d+)?)\s*%[^.]{0,80}?(week|day|month)[^.]{0,120}?maximum (?:of )?(\d{1,2})\s*%"
MILESTONE = r"\d{1,3}\s*%[^.]{0,60}(?:on|against|after)\s+(?:delivery|installation|go-live|commissioning|acceptance|supply)"
SMALL_FIRM, RELIEF, LOCAL = r"\b(?:mses?|micro and small|msme|udyam|nsic)\b", r"exempt|preference", r"make in india|local supplier|local content"
PORTAL = (r"(gem portal|government e-?marketplace|cppp|eprocure\.gov\.in|mahatenders|e-?tendering portal|"
          r"online through (?:the )?[^,;()]{3,60}?(?=\s*[(,;]|$)|sealed (?:envelope|cover)s?)")


def _text_facts() -> list[tuple[str, str, Column, Column, Column]]:
    """Key, name, condition, value and amount of the facts of running text; the value of a sum of money is its amount in words."""
    t, money, none = F.col("text"), parse_inr(F.col("text")), F.lit(None).cast("double")
    rate, cap, mode = _take(t, DAMAGES), _take(t, DAMAGES, 3), _take(t, PORTAL)
    return [
        ("estimated_value", "Estimated value", _says(t, ESTIMATE), none, money),
        ("emd", "Earnest money (EMD)", _says(t, DEPOSIT), none, money),
        ("bid_validity", "Bid validity", _says(t, VALIDITY), F.concat(_take(t, VALIDITY), F.lit(" days")), none),
        ("performance_security", "Performance security", _says(t, SECURITY), F.concat(_take(t, SECURITY), F.lit("% of contract value")), _take(t, SECURITY).cast("double")),
        ("ld", "Liquidated damages", _says(t, DAMAGES), F.concat(rate, F.lit("% per "), F.lower(_take(t, DAMAGES, 2)), F.lit(", capped at "), cap, F.lit("%")), cap.cast("double")),
        ("payment", "Payment milestones", _says(t, MILESTONE), t, none),
        ("msme", "MSE benefits", _says(t, SMALL_FIRM) & _says(t, RELIEF), F.when(_says(t, "exempt"), "EMD/fee exemption").otherwise("Purchase preference"), none),
        ("local_content", "Make in India", _says(t, LOCAL), F.lit("Local-content preference applies"), none),
        ("submission_mode", "Submission", mode.isNotNull(), F.concat(F.upper(F.substring(mode, 1, 1)), F.substring(mode, 2, 1_000)), none),
        ("reverse_auction", "Reverse auction", _says(t, "reverse auction"), F.lit("Price discovery by reverse auction"), none),
    ]


def extract_facts(units: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """``doc_id, key, label, value, amount, pos, evidence``: each fact of a tender as it is first stated (TX21).

    Pairs win over running text, earlier units over later ones. ``references``
    (doc_id, reference) add the tender's own number. An earnest money from
    which small firms are exempt says so.
    """
    fact = lambda key, label, fits, value, amount, said: F.when(fits, F.struct(
        F.lit(key).alias("key"), F.lit(label).alias("label"), value.alias("value"), amount.cast("double").alias("amount"), F.substring(said, 1, 260).alias("evidence")))
    pair, said = F.col("value"), F.concat_ws(": ", "label", "value")
    from_pairs = [fact(k, n, _says(F.col("label"), p), pair, parse_inr(pair) if k in MONEY_FACTS else F.lit(None), said) for k, n, p in PAIR_FACTS]
    # a sum is read once, and only where its cue stands
    money = lambda key, label, fits, amount: let(F.when(fits, amount), lambda m: fact(key, label, F.coalesce(m, F.lit(0.0)) != 0, format_inr(m), m, F.col("text")))
    from_text = [money(k, n, fits, amount) if k in MONEY_FACTS else fact(k, n, fits, value, amount, F.col("text")) for k, n, fits, value, amount in _text_facts()]
    every = lambda options: F.explode(F.array_compact(F.array(*options))).alias("f")
    rows = labelled_pairs(units).select("doc_id", "pos", F.lit(0).alias("stage"), every(from_pairs)).unionByName(
        units.where(F.col("source").isin("text", "field")).select("doc_id", "pos", F.lit(1).alias("stage"), every(from_text)))
    first = rows.groupBy("doc_id", "f.key").agg(F.min_by(F.struct("f.label", "f.value", "f.amount", "pos", "f.evidence"), F.struct("stage", "pos")).alias("v")).select("doc_id", "key", "v.*")
    of_doc = Window.partitionBy("doc_id")  # at most a row for each fact
    exempt = F.max(F.when((F.col("key") == "msme") & F.col("value").startswith("EMD"), True)).over(of_doc)
    spared = (F.col("key") == "emd") & (F.coalesce("amount", F.lit(0.0)) != 0) & exempt
    facts = first.withColumn("value", F.when(spared, F.concat(format_inr(F.col("amount")), F.lit(" (MSEs exempt)"))).otherwise(F.col("value")))
    if references is None:
        return facts
    own = references.where("reference IS NOT NULL AND reference <> ''").select(
        "doc_id", F.lit("reference").alias("key"), F.lit("Tender reference").alias("label"), F.col("reference").alias("value"),
        F.lit(None).cast("double").alias("amount"), F.lit(None).cast(dict(facts.dtypes)["pos"]).alias("pos"), F.lit(None).cast("string").alias("evidence"))
    return own.unionByName(facts)


# ---- award method

#: Weights, award rules, least score and notes; fixed values.
RATIO = r"(\d{2})\s*:\s*(\d{2})[^.]{0,80}?technical[^.]{0,30}financial"
PERCENTAGES = r"technical[^.]{0,60}?(\d{2})\s*%[^.]{0,60}?financial[^.]{0,40}?(\d{2})\s*%"
QCBS, QCBS_SAID = r"\bqcbs\b|quality and cost based", r"qcbs|quality and cost|\d{2}\s*:\s*\d{2}"
LOWEST, LOWEST_SAID = r"\bl-?1\b|lowest (?:evaluated|compliant|quoted|priced|responsive|bid)", r"\bl-?1\b|lowest"
WEIGHTED = r"weight(?:age|ed)?|marks|points"
LEAST_SCORE = r"minimum (?:of )?(\d{2,3})\s*(?:marks|points|%)|(\d{2,3})\s*marks out of|qualifying (?:marks|score) of (\d{2,3})"
NOTES = [
    (r"reverse auction", "Final prices discovered by reverse auction."), (r"purchase preference", "Purchase preference for MSEs / local suppliers applies."),
    (r"vary the quantit", "Quantities may be varied at award at the quoted unit rates."),
]


def extract_evaluation(units: DataFrame) -> DataFrame:
    """``doc_id, method, technical_weight, financial_weight, min_technical_score, evidence, criteria, notes`` of each document (TX22).

    The units of evaluation sections speak, all units where there are none;
    marks are the rows of tables whose header names marks, points or weights.
    """
    held = F.coalesce(F.size("cells"), F.lit(0)) > 0
    filled = F.filter("cells", lambda c: c.isNotNull() & (c != ""))
    marks = F.when(
        (F.col("source") == "table") & held & _says(F.array_join("header", " "), "marks|points|weight") & (F.size(filled) >= 2) & F.element_at(filled, -1).rlike(r"^\d{1,3}(?:\.\d+)?$"),
        F.struct(F.try_element_at(filled, F.lit(-2)).alias("criterion"), F.element_at(filled, -1).try_cast("double").alias("marks")))
    evaluates = F.coalesce(F.col("kind") == "evaluation", F.lit(False))
    rows = units.select("doc_id", F.struct("pos", evaluates.alias("own"), F.coalesce("text", F.lit("")).alias("text"), marks.alias("marks")).alias("u"))
    docs = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("u")).alias("u"))
    docs = docs.select("doc_id", F.when(F.exists("u", lambda x: x["own"]), F.filter("u", lambda x: x["own"])).otherwise(F.col("u")).alias("u"))
    docs = docs.withColumn("t", F.array_join(F.transform("u", lambda x: x["text"]), " "))
    t = F.col("t")
    weight = lambda k: F.coalesce(_take(t, RATIO, k), _take(t, PERCENTAGES, k)).cast("double")
    said = lambda p: F.get(F.filter(F.transform("u", lambda x: x["text"]), lambda x: _says(x, p)), F.lit(0))
    docs = docs.withColumn("technical_weight", weight(1)).withColumn("financial_weight", weight(2))
    qcbs, lowest = F.col("technical_weight").isNotNull() | _says(t, QCBS), _says(t, LOWEST)
    method = F.when(qcbs, "QCBS").when(lowest, "L1").when(_says(t, WEIGHTED), "Weighted").otherwise("Not stated")
    least = F.coalesce(*(_take(t, LEAST_SCORE, k) for k in (1, 2, 3))).cast("double")
    criteria = F.filter(F.transform("u", lambda x: x["marks"]), lambda x: x.isNotNull())
    notes = F.array_compact(F.array(*(F.when(_says(t, p), F.lit(note)) for p, note in NOTES)))
    return docs.select("doc_id", method.alias("method"), "technical_weight", "financial_weight", least.alias("min_technical_score"),
                       F.when(qcbs, said(QCBS_SAID)).when(lowest, said(LOWEST_SAID)).alias("evidence"), criteria.alias("criteria"), notes.alias("notes"))


# ---- eligibility

#: Kinds of criteria in order: kind, name, cue; fixed values.
CRITERIA = [
    ("turnover", "Annual turnover", r"turnover"),
    ("net_worth", "Net worth", r"net worth"),
    ("similar_works", "Similar work experience",
     r"\bsimilar\b[^.]{0,40}(?:works?|projects?|orders?|contracts?|suppl)|(?:completed|executed)\s+(?:at least\s+)?(?:one|two|three|four|five|\d)\s+(?:purchase\s+)?(?:orders?|works?|projects?|contracts?)"),
    ("supplied_quantity", "Supply volume", r"supplied\s+(?:at least|a minimum of|not less than|minimum)?\s*\d[\d,]*\s+[a-z]"),
    ("certification", "Certifications", r"\biso\b|\bcmmi\b|certificat(?:e|ion)s?\b(?![^.]{0,20}engineer)"),
    ("oem_authorisation", "OEM authorisation", r"authori[sz]ation form|\bmaf\b|authori[sz]ed (?:partner|dealer|distributor|reseller)|original equipment manufacturer"),
    ("engineers", "Technical manpower", r"\d+\s+(?:oem[- ])?(?:certified|qualified|trained)\s+(?:engineers|professionals|staff)"),
    ("local_content", "Make in India local content", r"local supplier|local content|make in india"),
    ("local_presence", "Local office / service centre", r"(?:office|service cent(?:re|er)|branch|support cent(?:re|er))\s+(?:or [a-z ]+ )?(?:in|at|within)\b"),
    ("blacklisting", "Not blacklisted", r"blacklist|debar|ineligib\w*|banned|fraudulent"),
    ("experience_years", "Years in business",
     r"(?:in (?:existence|operation|business)|operating|experience)[^.]{0,60}?(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten|fifteen|twenty)\s+years"),
    ("registration", "Registration", r"registered under|companies act|partnership|gst registration|\bpan\b|incorporat"),
    ("msme", "MSE registration", r"udyam|nsic|\bmses?\b|msme"),
]
#: Products by the words that name them, sectors by their cues; fixed values.
PRODUCTS = [
    ("laptop", r"laptop|notebook"), ("desktop", r"desktop|computer|pc"), ("server", r"server"), ("network_switch", r"switch"), ("printer", r"printer"), ("monitor", r"monitor"),
    ("wireless", r"access point"), ("power", r"ups"),
]
SECTORS = [("education", r"universit|college|educational|school|academic"), ("government", r"government|\bpsu\b|public sector|municipal|state|central"), ("healthcare", r"hospital|health")]
#: Forms of the parameters; fixed values.
WINDOW = r"(?:last|preceding|past|previous)\s+(\w+)\s+(?:financial\s+)?years"
EACH_YEAR, FINANCIAL_YEAR = r"each (?:of the )?(?:last|preceding|financial)", r"20(\d{2})-(\d{2})"
SEGMENT_SHARE = r"of which[^.]*?(\d{1,3})\s*%[^.]*?(?:from|in)\s+([a-z ]{3,40})"
SEGMENT_SUPPLY = r"from\s+(?:the\s+)?((?:supply|sale|trading) of [a-z ]{3,40}?)(?=\s+in\b|\s+during\b|[.,;(]|$)"
SEGMENT_BUSINESS = r"from\s+((?:it|ict)?\s*[a-z ]{3,40}?(?:supply|business|services|integration))"
OPTION = (r"\b(one|two|three|four|five|\d)\s+(?:similar\s+)?(?:completed\s+)?(?:works?|projects?|orders?|contracts?|supplies)[^;]*?(?:not less than|at least|minimum of|value of|each costing|costing)\s*"
          r"(?:(\d{1,3})\s*%|((?:rs\.?|inr|₹)\s*[\d][\d,]*(?:\.\d+)?\s*(?:crores?|cr\b\.?|lakhs?|lacs?)?))")
SUPPLIED = r"supplied\s+(?:at least|a minimum of|not less than|minimum)?\s*(\d[\d,]*)\s+([a-z ]{3,30})"
STANDARD = r"iso\s*/?\s*(?:iec\s*)?(\d{4,5}(?:-\d)?)(?::\s*(\d{4}))?|cmmi\s*(?:level|l|ml)?\s*(\d)"
MANPOWER, RADIUS = r"(\d+)\s+(?:oem[- ])?(?:certified|qualified|trained)", r"within\s+(\d+)\s*km"
EXPERIENCE = r"(?:at least|minimum(?: of)?|not less than|min\.?)?\s*(\w+)\s+years"
#: What makes a row a criterion, what only announces criteria, and the columns of a table of criteria; fixed values.
DEMAND, ANNOUNCED = r"\b(shall|must|should|required|minimum|at least|not less than|only)\b", r"following\s+(?:[\w-]+\s+)?(?:criteria|conditions)|criteria (?:given|listed) below"
CRITERION_COLUMN, PROOF_COLUMN = r"criteri|requirement|eligib|condition|particular", r"document|proof|evidence|submitted"


def criterion_params(kind: Column, t: Column) -> Column:
    """The typed parameters of a criterion; those that its kind does not have are null."""
    of = lambda *kinds: kind.isin(*kinds)
    when = lambda value, *kinds: F.when(of(*kinds), value)
    window = _number(_take(t, WINDOW))
    default = F.when(of("similar_works"), 7).when(of("turnover", "supplied_quantity"), 3)
    years = F.when(default.isNotNull(), F.coalesce(F.nullif(window, F.lit(0)), default)).when(of("experience_years"), _number(_take(t, EXPERIENCE)))
    share = _take(t, SEGMENT_SHARE).cast("double")
    segment = F.trim(F.coalesce(_take(t, SEGMENT_SHARE, 2), _take(t, SEGMENT_SUPPLY), _take(t, SEGMENT_BUSINESS)))
    option = lambda m: F.struct(_number(_take(m, OPTION)).alias("count"), _take(m, OPTION, 2).cast("double").alias("pct_of_estimate"), parse_inr(_take(m, OPTION, 3)).alias("value"))
    standard = lambda m: F.when(_take(m, STANDARD).isNotNull(), F.concat(F.lit("ISO "), _take(m, STANDARD))).otherwise(F.concat(F.lit("CMMI Level "), _take(m, STANDARD, 3)))
    item = F.lower(_take(t, SUPPLIED, 2))
    return F.struct(
        when(parse_inr(t), "turnover", "net_worth").alias("amount"), years.cast("int").alias("years"),
        when(F.when(_says(t, EACH_YEAR), "each year").otherwise("average"), "turnover").alias("basis"),
        when(F.regexp_extract_all(t, F.lit(FINANCIAL_YEAR), F.lit(0)), "turnover").alias("financial_years"),
        when(share, "turnover").alias("segment_share_pct"), when(segment, "turnover").alias("segment"), when(_says(t, "positive"), "net_worth").alias("positive"),
        when(_every(t, OPTION, option), "similar_works").alias("options"),
        when(F.array_compact(F.array(*(F.when(_says(t, p), F.lit(s)) for s, p in SECTORS))), "similar_works", "supplied_quantity").alias("sectors"),
        when(F.regexp_replace(_take(t, SUPPLIED), ",", "").cast("long"), "supplied_quantity").alias("quantity"),
        when(F.trim(F.get(F.split(item, " to "), F.lit(0))), "supplied_quantity").alias("item"), when(first_match(item, PRODUCTS), "supplied_quantity").alias("category"),
        when(F.array_distinct(_every(t, STANDARD, standard)), "certification").alias("standards"), when(_take(t, MANPOWER).cast("int"), "engineers").alias("count"),
        when(_take(t, RADIUS).cast("int"), "local_presence").alias("radius_km"))


def extract_eligibility(units: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """``doc_id, id, pos, kind, label, text, documents, params, places``: the criteria of eligibility sections (TX23).

    A table row speaks by the column that its header names for criteria and
    lists the documents of its proof column. ``gazetteer`` (alias, place) names
    the places of local presence, in the order of the text.
    """
    held = F.coalesce(F.size("cells"), F.lit(0)) > 0
    table = (F.col("source") == "table") & held & (F.coalesce(F.size("header"), F.lit(0)) > 0)
    column = lambda p: F.array_position(F.transform("header", lambda h: _says(h, p)), True)
    rows = units.where("kind = 'eligibility'").withColumn("_c", F.when(table, column(CRITERION_COLUMN))).withColumn("_p", F.when(table, column(PROOF_COLUMN)))
    rows = rows.where(~table | ((F.col("_c") > 0) & (F.col("_c") <= F.size("cells")) & ~F.coalesce(F.col("cells") == F.col("header"), F.lit(False))))
    cell = lambda at: F.when(at > 0, F.get("cells", at.cast("int") - 1))
    rows = rows.select("doc_id", "pos", F.when(table, cell(F.col("_c"))).otherwise(F.col("text")).alias("text"), F.when(table, cell(F.col("_p"))).alias("documents"))
    t = F.col("text")
    rows = rows.where((F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) >= 5) & _says(t, DEMAND) & ~_says(t, ANNOUNCED))
    which = first_match(t, [(str(i), f"(?i){r[2]}") for i, r in enumerate(CRITERIA)], str(len(CRITERIA))).cast("int")
    # Written once: parameters and places read the kind without matching its cues again.
    rows = stored(rows.withColumn("_k", which), "criteria")
    pick = lambda k: F.get(F.array(*(F.lit(r[k]) for r in (*CRITERIA, ("other", "Other requirement")))), F.col("_k"))
    named_kind = rows.withColumn("kind", pick(0)).withColumn("label", pick(1))
    local = named_kind.where(F.col("_k") == [r[0] for r in CRITERIA].index("local_presence")).select(F.struct("doc_id", "pos").alias("doc_id"), "text")
    rows = named_kind.withColumn("params", criterion_params(F.col("kind"), t)).drop("_k")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    rows = rows.withColumn("id", F.concat(F.lit("EC"), F.lpad(number.cast("string"), 2, "0")))
    if gazetteer is None:
        rows = rows.withColumn("places", F.lit(None).cast("array<string>"))
    else:
        named = find_places(local, gazetteer).groupBy("doc_id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("pos", "place"))), lambda x: x["place"])).alias("places"))
        named = named.select(F.col("doc_id.doc_id").alias("_d"), F.col("doc_id.pos").alias("_at"), "places").hint("merge")
        rows = rows.join(named, (F.col("doc_id") == F.col("_d")) & (F.col("pos") == F.col("_at")), "left")
    return rows.select("doc_id", "id", "pos", "kind", "label", "text", "documents", "params", "places")
