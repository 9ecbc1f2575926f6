"""Units of a tender and the clause-by-clause compliance matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidframe.functions.scalars import parse_number_words
from bidframe.functions.text import fold, sentences, warranty_by_category, warranty_months
from bidframe.operators.compliance import matrix_requirements

# Lines that are fields, addresses and titles; clause numbers; row serials; roles of table headers.
FIELD_LINE = (
    r"(?i)^\s*(?:date(?: of issue)?|dated|issued(?: on)?|release date|subject|title|re|contact(?: person)?|attn\.?|from|to|gstin|trn|vat(?: id| no\.?)?|abn|uen|tel(?:ephone)?|"
    r"phone|e-?mail|page \d+|(?:rfp|rfq|rft|tender|bid|enquiry|inquiry)\s*(?:no\.?|number|ref(?:erence)?\.?|id|#))\s*[:\-–#]")
ADDRESS_WORDS = (
    r"(?i)\b(road|rd\.|street|st\.|avenue|ave\.?|lane|boulevard|blvd|floor|suite|building|tower [a-z]|stra(?:ss|ß)e|industriestra\w+|free zone|p\.?\s?o\.? box|survey no\.?|"
    r"plot no\.?|sector \d+)\b")
POSTCODE = r"\b(?:\d{6}|\d{5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}|\d{4})\b"
TITLE_WORDS = r"(?i)\b(request for (?:proposal|quotation|quote|tender|bid)s?|^rf[pqt]\b)"
CLAUSE_NUMBER = r"^\s*(\d{1,2}(?:\.\d{1,2}){1,4})\.?(?:\s+|(?=[A-Z]))"
SERIAL = r"^(?:\d{1,3}\.?|[a-z]\)?)$"
PARAMETER_HEADER, CRITERION_HEADER = r"(?i)parameter|specification|feature|attribute", r"(?i)criteri|eligib|requirement|condition"
#: Sizes of texts that are split and of lines that may be addresses or titles; fixed values.
SPLIT_FROM, ADDRESS_BELOW, TITLE_BELOW, SHORTEST = 180, 140, 160, 4


def build_units(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """``doc_id, pos, part, text, section, kind, page, clause, source``: sentences, fields and table rows of a tender (TX26).

    ``blocks``: doc_id, pos, page, kind (``text`` or ``row``), text, table_no,
    cells, owner, is_heading; ``sections``: doc_id, section, kind, number.
    Headings and the first row of a table, its header, give no unit. Texts of
    180 characters and more are split into sentences; address and title lines
    go. A row is worded by its header: parameter and value, or the criterion.
    """
    known = sections.select("doc_id", F.col("section").alias("owner"), F.col("kind").alias("_kind"), "number")
    rows = blocks.where(~F.col("is_heading")).join(known.hint("merge"), ["doc_id", "owner"], "left").withColumn("_kind", F.coalesce("_kind", F.lit("general")))
    w = Window.partitionBy("doc_id", "table_no").orderBy("pos")
    tabled = rows.where("kind = 'row' AND table_no IS NOT NULL").withColumn("_header", F.first("cells").over(w)).withColumn("_n", F.row_number().over(w)).where("_n > 1")
    first = F.get("cells", F.lit(0))
    serial = F.when(first.rlike(SERIAL), first)
    named = F.filter("cells", lambda c: (c != "") & ~c.eqNullSafe(serial))
    header = F.array_join("_header", " ")
    joined = F.array_join(F.filter("cells", lambda c: c != ""), " | ")
    criterion = F.get("cells", F.get(F.filter(F.transform("_header", lambda c, i: F.when(c.rlike(CRITERION_HEADER), i)), lambda i: i.isNotNull()), F.lit(0)))
    worded = F.when(header.rlike(PARAMETER_HEADER) & (F.size("cells") >= 2), F.when(F.size(named) >= 2, F.concat(F.get(named, F.lit(0)), F.lit(": "), F.array_join(F.slice(named, F.lit(2), F.size(named)), " "))).otherwise(joined)).when(
        header.rlike(CRITERION_HEADER) & (criterion != ""), criterion).otherwise(joined)
    clause = F.when(F.col("number").isNotNull() & serial.isNotNull(), F.concat(F.col("number"), F.lit(" ("), F.rtrim(serial, F.lit(".")), F.lit(")"))).otherwise(F.col("number"))
    a = tabled.select("doc_id", "pos", F.lit(0).alias("part"), worded.alias("text"), F.col("owner").alias("section"), F.col("_kind").alias("kind"), "page", clause.alias("clause"), F.lit("table").alias("source"))

    plain = F.translate("text", "\t", " ")
    own = F.nullif(F.regexp_extract(plain, CLAUSE_NUMBER, 1), F.lit(""))
    said = F.trim(F.when(own.isNotNull(), F.regexp_replace(plain, CLAUSE_NUMBER, "")).otherwise(plain))
    free = rows.where("kind <> 'row' OR table_no IS NULL").withColumn("_clause", F.coalesce(own, F.col("number"))).withColumn("_said", said)
    pieces = F.when(F.length(plain) >= SPLIT_FROM, sentences(F.col("_said"))).otherwise(F.array("_said"))
    free = free.select("doc_id", "pos", "owner", "_kind", "page", "_clause", F.posexplode(pieces).alias("part", "piece")).withColumn("piece", F.trim("piece"))
    size, piece = F.length("piece"), F.col("piece")
    is_field = piece.rlike(FIELD_LINE)
    is_address = piece.rlike(ADDRESS_WORDS) & (piece.rlike(POSTCODE) | piece.contains(",")) & (size < ADDRESS_BELOW)
    is_title = piece.rlike(TITLE_WORDS) & (size < TITLE_BELOW)
    free = free.where((size >= SHORTEST) & (is_field | ~(is_address | is_title)))
    b = free.select("doc_id", "pos", "part", piece.alias("text"), F.col("owner").alias("section"), F.col("_kind").alias("kind"), "page", F.col("_clause").alias("clause"), F.when(is_field, "field").otherwise("text").alias("source"))
    return a.unionByName(b)


def same_market(supplier_country: Column, client_country: Column, market: str) -> Column:
    """Supplier and client are both of the market."""
    return F.coalesce((supplier_country == market) & (client_country == market), F.lit(False))


def typed_specs(specs: Column) -> Column:
    """Numbers and classes of a map of specifications (F33); null where a key is missing or no number."""
    at = lambda k: F.try_element_at(specs, F.lit(k))
    number = lambda k: at(k).try_cast("double")
    low = lambda k: fold(F.coalesce(at(k), F.lit("")))
    cut = lambda s, p: F.nullif(F.regexp_extract(s, p, 1), F.lit(""))
    cpu, form, size = low("cpu"), F.lower(F.coalesce(at("form_factor"), F.lit(""))), at("resolution")
    tier = F.coalesce(F.coalesce(cut(cpu, r"\bi([3579])\b"), cut(cpu, r"i([3579])-"), cut(cpu, r"ultra ([579])")).cast("int"), F.when(cpu.contains("apple m"), 7))
    units = cut(form, r"\b([124])u\b")
    return F.struct(
        *(number(k).alias(k) for k in ("ram_gb", "storage_gb", "screen_in", "ports", "capacity_va", "bays", "vram_gb", "dpi", "throughput_gbps", "ppm")), at("poe").alias("poe"), at("wifi").alias("wifi"),
        F.when(size.startswith("3840"), "4K").when(size.startswith("1920"), "FHD").otherwise(F.nullif(size, F.lit(""))).alias("resolution"), tier.alias("cpu_tier"), F.when(cpu.contains("xeon"), "xeon").alias("cpu_family"),
        F.when(at("topology").contains("online"), "online").otherwise(at("topology")).alias("topology"), cut(low("uplinks"), r"(\d+)\s*g").cast("int").alias("uplink_gbps"),
        F.when(units.isNotNull(), F.concat(units, F.lit("U"))).when(form.contains("tower"), "tower").otherwise(F.nullif(form, F.lit(""))).alias("form_factor"))


def semi_search(products: DataFrame, hits: DataFrame) -> DataFrame:
    """Products among a search's hits with their ``score`` and ``position``, best first (J22). Hits: sku, score."""
    w = Window.orderBy(F.desc("score"), "sku")  # as many rows as a search returns
    return products.join(hits.select("sku", "score"), "sku").withColumn("position", F.row_number().over(w))


def recent(batches: DataFrame, n: int = 50) -> DataFrame:
    """The latest ``n`` import batches."""
    return batches.orderBy(F.desc("id")).limit(n)


def tax_rules_sorted(rules: DataFrame) -> DataFrame:
    """Rules by country and region, null regions first."""
    return rules.orderBy("country", F.asc_nulls_first("region"), "rule_no")


def except_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` whose keys ``b`` lacks (U7); null keys are equal."""
    other = b.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return a.join(other, condition, "left_anti")


# ---- compliance matrix

#: Names of standards; what they are compared by lacks blanks, strokes and IEC; fixed values.
STANDARD_NAMES = r"(?i)(iso\s*/?\s*(?:iec\s*)?\d{4,5}(?:-\d)?|gdpr|dpdp|soc ?2|energy star|epeat|\bbis\b|rohs|ce marking|ukca|e-waste)"
MATRIX_STATUS = {"Meets": "Complies", "Documents required": "Complies with note", "Needs review": "Complies with note", "Does not meet": "Deviation"}
#: Days a small supplier must be paid in, and the largest share of liquidated damages; fixed values.
PAYMENT_DAYS, DAMAGES_CAP = 45, 10.0
NOT_HARDWARE = ("software", "service", "cabling")
# What a clause speaks of, in the order of the rules below.
WITHIN = r"(?i)within\s+(\d+|one|two|three|four|five|six|seven|eight|nine|ten|twelve)\s+(business days|working days|days|weeks|months)"
ABOUT_SUPPLY, NOT_SUPPLY, INSTALLS = r"(?i)\bdeliver|\bsuppl(?:y|ied)\b|complet|install|commission|go[- ]live", r"(?i)survey|submit|furnish|report|plan\b", r"(?i)install|commission"
RESPONSE, HOURS, STANDBY = r"(?i)attend|respon|report", r"(?i)within\s+(\d+)\s*(?:hours|hrs)", r"(?i)standby|replacement unit"
ROUND_THE_CLOCK, RESIDENT = r"(?i)24\s*[x×/]\s*7|round the clock|24 hours a day", r"(?i)resident engineer|onsite engineer|on-site engineer|dedicated (?:onsite )?engineer"
PAID_WITHIN = r"(?i)within\s+(\d+)\s+days[^.]*invoice|payment[^.]*within\s+(\d+)\s+days"
DAMAGES, DAMAGES_CAPPED = r"(?i)liquidated damages", r"(?i)(\d(?:\.\d+)?)\s*%[^.]{0,80}?(week|day|month)[^.]*?maximum (?:of )?(\d{1,2})\s*%"
SECURITY = r"(?i)performance (?:security|bank guarantee|guarantee)[^.%]{0,60}?(\d{1,2}(?:\.\d+)?)\s*%"
DEPOSIT, DEPOSIT_RULE = r"(?i)\bemd\b|earnest money|bid security", r"(?i)forfeit|refund|exempt"
ADVANCE, GUARANTEE, FIRM_PRICE = r"(?i)advance", r"(?i)bank guarantee", r"(?i)firm|fixed|no price variation|price variation"
UNLIMITED, INDEMNITY, CONVENIENCE = r"(?i)unlimited liability", r"(?i)indemnif", r"(?i)terminat\w* for convenience|terminate the contract for convenience"
PRIVACY, SUBCONTRACT = r"(?i)data protection|dpdp|personal data", r"(?i)sub-?contract"
WARRANTY_ROW, SYSTEM_ROW, WARRANTY_WORD = r"(?i)^\s*warranty", r"(?i)^\s*(operating system|os)\b", r"(?i)warrant"
OFFERED_SYSTEM, EDITION, EDITION_ASKED = "windows 11", "pro", "professional"


def standard_keys(s: Column) -> Column:
    """Standards named in a text, in order, as they are compared."""
    return F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(STANDARD_NAMES), F.lit(1)), lambda x: F.regexp_replace(F.lower(x), r"[\s/]|iec", "")))


def days_within(s: Column) -> Column:
    """Days of "within n days, weeks or months"; null without."""
    unit = F.lower(F.regexp_extract(s, WITHIN, 2))
    return (parse_number_words(F.regexp_extract(s, WITHIN, 1)) * F.when(unit == "weeks", 7).when(unit == "months", 30).otherwise(1)).cast("int")


def _answer(status: str, basis: str, severity: str | None = None, risk: str | None = None) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(basis).alias("basis"), F.lit(severity).cast("string").alias("severity"), F.lit(risk).cast("string").alias("risk"))


def _delivery(t: Column, otherwise: Column) -> Column:
    supply = t.rlike(ABOUT_SUPPLY) & ~t.rlike(NOT_SUPPLY)
    need = F.when(supply, days_within(t))
    done = F.coalesce("lead_time_days", F.lit(0)) + F.when(F.col("domestic"), 2).otherwise(6) + F.when(t.rlike(INSTALLS), 5).otherwise(0)
    basis = "Lead times, transit and installation"
    return F.when(F.coalesce(need, F.lit(0)) == 0, otherwise).when(done <= need, _answer("Complies", basis)).when(done <= need * 1.5, _answer("Complies with note", basis)).otherwise(_answer("Deviation", basis))


def _warranty(t: Column, otherwise: Column) -> Column:
    need = F.when(t.rlike(WARRANTY_WORD), warranty_months(t))
    per = warranty_by_category(t)
    hardware = F.filter("lines", lambda x: ~x["category"].isin(*NOT_HARDWARE) & ((F.size(per) == 0) | F.map_contains_key(per, x["category"])))
    met = lambda x: x["warranty_months"] >= F.coalesce(F.try_element_at(per, x["category"]), need)
    basis = "Warranty quoted for each line"
    terms = F.when(F.exists(hardware, lambda x: ~met(x)), _answer("Deviation", basis)).when(F.exists(hardware, lambda x: x["extended"] & met(x)), _answer("Complies with note", basis)).otherwise(_answer("Complies", basis))
    hours = F.when(t.rlike(RESPONSE), F.regexp_extract(t, HOURS, 1).try_cast("int"))
    near = F.col("client_city").isNull() | F.col("has_office")
    support = "Support levels of the company"
    return F.when(need > 0, terms).when(t.rlike(STANDBY), _answer("Complies", "Support model")).when(
        t.rlike(ROUND_THE_CLOCK), F.when(F.col("helpdesk_24x7"), _answer("Complies", support)).otherwise(_answer("Complies with note", support, "medium", "24x7 helpdesk commitment"))).when(
        hours.isNotNull(), F.when((hours >= F.col("response_hours")) & near, _answer("Complies", support)).otherwise(_answer("Complies with note", support, "medium", "On-site response obligation"))).when(
        t.rlike(RESIDENT), _answer("Complies with note", "Manpower commitment", "low", "Resident engineer")).otherwise(otherwise)


def _standards(t: Column, held: Column, otherwise: Column) -> Column:
    asked = standard_keys(t)
    missing = F.array_except(asked, F.coalesce(held, F.array().cast("array<string>")))
    basis = "Certificates held"
    return F.when(F.size(asked) == 0, otherwise).when(F.size(missing) == 0, _answer("Complies", basis)).when(F.size(missing) < F.size(asked), _answer("Complies with note", basis)).otherwise(_answer("Clarification required", basis))


def _commercial(t: Column) -> Column:
    basis = "Commercial term accepted"
    yes, note = _answer("Complies", basis), _answer("Complies with note", basis)
    days = F.coalesce(*(F.regexp_extract(t, PAID_WITHIN, g).try_cast("int") for g in (1, 2)))
    cap = F.regexp_extract(t, DAMAGES_CAPPED, 3).try_cast("double")
    damages = F.when(cap.isNull(), yes).when(cap > DAMAGES_CAP, _answer("Complies with note", basis, "high", "Liquidated damages")).otherwise(_answer("Complies with note", basis, "low", "Liquidated damages"))
    late = _answer("Complies with note", basis, "medium", "Payment beyond 45 days")
    return F.when(days.isNotNull(), F.when((days > PAYMENT_DAYS) & F.col("small_local"), late).otherwise(yes)).when(t.rlike(DAMAGES), damages).when(
        t.rlike(SECURITY), _answer("Complies", basis, "low", "Performance security")).when(
        t.rlike(DEPOSIT) & F.col("small_local") & t.rlike(DEPOSIT_RULE), yes).when(
        t.rlike(ADVANCE) & t.rlike(GUARANTEE), note).when(t.rlike(FIRM_PRICE), note).otherwise(yes)


def _legal(t: Column, standards: Column) -> Column:
    basis = "Contract condition accepted"
    note = _answer("Complies with note", basis)
    return F.when(t.rlike(UNLIMITED), _answer("Deviation", "Liability is capped at the contract value", "high", "Unlimited liability")).when(t.rlike(INDEMNITY), note).when(
        t.rlike(CONVENIENCE), _answer("Complies with note", basis, "low", "Termination for convenience")).when(
        t.rlike(PRIVACY), standards).when(t.rlike(SUBCONTRACT), note).otherwise(_answer("Complies", basis))


def _spec_row(t: Column) -> Column:
    parameter, want = F.substring_index(t, ":", 1), F.regexp_replace(t, r"^[^:]*:?", "")
    need = F.when(parameter.rlike(WARRANTY_ROW), warranty_months(want))
    basis = "Compared with the catalogue"
    yes, note, no = (_answer(s, basis) for s in ("Complies", "Complies with note", "Deviation"))
    warranty = F.when(F.col("line_months") < need, no).when(F.col("line_extended"), note).otherwise(yes)
    offered = fold(F.col("product_os"))
    system = F.when(offered.contains(OFFERED_SYSTEM) & (offered.contains(EDITION) | ~fold(want).contains(EDITION_ASKED)), yes).otherwise(no)
    fit = F.when(F.col("failed"), no).when(F.col("fit") >= 0.99, yes).otherwise(note)
    return F.when(F.col("line_months").isNull(), _answer("Clarification required", "Not linked to a priced line")).when(need > 0, warranty).when(
        parameter.rlike(SYSTEM_ROW) & F.col("product_os").isNotNull(), system).when(F.col("fit").isNotNull(), fit).when(
        F.col("met").isNotNull(), F.when(F.col("met"), yes).otherwise(no)).otherwise(_answer("Complies with note", "Not held in the catalogue"))


def held_by_evidence(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """``bid_id, held``: the standards of each bid that the best passage of its search names.

    ``asked``: bid_id, text of the clauses; ``hits``: bid_id, standard (as
    ``standard_keys`` writes it), passage, rank of a search for each standard.
    Only the passage of rank 1 counts. A bid's array is bounded by the names of
    standards. Bids whose clauses name none, and standards without a passage,
    give no entry.
    """
    wanted = asked.select("bid_id", F.explode(standard_keys(F.col("text"))).alias("standard")).distinct()
    first = hits.where(F.col("rank") == 1).select("bid_id", "standard", F.regexp_replace(F.lower("passage"), r"[\s/]|iec", "").alias("_said"))
    named = wanted.hint("merge").join(first, ["bid_id", "standard"]).where(F.col("_said").contains(F.col("standard")))
    return named.groupBy("bid_id").agg(F.array_sort(F.collect_set("standard")).alias("held"))


def compliance_matrix(reqs: DataFrame, bids: DataFrame, lines: DataFrame, checks: DataFrame, held: list[str] | None, overrides: DataFrame) -> DataFrame:
    """``bid_id, req_id, category, strength, status, basis, severity, risk, overridden``: an answer to each bidder's clause (PR19).

    ``reqs``: bid_id, req_id, text, category, type (of a clause), strength,
    actor, source, line_no, evidenced (a passage supports the clause); fit,
    failed, met and product_os of a specification row against its product, as
    ``specs.spec_rows`` finds them. ``bids``: bid_id, long_form,
    lead_time_days, domestic, client_city, has_office, helpdesk_24x7,
    response_hours, small_local. ``lines``: bid_id, line_no, category,
    warranty_months, extended. ``checks``: bid_id, check_no, text, verdict; of
    equal texts the last counts. ``held``: standards as ``standard_keys``
    writes them, or None to read each bid's column ``held`` (see
    ``held_by_evidence``). ``overrides``: bid_id, req_id, status; they win.

    One pass over the clauses: a bid's lines are gathered once (they bound the
    array), a row's own line and check come by equi joins, and the category
    picks the rule.
    """
    t, kind = F.col("text"), F.col("category")
    told = F.col("strength") == "information"
    rows = matrix_requirements(reqs.join(bids, "bid_id"), F.col("long_form"))
    per_bid = lines.groupBy("bid_id").agg(F.collect_list(F.struct("category", "warranty_months", "extended")).alias("lines"))
    own = lines.select("bid_id", "line_no", F.col("warranty_months").alias("line_months"), F.col("extended").alias("line_extended"))
    said = checks.groupBy("bid_id", fold(F.col("text")).alias("_text")).agg(F.max_by("verdict", "check_no").alias("verdict"))
    rows = rows.join(per_bid, "bid_id", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<struct<category:string,warranty_months:int,extended:boolean>>")))
    rows = rows.join(own, ["bid_id", "line_no"], "left").withColumn("_text", fold(t)).join(said, ["bid_id", "_text"], "left")
    grounded = F.when(F.col("evidenced"), _answer("Complies", "Evidence")).when(told, _answer("Noted", "Informational clause")).otherwise(_answer("Complies", "Undertaking"))
    certified = F.col("held") if held is None else F.array(*map(F.lit, held)).cast("array<string>")
    standards = _standards(t, certified, grounded)
    by_check = F.when(F.col("verdict").isNull(), _answer("Noted", "Eligibility statement"))
    for verdict, status in MATRIX_STATUS.items():
        by_check = by_check.when(F.col("verdict") == verdict, _answer(status, "Eligibility check"))
    answer = F.when(kind == "eligibility", by_check).when((kind == "technical") & (F.col("source") == "table"), _spec_row(t)).when(
        kind == "technical", F.when(told, _answer("Noted", "Technical undertaking")).otherwise(_answer("Complies", "Technical undertaking"))).when(kind == "delivery", _delivery(t, grounded)).when(
        kind == "warranty", _warranty(t, grounded)).when(kind == "standards", standards).when(kind == "commercial", _commercial(t)).when(kind == "legal", _legal(t, standards)).when(
        kind.isin("submission", "evaluation"), _answer("Noted", "Procedural instruction")).otherwise(grounded)
    fixed = overrides.select("bid_id", "req_id", F.col("status").alias("_status"))
    out = rows.withColumn("a", answer).join(fixed, ["bid_id", "req_id"], "left")
    won = F.col("_status").isNotNull()
    return out.select("bid_id", "req_id", "category", "strength", F.coalesce("_status", "a.status").alias("status"), F.when(won, "Reviewer decision").otherwise(F.col("a.basis")).alias("basis"), "a.severity", "a.risk", won.alias("overridden"))


def matrix_risks(matrix: DataFrame) -> DataFrame:
    """Risks that the matrix raises, one a title and bid."""
    return matrix.where("risk IS NOT NULL").groupBy("bid_id", "risk").agg(F.min_by("severity", F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)).alias("severity"))
