"""Folding, tokens, stems, n-grams, shapes, clauses."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Latin letters with marks and their plain letters; fixed values.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿāăąćčďēĕėęěğģīĭįłńņňōŏőŕřśşšţťūŭůűųźżž"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyaaaccdeeeeeggiiilnnnooorrsssttuuuuuzzz"
#: Suffix rules in order; fixed values.
SUFFIXES = (
    ("ational", "ate"), ("ization", "ize"), ("ations", "ate"), ("ation", "ate"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("ments", "ment"), ("ities", "ity"), ("ness", ""), ("ings", ""), ("ing", ""), ("ies", "y"), ("sses", "ss"), ("ed", ""), ("es", ""), ("s", ""),
)
#: Units that are split off a number; fixed values.
GLUED_UNITS = ("gb", "tb", "mb", "w", "va", "kva", "m", "mm", "in", "u", "hz", "ghz")
#: Words that carry no meaning in search; fixed values.
STOPWORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during "
    "each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor "
    "not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there "
    "these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours yourself "
    "yourselves shall may must please kindly herewith hereby per via etc"
).split()
#: A sign that never occurs in text, used as a separator.
CUT = "\x1e"


def fold(s: Column) -> Column:
    """Lower case without the marks of Latin letters."""
    return F.translate(F.lower(s), ACCENTED, PLAIN)


@F.pandas_udf(T.StringType())
def fold_full(s: pd.Series) -> pd.Series:
    """Lower case without any combining marks, for all scripts."""
    return s.str.lower().str.normalize("NFKD").str.replace(r"[̀-ͯ]", "", regex=True)


#: Typographic signs and their plain forms; fixed values.
TYPOGRAPHIC, TYPED = "\u2018\u2019\u201c\u201d\u2013\u2014\u2212\u00d7", "''\"\"---x"


@F.pandas_udf(T.StringType())
def compatible(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition (NFKC), which Spark has no function for."""
    return s.str.normalize("NFKC")


def normalize(s: Column) -> Column:
    """Compatible and plain signs; gaps of three blanks or more inside a line become tabs, other blanks shrink, lines are trimmed."""
    t = F.translate(F.when(s.rlike(r"[^\x00-\x7f]"), compatible(s)).otherwise(s), TYPOGRAPHIC, TYPED)
    t = F.regexp_replace(t, r"(?<=\S) {3,}(?=\S)", "\t")
    t = F.regexp_replace(t, r"[ \r\f\x0B]+", " ")
    t = F.regexp_replace(t, r"[ \t]*\t[ \t]*", "\t")
    return F.btrim(F.regexp_replace(t, r"[ \t]*\n[ \t]*", "\n"), F.lit(" \t\n"))


def stem(token: Column) -> Column:
    """Strip the first fitting suffix; short words and words with digits stay."""
    size = F.length(token)
    out = token
    for suffix, new in reversed(SUFFIXES):
        base = F.concat(F.expr("substring('x', 2, 1)"), F.left(token, size - len(suffix)), F.lit(new))
        if suffix in ("ing", "ed"):
            tail = F.right(base, F.lit(1))
            twice = (F.length(base) >= 4) & (tail == F.substring(base, -2, 1)) & ~tail.isin("l", "s", "z")
            base = F.when(twice, F.left(base, F.length(base) - 1)).otherwise(base)
        if suffix == "s":
            base = F.when(token.rlike("(ss|us|is)$"), token).otherwise(base)
        out = F.when(token.endswith(suffix) & (size - len(suffix) >= 3), base).otherwise(out)
    return F.when((size <= 3) | token.rlike(r"\d"), token).otherwise(out)


def tokens(s: Column, stopwords: bool = True, stemmed: bool = False) -> Column:
    """Folded tokens; compounds give themselves and their parts, numbers with units are split."""
    raw = F.regexp_extract_all(fold(s), F.lit(r"[a-z0-9]+(?:[./-][a-z0-9]+)*"), F.lit(0))
    glued = rf"^(\d+(?:\.\d+)?)({'|'.join(GLUED_UNITS)})$"

    def parts(t: Column) -> Column:
        return F.when(t.rlike(glued), F.array(F.regexp_extract(t, glued, 1), F.regexp_extract(t, glued, 2))).when(
            t.rlike("[/-]"), F.concat(F.array(t), F.split(t, "[/-]"))).otherwise(F.array(t))

    out = F.filter(F.flatten(F.transform(raw, parts)), lambda t: t != "")
    if stopwords:
        out = F.filter(out, lambda t: ~t.isin(*STOPWORDS))
    return F.transform(out, stem) if stemmed else out


def analyze(s: Column) -> Column:
    return tokens(s, True, True)


def ngrams(words: Column) -> Column:
    """The words and their neighbours joined by an underscore."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws("_", a, b))
    return F.concat(words, F.when(n > 1, pairs).otherwise(F.array().cast("array<string>")))


def char_ngrams(s: Column, low: int, high: int) -> Column:
    """Grams of ``low`` to ``high`` characters of each word, padded with a space at both ends."""
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")

    def of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)
        sizes = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda k: k <= size)
        return F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.substring(padded, i, k))))

    return F.flatten(F.transform(words, of))


def line_shape(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), r"\s+", " "), r"\d+", "#")


def dehyphenate(lines: Column) -> Column:
    """Join lines; a hyphen at a line's end goes before a lower-case letter."""
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"-\n(?=[a-z])", ""), r"\n", " ")


def sentences(s: Column) -> Column:
    """Split after .!?; before a capital, digit, bracket or quote, at blank lines and before bullets; at least three characters."""
    t = F.regexp_replace(s, r"([.!?;])\s+(?=[A-Z0-9(\"'])", f"$1{CUT}")
    t = F.regexp_replace(t, r"\n{2,}", CUT)
    t = F.regexp_replace(t, r"\n(\s*(?:[-*•▪◦]|\d+[.)])\s)", f"{CUT}$1")
    trimmed = F.transform(F.split(t, CUT), lambda x: F.btrim(x, F.lit(" \n-*•▪◦")))
    return F.transform(F.filter(trimmed, lambda x: F.length(x) >= 3), lambda x: F.regexp_replace(x, r"\s*\n\s*", " "))


#: Clause strength and actor patterns; fixed values.
INFORMATION_RULE = (
    r"(?i)reserves? the right|at (?:its|their) (?:sole )?discretion|hereinafter referred|is (?:hereby )?invit|purchase preference|"
    r"following (?:criteria|conditions)|are given below|as detailed below")
DESIRABLE_RULE = (
    r"(?i)\b(preferabl[ey]|preferred|desirable|preference will be given|is encouraged|optional|advantage|additional marks|"
    r"may (?:also )?(?:offer|propose|quote|include))\b")
PROHIBIT_RULE = (
    r"(?i)\b(?:shall|must|will|should|may)\s+not\b|\bnot (?:be )?(?:permitted|allowed|accepted|entertained|considered)\b|\bare not permitted\b|\bis not allowed\b|"
    r"^\s*no\s+[a-z -]{1,40}\s+(?:will|shall) be (?:allowed|made|accepted|entertained|paid)")
MANDATORY_RULE = (
    r"(?i)\b(shall|must|is required to|are required to|required to|will be required|mandatory|has to|have to|needs? to|should|is to be|are to be|"
    r"will be (?:levied|forfeited|rejected|treated))\b")
BUYER_RULE = (
    r"(?i)^\s*(?:\(?[a-z0-9.]{1,6}\)?\s+)?(?:the\s+)?(purchaser|buyer|university|corporation|department|authority|institute|client|owner|employer|committee|"
    r"tender inviting authority|competent authority|hospital|council|board|ministry|government|we|our)\b")
POSSESSIVE = "(?!'s)"


def modality(s: Column) -> Column:
    """``struct(strength, actor)`` of a clause: who must do what, and how strongly.

    Information goes first, then what is desirable, then what must or must not
    be done. A clause that begins with the buyer is the buyer's, unless bidder
    or supplier is among its first eight words.
    """
    head = fold(F.array_join(F.slice(F.split(F.btrim(s), r"\s+"), 1, 8), " "))
    buyer = s.rlike(BUYER_RULE + POSSESSIVE) & ~head.contains("bidder") & ~head.contains("supplier")
    informs, wishes, binds = s.rlike(INFORMATION_RULE), s.rlike(DESIRABLE_RULE), s.rlike(PROHIBIT_RULE) | s.rlike(MANDATORY_RULE)
    strength = F.when(informs, "information").when(wishes, "desirable").when(binds, "mandatory").otherwise("information")
    own = informs | (buyer & ~(wishes & F.lower(s).contains("preference")))
    return F.struct(strength.alias("strength"), F.when(own, "buyer").otherwise("bidder").alias("actor"))


#: Section kinds and clause types with their categories, and the words of a category in order; fixed values.
KIND_CATEGORY = {
    "eligibility": "eligibility", "technical": "technical", "boq": "technical", "conditions": "legal", "evaluation": "evaluation", "instructions": "submission",
    "notice": "submission", "forms": "submission",
}
CLAUSE_TYPE_CATEGORY = {
    "delivery": "delivery", "payment": "commercial", "warranty_support": "warranty", "compliance": "standards", "submission": "submission", "evaluation": "evaluation",
    "scope": "scope", "line_item": "technical",
}
DECISIVE_KINDS, FALLBACK_KINDS = ("eligibility", "technical", "boq", "evaluation", "forms"), ("instructions", "notice", "conditions")
CLAUSE_RULES = [
    ("commercial", r"liquidated damages|performance (?:security|bank guarantee)|\bemd\b|earnest money|price variation|prices? (?:shall|will) be firm|\bgst\b|advance (?:payment|bank guarantee)|\bpayment"),
    ("standards", r"\biso\b|certif(?:ied|ication)|e-waste|energy star|epeat|\bbis\b|data protection|dpdp|gdpr"),
    ("warranty", r"\bwarrant|helpdesk|help desk|complaints?\b|standby|response time|resolved within|responded to within|onsite engineer|resident engineer|support\b"),
]
DELIVERY_RULE, DELIVERY_TYPES = r"\bdeliver(?:y|ed)?\b|commission|install", ("delivery", "scope", "line_item")
#: Least confidence of the clause classifier; fixed value.
CLAUSE_CONFIDENCE = 0.45


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def clause_category(s: Column, kind: Column, clause_type: Column, confidence: Column, long_form: Column) -> Column:
    """Category of a clause (F31): by decisive sections of long documents, commercial, standards and warranty words, other sections, delivery words, the clause type.

    Null kinds and types count as unknown.
    """
    from bidframe.functions.scalars import first_match

    low = fold(s)
    by_words = first_match(low, CLAUSE_RULES)
    by_type = F.when(confidence >= CLAUSE_CONFIDENCE, F.coalesce(_looked_up(CLAUSE_TYPE_CATEGORY, clause_type), F.lit("scope")))
    return F.when(long_form & kind.isin(*DECISIVE_KINDS), _looked_up(KIND_CATEGORY, kind)).when(by_words.isNotNull(), by_words).when(
        long_form & kind.isin(*FALLBACK_KINDS), _looked_up(KIND_CATEGORY, kind)).when(low.rlike(DELIVERY_RULE) & clause_type.isin(*DELIVERY_TYPES), "delivery").otherwise(F.coalesce(by_type, F.lit("scope")))


#: Product words by category; fixed values.
CATEGORY_WORDS = [
    ("component", r"graphics card|gpu|motherboard"), ("power", r"\bups\b|power"), ("peripheral", r"keyboard|mice|mouse|webcam"),
    ("audio", r"headset|speaker|audio"), ("laptop", r"laptop|notebook"), ("monitor", r"monitor|display"),
]
_DURATION = r"(\d+|one|two|three|four|five|six)\s*[- ]?(years?|months?)"


def warranty_months(s: Column) -> Column:
    """The first duration of the text in months."""
    t = F.lower(s)
    number, unit = F.regexp_extract(t, _DURATION, 1), F.regexp_extract(t, _DURATION, 2)
    words = F.create_map(*(F.lit(x) for k, w in enumerate(("one", "two", "three", "four", "five", "six"), 1) for x in (w, k)))
    n = F.coalesce(number.try_cast("int"), F.try_element_at(words, number))
    return F.when(number != "", n * F.when(unit.startswith("year"), 12).otherwise(1))


def warranty_by_category(s: Column) -> Column:
    """Map of category to months: the text is cut after each duration, categories named in a piece get its duration."""
    pieces = F.split(F.regexp_replace(F.lower(s), rf"({_DURATION})", f"$1{CUT}"), CUT)
    entries = F.flatten(F.transform(pieces, lambda p: F.array_compact(F.array(*(
        F.when(p.rlike(words) & warranty_months(p).isNotNull(), F.struct(F.lit(c).alias("key"), warranty_months(p).alias("value"))) for c, words in CATEGORY_WORDS)))))
    first = F.aggregate(entries, F.array().cast("array<struct<key:string,value:int>>"),
                        lambda acc, e: F.when(F.exists(acc, lambda x: x["key"] == e["key"]), acc).otherwise(F.concat(acc, F.array(e))))
    return F.map_from_entries(first)


#: Words of a business segment that stand for others, and words without weight; fixed values.
SEGMENT_SYNONYMS = {
    "computer": "it", "computers": "it", "ict": "it", "information": "it", "hardware": "hardware", "sale": "supply", "sales": "supply", "trading": "supply", "supplies": "supply",
}
SEGMENT_STOP = ("of", "the", "and", "from", "in", "for", "technology", "products", "equipment")


def same_segment(asked: Column, held: Column) -> Column:
    """Sets of words after synonyms: one contains the other, or they share two words; nothing asked for is never the same."""

    def words(s: Column) -> Column:
        kept = F.filter(F.regexp_extract_all(F.lower(s), F.lit("[a-z]+"), F.lit(0)), lambda w: ~w.isin(*SEGMENT_STOP))
        return F.array_distinct(F.transform(kept, lambda w: F.coalesce(_looked_up(SEGMENT_SYNONYMS, w), w)))

    a, b = words(asked), words(held)
    shared = F.size(F.array_intersect(a, b))
    return (F.size(a) > 0) & ((shared == F.size(a)) | (shared == F.size(b)) | (shared >= 2))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
