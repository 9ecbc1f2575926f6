"""Secret scans over a trigram inverted index, native DataFrame operations only.

Every rule is a regular expression. From its syntax follows a Boolean query of
trigrams: all clauses must hold, a clause holds if all trigrams of one of its
alternatives occur. Texts are indexed by the trigrams that the rules' queries
name, lower-cased; posting lists are intersected, and only the candidates are
verified with the expression. A rule without a mandatory trigram scans fully.
"""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidframe.llm._common import written


class Rule:
    """A kind of secret: an expression, and the group that must have ``least`` characters (0: the match)."""

    def __init__(self, kind: str, regex: str, group: int = 0, least: int = 0) -> None:
        self.kind, self.regex, self.group, self.least = kind, regex, group, least
        self.clauses = trigram_query(regex)


def _cross(left: set[str], right: set[str]) -> set[str]:
    return {a + b for a in left for b in right}


def trigram_query(regex: str, most: int = 64) -> list[list[frozenset[str]]]:
    """Clauses, each a list of alternatives, each a set of trigrams; empty if no trigram is mandatory.

    ``regex`` must match only if in each clause all trigrams of some
    alternative occur in the lower-cased text.
    """
    clauses: list[list[frozenset[str]]] = []

    def flush(strings: set[str]) -> set[str]:
        grams = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)]
        if grams and all(grams):  # an alternative that asks for more than another one adds nothing
            clauses.append([g for g in dict.fromkeys(grams) if not any(other < g for other in grams)])
        return {""}

    def exact(items) -> set[str] | None:
        """All lower-cased strings that ``items`` can match, None if unknown or too many."""
        found = {""}
        for op, value in items:
            if op is sre.LITERAL:
                own = {chr(value).lower()}
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in value):
                own = {chr(v).lower() for _, v in value}
            elif op is sre.SUBPATTERN:
                own = exact(value[3])
            elif op is sre.BRANCH:
                parts = [exact(p) for p in value[1]]
                own = None if None in parts else set().union(*parts)
            elif op is sre.MAX_REPEAT and value[1] <= 1:
                own = exact(value[2])
                own = own and own | {""} if value[0] == 0 else own
            else:
                own = None
            found = own and _cross(found, own)
            if not found or len(found) > most:
                return None
        return found

    def walk(items) -> None:
        strings = {""}
        for item in items:
            own = exact([item])
            if own and len(_cross(strings, own)) <= most:
                strings = _cross(strings, own)
                continue
            strings = flush(strings)
            op, value = item
            if op is sre.SUBPATTERN:
                walk(value[3])
            elif op is sre.MAX_REPEAT and value[0] >= 1:
                walk(value[2])
        flush(strings)

    walk(_parser.parse(regex))
    return clauses


#: The three base kinds, in order, then the added ones.
BASE = 3
RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
]


def postings(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``trigram, doc_id, text_key``: a posting for each text and trigram of the rules' queries that it holds."""
    grams = sorted({g for r in rules for clause in r.clauses for alternative in clause for g in alternative})
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams))) if grams else F.array().cast("array<string>")
    return docs.withColumn("low", F.lower("text")).select("doc_id", "text_key", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """``doc_id, text_key, kinds``: texts whose postings satisfy the query of at least one rule."""
    terms = [(r.kind, c, a, g, len(alternative)) for r in rules for c, clause in enumerate(r.clauses) for a, alternative in enumerate(clause) for g in sorted(alternative)]
    spark: SparkSession = index.sparkSession
    # as many rows as the rules have trigrams: the broadcast is bounded
    table = F.broadcast(spark.createDataFrame(terms, "kind string, clause int, alternative int, trigram string, need int"))
    needs = F.create_map(*(F.lit(x) for r in rules if r.clauses for x in (r.kind, len(r.clauses))))
    text = ["doc_id", "text_key"]
    met = index.join(table, "trigram").groupBy(*text, "kind", "clause", "alternative").agg(F.size(F.collect_set("trigram")).alias("n"), F.first("need").alias("need")).where("n = need")
    rows = met.groupBy(*text, "kind").agg(F.size(F.collect_set("clause")).alias("clauses")).where(F.col("clauses") == F.element_at(needs, F.col("kind")))
    return rows.groupBy(*text).agg(F.collect_set("kind").alias("kinds"))


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """Matches of one rule as ``(start, number, end)``, leftmost and disjoint, in code points.

    The texts between matches give the positions. Matches whose group is too
    short are passed over, they still take their place.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    gaps = F.split(text, rule.regex, -1)
    sizes = F.zip_with(F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("own"))), groups,
                       lambda x, g: F.struct(x["gap"].alias("gap"), x["own"].alias("own"), (F.length(g) >= rule.least).alias("keep")))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        one = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + x["own"]).alias("end")))
        return F.struct((start + x["own"]).alias("at"), F.when(x["keep"], F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(sizes, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("found")), step, lambda acc: acc["found"])


def scan_secrets(docs: DataFrame, rules: list[Rule] | None = None, base: int = BASE) -> DataFrame:
    """``doc_id``, ``n_<kind>`` of the base rules, ``base_sha256``, ``spans`` and ``n_added``; a row for each row of ``docs``.

    The hash is of kind:start:end of the first ``base`` rules' matches by
    start, then rule order; ``spans`` has those of all rules. A null text
    counts as empty. Null and equal ids are told apart by the text's hash;
    repeated rows each give a row. Whole texts are searched, of any length.
    Other columns of ``docs``, of any name, are ignored. No rows give no rows.
    """
    rules = rules or RULES
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    indexed = [r for r in rules if r.clauses]
    index = written(postings(rows, indexed), "postings")
    found = written(candidates(index, indexed), "candidates") if indexed else None
    if found is not None:
        found = found.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "kinds").hint("merge")
        rows = rows.join(found, rows.doc_id.eqNullSafe(F.col("d")) & (rows.text_key == F.col("k")), "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    text = F.col("text")
    columns = []
    for number, rule in enumerate(rules):
        asked = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)) if rule.clauses else text.rlike(rule.regex)
        columns.append(F.when(asked, rule_spans(text, rule, number)).otherwise(none).alias(f"s{number}"))
    names = F.array(*(F.lit(r.kind) for r in rules))

    def listed(numbers: range) -> Column:
        return F.array_sort(F.concat(*(F.col(f"s{n}") for n in numbers)))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    every = rows.select("doc_id", *columns)
    return every.select(
        "doc_id", *(F.size(f"s{n}").cast("long").alias(f"n_{rules[n].kind}") for n in range(base)),
        F.sha2(joined(listed(range(base))), 256).alias("base_sha256"), joined(listed(range(len(rules)))).alias("spans"),
        sum((F.size(f"s{n}") for n in range(base, len(rules))), F.lit(0)).cast("long").alias("n_added"))
