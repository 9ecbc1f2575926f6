"""Table functions, callable from SQL and by ``lateralJoin``.

``find_dates(text, month_first)`` and ``word_spans(text, longest)`` give rows
for one text. ``outermost(TABLE hits)`` partitions and orders its table by
itself and holds only the hits that the next rows can still overlap.
"""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from collections.abc import Iterator
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf

_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_DATE = re.compile(rf"\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b\d{{1,2}}(?:st|nd|rd|th)? {_MONTH},? \d{{4}}\b|\b{_MONTH} \d{{1,2}},? \d{{4}}\b|\b\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{4}}\b", re.I | re.A)
_NUMERIC = re.compile(r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})")


def read_date(raw: str, month_first: bool = False) -> date | None:
    """The date that a match states; null for an invalid one."""
    numbers = _NUMERIC.fullmatch(raw)
    if numbers:
        a, b, year = map(int, numbers.groups())
        day, month = (b, a) if b > 12 or (month_first and a <= 12) else (a, b)
        try:
            return date(year, month, day)
        except ValueError:
            return None
    plain = re.sub(r"\b([a-z]{3})[a-z]*", r"\1", re.sub(r"(\d)(?:st|nd|rd|th)\b", r"\1", raw.lower()).replace(",", ""))
    for layout in ("%Y-%m-%d", "%d %b %Y", "%b %d %Y"):
        try:
            return datetime.strptime(plain, layout).date()
        except ValueError:
            continue
    return None


@udtf(returnType="pos int, raw string, date date")
class FindDates:
    """``pos, raw, date`` of the valid dates of a text; ``pos`` counts all that look like dates. A null text has none."""

    def eval(self, text: str, month_first: bool) -> Iterator[tuple]:
        for pos, m in enumerate(_DATE.finditer(text or "")):
            found = read_date(m.group(), bool(month_first))
            if found is not None:
                yield pos, m.group(), found


@udtf(returnType="pos int, n int, alias string")
class WordSpans:
    """``pos, n, alias``: all runs of 1 to ``longest`` folded words of a text. A null text has none."""

    def eval(self, text: str, longest: int) -> Iterator[tuple]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()
        words = re.findall(r"[a-z0-9]+", plain)
        for n in range(1, longest + 1):
            for pos in range(len(words) - n + 1):
                yield pos, n, " ".join(words[pos:pos + n])


@udtf
class Outermost:
    """The rows of a table ``doc_id, pos, n, …`` that no longer run of the same document overlaps; the table keeps its columns."""

    def __init__(self) -> None:
        self.open: deque[list] = deque()

    @staticmethod
    def analyze(hits: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(schema=hits.dataType, partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("pos")])

    def eval(self, hits: T.Row) -> Iterator[tuple]:
        pos, n = hits["pos"], hits["n"]
        # Rows come by position: a run that ends before this one can be overlapped no more.
        yield from self._closed(pos)
        covered = False
        for other in self.open:
            start, size = other[0]["pos"], other[0]["n"]
            if start + size > pos and start < pos + n:
                covered |= size > n
                other[1] |= n > size
        self.open.append([hits, covered])

    def _closed(self, pos: int | None) -> Iterator[tuple]:
        rest: deque[list] = deque()
        for row, covered in self.open:
            if pos is not None and row["pos"] + row["n"] > pos:
                rest.append([row, covered])
            elif not covered:
                yield tuple(row)
        self.open = rest

    def terminate(self) -> Iterator[tuple]:
        yield from self._closed(None)


TABLE_FUNCTIONS = {"find_dates": FindDates, "word_spans": WordSpans, "outermost": Outermost}


def register(spark: SparkSession) -> None:
    """Make the table functions callable from the session's SQL."""
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)


def dates_of(docs: DataFrame, month_first: bool = False) -> DataFrame:
    """``doc_id, pos, raw, date`` by a lateral join with the table function: the rows of ``corpus.find_dates``."""
    return docs.lateralJoin(FindDates(F.col("text").outer(), F.lit(month_first))).select("doc_id", "pos", "raw", "date")


def places_of(docs: DataFrame, gazetteer: DataFrame, longest: int = 3) -> DataFrame:
    """``doc_id, pos, n, place`` by table functions: the rows of ``corpus.find_places``.

    Spans join the aliases by equality; what a longer hit overlaps goes, one
    document at a time and in the order of its words.
    """
    register(docs.sparkSession)
    hits = docs.sparkSession.sql(
        "SELECT d.doc_id, s.pos, s.n, g.place FROM {docs} d, LATERAL word_spans(d.text, " + str(int(longest)) + ") s JOIN {places} g ON s.alias = g.alias",
        docs=docs, places=gazetteer.hint("merge"))
    return docs.sparkSession.sql("SELECT * FROM outermost(TABLE(SELECT * FROM {hits}))", hits=hits).select("doc_id", "pos", "n", "place")
