"""Table functions against the operators that they equal."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from bidframe.functions import tables
from bidframe.operators import corpus


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("month_first", [False, True])
def test_dates(spark, month_first):
    texts = ["On 3rd March 2024, 31/02/2024 and 05/13/2024.", None, "", "1.2.2020 - 2020-02-30 - 2020-02-29", "Sept 5, 2021 and 12 December, 1999; 13/13/2020", "no date 1/2/20"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = rows(corpus.find_dates(docs, month_first), "doc_id", "pos", "raw", "date")
    assert rows(tables.dates_of(docs, month_first), "doc_id", "pos", "raw", "date") == want and len(want) == 6
    tables.register(spark)
    found = spark.sql("SELECT d.doc_id, t.* FROM {docs} d, LATERAL find_dates(d.text, " + str(month_first).lower() + ") t", docs=docs)
    assert rows(found, "doc_id", "pos", "raw", "date") == want


def test_places(spark):
    draw = random.Random(5)
    words = ["new", "york", "city", "of", "são", "paulo", "pune"]
    docs = spark.createDataFrame([(k, " ".join(draw.choices(words, k=draw.randint(0, 25)))) for k in range(40)] + [(99, None)], "doc_id long, text string")
    names = ["new york", "york", "york city", "city of new", "sao paulo", "paulo", "pune", "of"]
    places = spark.createDataFrame([(a, a.upper()) for a in names], "alias string, place string")
    want = rows(corpus.find_places(docs, places), "doc_id", "pos", "n", "place")
    assert rows(tables.places_of(docs, places), "doc_id", "pos", "n", "place") == want and len(want) > 50


def test_outermost_keeps_columns_and_empty_tables(spark):
    hits = spark.createDataFrame([("a", 0, 2, 7.5), ("a", 1, 1, 1.0), ("a", 2, 1, 2.0), ("b", 1, 1, 3.0)], "doc_id string, pos int, n int, weight double")
    tables.register(spark)
    found = spark.sql("SELECT * FROM outermost(TABLE(SELECT * FROM {hits}))", hits=hits)
    assert found.columns == hits.columns and rows(found, "doc_id", "pos", "weight") == rows(hits.where("weight <> 1.0"), "doc_id", "pos", "weight")
    assert spark.sql("SELECT * FROM outermost(TABLE(SELECT * FROM {hits}))", hits=hits.where(F.lit(False))).count() == 0


def test_find_dates_by_parts(spark):
    """Ordinals in capitals, leap days and months out of range; the table function reads the same."""
    text = "5TH May 2024, 29-02-2024, 29-02-2023, 29.02.1900, 31 April 2024, June 31 2024, sept 30, 2024, 13/12/2024, 12/13/2024, 2024-13-01, 2024-00-10"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    want = {(0, "2024-05-05"), (1, "2024-02-29"), (6, "2024-09-30"), (7, "2024-12-13"), (8, "2024-12-13")}
    assert {(r.pos, str(r.date)) for r in corpus.find_dates(docs).collect()} == want
    tables.register(spark)
    assert {(r.pos, str(r.date)) for r in tables.dates_of(docs).collect()} == want
