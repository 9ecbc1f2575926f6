"""The driver's contract."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_module

SMALL = "/root/testdata/sf0.001"


def test_names_agree():
    names = set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= names and len(names) > 80


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are absent")
def test_flagship(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["mpn", "competitor_id", "unit_price", "observed_on", "adapter", "reliability", "lead_time_days", "warranty_months"]
    assert df.count() >= 0
