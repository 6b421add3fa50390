"""Shared fixtures: one local Spark session and the 12-row joined orders frame."""

from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from salespark.plans.session import build_session  # noqa: E402
from salespark.sources import schema  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", shuffle_partitions=4)
    yield s


def _d(x) -> Decimal:
    return Decimal(str(x))


# Twelve order lines of our own; the golden values of the tests were worked out from
# them with DuckDB.  Columns: line, day, quantity, discount, revenue, profit, returned,
# rating, customer, product.
LINES = """
L01 2025-04-03 2 0.00 160 64  No  5 K1 A7
L02 2025-04-08 1 0.05 114 44  No  4 K2 B2
L03 2025-04-14 2 0.35 52  -36 Yes 2 K3 C9
L04 2025-04-21 1 0.00 80  32  No  5 K1 A7
L05 2025-05-02 3 0.10 324 114 No  4 K4 B2
L06 2025-05-09 1 0.25 30  -14 Yes 3 K2 C9
L07 2025-05-15 2 0.00 160 64  No  5 K3 A7
L08 2025-05-27 1 0.00 120 50  Yes 3 K1 B2
L09 2025-06-04 4 0.05 304 112 No  4 K3 A7
L10 2025-06-10 1 0.40 24  -20 No  2 K5 C9
L11 2025-06-17 2 0.00 240 100 No  5 K1 B2
L12 2025-06-25 1 0.00 80  32  No  4 K2 A7
"""
PEOPLE = {"K1": ("Ada Moss", 34, "Female", "North"), "K2": ("Ben Ito", 51, "Male", "East"),
          "K3": ("Cleo Ruiz", 28, "Female", "North"), "K4": ("Dov Lang", 45, "Male", "West"),
          "K5": ("Ena Falk", 39, "Female", "Central")}
GOODS = {"A7": ("Desk Lamp", "Home", 80, 48), "B2": ("Trail Boots", "Outdoor", 120, 70),
         "C9": ("Desk Clock", "Home", 40, 44)}


def fixture_rows() -> list[tuple]:
    """The lines joined with their customer and product, in the fact's column order."""
    rows = []
    for text in LINES.strip().splitlines():
        line, day, qty, off, rev, prof, back, stars, who, what = text.split()
        ordered = dt.date.fromisoformat(day)
        rows.append((line, ordered, ordered + dt.timedelta(days=3), int(qty), _d(off), _d(rev), _d(prof),
                     "Web", "Invoice", back, 3, int(stars), who, *PEOPLE[who][:3], "Salem", "Oregon",
                     PEOPLE[who][3], "United States", what, GOODS[what][1], "General", GOODS[what][0],
                     _d(GOODS[what][2]), _d(GOODS[what][3])))
    return rows


@pytest.fixture(scope="session")
def sample_df(spark):
    return spark.createDataFrame(fixture_rows(), schema.FACT).cache()


def rows_by(df, key: str) -> dict:
    return {r[key]: r.asDict() for r in df.collect()}
