"""Queries of the listings against their SQL on small, dense tables whose order lines repeat."""

import datetime as dt
import random

import duckdb
import pytest

import __spark_entry__ as registry
from tidemark.operators import listings

NAMES = ["large ring", "hot bolt", "blue ring", "old plate", "hot bolts", "large rings"]


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    """Lines of three days at few suppliers: ids stand twice, titles and starts many times."""
    rng, folder = random.Random(9), str(tmp_path_factory.mktemp("dense"))
    parts = [(k, rng.choice(NAMES), f"Brand#{rng.randrange(1, 4)}", rng.choice(["LARGE", "SMALL"])) for k in range(30)]
    lines = [(rng.randrange(25), rng.randrange(30), rng.randrange(50), rng.randrange(1, 8), dt.datetime(1997, 1, rng.randrange(1, 4))) for _ in range(600)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    return folder


def differences(spark, folder, name, tables=("lineitem", "part")):
    """Rows the query and its SQL give, each beyond the other's, and how many there are."""
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = db.execute(registry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in registry.queries()[name](spark, folder).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(got, key=key), sorted(want, key=key)


@pytest.mark.parametrize("titles", [0, 16], ids=["in time", "once"])
@pytest.mark.parametrize("name", ["e04_title_pairs", "e05_event_pairs"])
def test_titles_either_way(spark, dense, monkeypatch, name, titles):
    """Titles compared once for all their times, and only near each other in time: the same pairs."""
    monkeypatch.setattr(listings, "_TITLES", titles)
    monkeypatch.setattr(listings, "_TRIES", 100_000 if titles else 0)
    got, want = differences(spark, dense, name)
    assert got == want and len(want) > 100


def test_titles_are_compared_once(spark, monkeypatch):
    """Two titles over a thousand hours: what is compared are the titles, not their rows."""
    compared = []
    real = listings.materialize
    monkeypatch.setattr(listings, "materialize", lambda df, name: (made := real(df, name), compared.append((name, made.count())))[0])
    rows = spark.range(2000).selectExpr("id", "IF(id % 2 = 0, 'Jazz Night', 'Jazz Nights Downtown') AS title", "id DIV 2 * 3600 AS at")
    assert listings.title_pairs(rows, 2).count() == 999 + 998 + 1000 + 2 * 999 + 2 * 998 + 999 + 998
    assert dict(compared)["like-titles"] == 3


@pytest.mark.parametrize("name", ["e06_known_events", "e07_drifted_keys"])
def test_ids_that_stand_twice(spark, dense, name):
    got, want = differences(spark, dense, name)
    assert got == want and len(want) > 10


def test_occurrences(spark, tmp_path):
    """Every day of a leap year and all hours, against the SQL; a time is read once, so the columns stay small."""
    days = [(k, dt.datetime(1996, 1, 1) + dt.timedelta(days=k % 366)) for k in range(4026)]
    spark.createDataFrame(days, "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    got, want = differences(spark, str(tmp_path), "e22_occurrences", ("orders",))
    assert got == want and len(want) == 4026
    plan = registry.queries()["e22_occurrences"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") < 20, plan.count("regexp_extract(")
