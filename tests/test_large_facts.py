"""The order facts are dealt out by their rows: a task's share stays when the tables grow."""

import contextlib
import datetime as dt
import glob
import io
import re
import tempfile

import pytest

from campaignlab.plans import load_all
from campaignlab.session import ensure_checkpoint_dir
from campaignlab.sources import fixtures
from campaignlab.sources.fixtures import TestData

DAY = dt.datetime(1996, 3, 1)


@pytest.fixture(scope="module")
def base(spark):
    """600 orders with three lines each, 40 users; order keys that repeat, and null keys and dates."""
    path = tempfile.mkdtemp(prefix="campaignlab-facts-")
    orders = [(k, 1 + k % 40, "FOP"[k % 3], 150.0 + 10 * k, DAY + dt.timedelta(days=k % 50), f"{1 + k % 5}-X") for k in range(600)]
    orders += [(5, 17, "F", 900.0, DAY, "1-X"), (5, 6, "F", 900.0, DAY, "1-X"), (7, None, "F", 10.0, DAY, None),
               (None, 3, "F", 10.0, DAY, "1-X"), (8, 9, "F", 10.0, None, "1-X")]
    lines = [(k, (37 * k + 11 * i) % 100, i, float(1 + (k + i) % 50), 400.0 + k, "RNA"[(k + i) % 3], DAY + dt.timedelta(days=k % 90 + i))
             for k in range(600) for i in (1, 1, 7)]
    lines += [(None, 4, 1, 1.0, 1.0, "R", DAY), (9, None, 1, 1.0, 1.0, "R", DAY), (9, 72, 7, None, None, None, None)]
    events = [(k, 1 + k % 40, ("purchase", "error", "view")[k % 3], 1.0 + k % 9) for k in range(300)]
    rows = {
        "region": ([(0, "R0")], "r_regionkey int, r_name string"),
        "nation": ([(0, "N0", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(k, f"C{k}", 0, -650.0 + 25 * k, ("BUILDING", "MACHINERY")[k % 2]) for k in range(1, 41)],
                     "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "part": ([(k, 1 + k % 50) for k in range(300)], "p_partkey bigint, p_size int"),
        "orders": (orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
                           "o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": (lines, "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                            "l_returnflag string, l_shipdate timestamp_ntz"),
        "events": (events, "event_id bigint, user_id bigint, event_type string, value double"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture()
def large(monkeypatch):
    monkeypatch.setattr(fixtures, "ROWS_PER_TASK", 40)  # 2408 rows of both inputs: 61 tasks


def rows(df):
    return sorted(map(str, df.collect()))


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


VIEWS = ("fact_orders", "fact_orders_summary")
QUERIES = ("order_behavior", "order_behavior_stored", "wallet_balance", "wallet_balance_clustered", "buyers", "winners_all")


@pytest.fixture(scope="module")
def plain(spark, base):
    td = TestData(spark, base)
    assert td.tasks == 1
    return {v: rows(td.table(v)) for v in VIEWS} | {q: rows(load_all()[q].run(spark, base)) for q in QUERIES}


@pytest.mark.parametrize("view", VIEWS)
def test_order_facts_in_tasks_by_rows(spark, base, large, plain, view):
    td = TestData(spark, base)
    assert td.tasks == 61
    df = td.table(view)
    dealt = re.findall(r"hashpartitioning\((.*), 61\), REPARTITION_BY_NUM", plan(df))
    assert any(x.startswith("l_orderkey") for x in dealt) and any(x.startswith("o_orderkey") for x in dealt)
    assert view == "fact_orders" or any(x.startswith("User_ID") and "Game_series" in x for x in dealt)
    assert rows(df) == plain[view] and len(plain[view]) > 900


@pytest.mark.parametrize("name", [q for q in QUERIES if q != "wallet_balance_clustered"])
def test_queries_over_dealt_facts_agree(spark, base, large, plain, name):
    assert rows(load_all()[name].run(spark, base)) == plain[name] != []


def test_few_rows_keep_the_plan_and_tasks_are_bounded(spark, base, monkeypatch):
    monkeypatch.setattr(fixtures, "ROWS_PER_TASK", 200)
    assert TestData(spark, base).tasks == 13
    assert "REPARTITION_BY_NUM" not in plan(TestData(spark, base).table("fact_orders_summary"))
    monkeypatch.setattr(fixtures, "ROWS_PER_TASK", 1)
    monkeypatch.setattr(fixtures, "MOST_TASKS", 50)
    assert TestData(spark, base).tasks == 50


def test_stored_summary_is_written_by_dealt_tasks(spark, base, large, plain):
    out = load_all()["order_behavior_stored"].run(spark, base)
    folder = re.match(r".*/tables-[^/]*", next(f for f in out.inputFiles() if "/fact_orders_summary/" in f))[0]
    stored = spark.read.parquet(f"{folder}/fact_orders_summary")
    assert 20 < len(stored.inputFiles()) <= 61  # the session has 8 partitions
    assert rows(stored) == plain["fact_orders_summary"]


def test_clustered_buckets_follow_the_rows(spark, base, monkeypatch, plain):
    monkeypatch.setattr(fixtures, "ROWS_PER_TASK", 24)  # 101 tasks
    before = set(glob.glob(folders := f"{ensure_checkpoint_dir(spark).removeprefix('file:').rstrip('/')}/clustered-*"))
    out = load_all()["wallet_balance_clustered"].run(spark, base)
    [folder] = set(glob.glob(folders)) - before
    assert {r["buckets"] for r in spark.read.parquet(f"{folder}/layout").collect()} == {25}
    assert rows(out) == plain["wallet_balance_clustered"] == plain["wallet_balance"] != []
