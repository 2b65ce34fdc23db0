"""Balances as of a day, the monthly ledger, the maintained last-activity table."""

import datetime as dt
import glob
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from campaignlab.operators import activity as X
from campaignlab.operators import audience as A
from campaignlab.operators import last_activity as H
from campaignlab.operators import ledger as L
from campaignlab.sources.fixtures import TestData
from campaignlab.sources.tables import load_tables, save_tables
from tests.helpers import deposit, order, summary, tables


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def campaign(spark, sf001):
    return TestData(spark, sf001).campaign


def test_rows_after_the_day_do_not_count(spark):
    t = tables(spark, orders_summary=[summary("2", day="2000-01-10"), summary("2", day="2000-03-01", turnover="50.00")],
               games=[{"GameID": 1, "Lottery": "Lucky Day", "Unit_Price": 5}],
               deposits=[deposit("2", when="2000-01-10 23:59:59"), deposit("2", amount="900.00", when="2000-01-11 00:00:00")])
    e2 = A.order_behavior(t, "2000-01-10").collect()
    assert [(r.inactive_days, r.Tickets, r.Turnover) for r in e2] == [(0, 1, Decimal("5.00"))]
    e4 = A.buyers(t, "Lucky Day", "2000-02-01").collect()
    assert [(r.inactive_days, r.Turnover) for r in e4] == [(22, Decimal("5.00"))]
    e8 = A.wallet_balance(t, "2000-01-10").collect()
    assert [(r.balance, r.inactive_days) for r in e8] == [(Decimal("95.00"), 0)]
    assert A.order_behavior(t, "1999-12-31").count() == A.wallet_balance(t, "1999-12-31").count() == 0
    assert A.order_behavior(t).first()["Turnover"] == Decimal("55.00")  # no day: all rows


@pytest.mark.parametrize("day", ["1995-01-01", "1996-02-29", "1997-12-31", "1998-01-01", "2002-01-01"])
def test_ledger_equals_wallet_balance(campaign, day):
    ledger = L.monthly_ledger(campaign)
    got = L.wallet_balances_at(campaign, ledger, [day])
    assert rows(got.drop("as_of")) == rows(A.wallet_balance(campaign, day))


def test_several_days_in_one_pass(campaign):
    days = ["1996-05-05", dt.date(1996, 5, 20), "1999-08-31", "1996-05-05"]
    got = L.wallet_balances_at(campaign, L.monthly_ledger(campaign), days)
    for d in ("1996-05-05", "1996-05-20", "1999-08-31"):
        assert rows(got.filter(F.col("as_of") == d).drop("as_of")) == rows(A.wallet_balance(campaign, d))
    assert got.select("as_of").distinct().count() == 3


def test_ledger_without_dates_and_users(spark):
    t = tables(spark, deposits=[deposit("2"), deposit(None), {**deposit("3"), "creation_date": None}],
               withdrawals=[{"User_ID": "2", "withdrawal_amount": Decimal("30.00"), "withdrawal_status": "Success"},
                            {"User_ID": None, "withdrawal_amount": Decimal("30.00"), "withdrawal_status": "Success"}])
    for d in ("2000-01-09", "2000-01-10", "2000-02-01"):
        assert rows(L.wallet_balances_at(t, L.monthly_ledger(t), [d]).drop("as_of")) == rows(A.wallet_balance(t, d))
    empty = tables(spark)
    assert L.wallet_balances_at(empty, L.monthly_ledger(empty), ["2000-01-01"]).count() == 0
    with pytest.raises(ValueError):
        L.wallet_balances_at(empty, L.monthly_ledger(empty), [])


def test_hot_user_ships_a_row_a_month(spark, campaign):
    """The ledger sums months before any shuffle of rows: one exchange below the window."""
    plan = L.monthly_ledger(campaign)._jdf.queryExecution().executedPlan().toString()
    top = plan[:plan.index("Union")]
    assert top.count("Exchange hashpartitioning(User_ID") == 2 and top.count("partial_sum") > 0


# ------------------------------------------------------------------ last activity
STARTS = ["1994-01-01 00:00:00", "1996-07-01 00:00:00", "1998-03-15 12:00:00", "2000-01-01 00:00:00", "2005-05-05 05:05:05"]


@pytest.mark.parametrize("start", STARTS)
def test_summary_gives_inactive_months(spark, sf001, campaign, start):
    ids = X.audience(TestData(spark, sf001).table("upload_audience"))
    got = H.inactive_months_maintained(campaign, H.monthly_last_days(campaign.orders), ids, start)
    assert rows(got) == rows(X.inactive_months(campaign, ids, start))


def test_only_one_month_of_orders_is_read(spark, sf001, campaign):
    path = tempfile.mkdtemp(prefix="campaignlab-last-")
    save_tables(campaign, path + "/t")
    H.add_orders(spark, path + "/last", campaign.orders)
    t, ids = load_tables(spark, path + "/t"), X.audience(TestData(spark, sf001).table("upload_audience"))
    got = H.inactive_months_maintained(t, H.read_last_days(spark, path + "/last"), ids, "1998-03-15 12:00:00")
    assert rows(got) == rows(X.inactive_months(campaign, ids, "1998-03-15 12:00:00"))
    orders = t.orders.filter("DateID >= '1998-03-01' and DateID <= '1998-03-15'")
    read = {f for f in got.inputFiles() if "/fact_orders/" in f}  # before pruning: the whole table
    assert len(orders.inputFiles()) <= len(read)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "DateID#" in plan and "1998-03-01" in plan


def test_new_orders_touch_their_months_only(spark):
    folder = tempfile.mkdtemp(prefix="campaignlab-last-") + "/last"
    t = lambda *o: tables(spark, orders=list(o)).orders
    H.add_orders(spark, folder, t(order("2", when="2000-01-10 10:00:00"), order("2", when="2000-02-01 10:00:00"), order("3", when="2000-01-05 01:00:00")))
    old = set(glob.glob(f"{folder}/month=*/*.parquet"))
    late = t(order("2", when="2000-01-20 10:00:00"), order("4", when="2000-03-02 10:00:00"), {**order("5"), "Creation_date": None})
    for _ in range(2):  # the same orders again change nothing
        H.add_orders(spark, folder, late)
    new = set(glob.glob(f"{folder}/month=*/*.parquet"))
    feb = lambda fs: {f for f in fs if "month=2000-02-01" in f}
    assert feb(old) == feb(new) and len(feb(new)) == 1 and old & new == feb(old)
    got = {(r.User_ID, str(r.month), str(r.last_day)) for r in H.read_last_days(spark, folder).collect()}
    assert got == {("2", "2000-01-01", "2000-01-20"), ("2", "2000-02-01", "2000-02-01"), ("3", "2000-01-01", "2000-01-05"),
                   ("4", "2000-03-01", "2000-03-02")}
    H.add_orders(spark, folder, t())


def test_a_stale_summary_does_not_agree(campaign):
    kept = H.monthly_last_days(campaign.orders)
    assert {r.agree for r in H.last_days_agree(kept, campaign.orders).collect()} == {True}
    stale = H.monthly_last_days(campaign.orders.filter("Creation_date < timestamp_ntz'2000-02-10 00:00:00'"))
    got = {str(r.month): r.agree for r in H.last_days_agree(stale, campaign.orders).collect()}
    assert got["2000-01-01"] and not got["2000-03-01"] and len([a for a in got.values() if a]) >= 60
