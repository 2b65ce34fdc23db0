"""Hand-made edge cases (FIXTURES.md "Hand-made unit cases", SURVEY §7.3)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from campaignlab.functions.blocks import bucket
from campaignlab.operators import activity as X
from campaignlab.operators import audience as A
from campaignlab.operators import status as S
from tests.helpers import deposit, frame, order, summary, tables, user

START, END = "2000-01-01 00:00:00", "2000-06-30 23:59:00"


def ids(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "User_ID string")


def test_null_user_kept_by_anti_join_dropped_by_test_filter(spark):
    t = tables(spark, deposits=[deposit(None), deposit("7")], orders_summary=[summary(None), summary("7")],
               users=[user("9", status="close")])
    dep = {r.User_ID for r in A.deposit_behavior(t).collect()}
    assert dep == {None, "7"}  # NOT EXISTS keeps the null id
    ob = {r.User_ID for r in A.order_behavior(t, as_of="2000-02-01").collect()}
    assert ob == {"7"}  # <> '1' drops it


def test_ticket_bucket_edges(spark):
    vals = [1, 5, 6, 10, 11, 50, 51, 100, 101, 200, 201, 0, -1, None]
    want = ["1", "<=5", "<=10", "<=10", "<=50", "<=50", "<=100", "<=100", "<=200", "<=200", ">200", "<=5", "<=5",
            ">200"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v bigint")
    got = [r.s for r in df.select("i", X.ticket_segment(F.col("v")).alias("s")).orderBy("i").collect()]
    assert got == want


def test_wallet_bucket_edges(spark):
    vals = ["0", "200", "200.01", "1000", "5000", "5000.01"]
    want = ["<=200", "<=200", "<=1000", "<=1000", "<=5000", ">5000"]
    df = spark.createDataFrame([(i, Decimal(v)) for i, v in enumerate(vals)], "i int, v decimal(18,2)")
    got = [r.s for r in df.select("i", bucket(F.col("v"), A.WALLET_EDGES, A.WALLET_LABELS).alias("s"))
           .orderBy("i").collect()]
    assert got == want


def test_rank_ties(spark):
    rows = [summary("a", turnover="50.00"), summary("b", turnover="50.00"), summary("c", turnover="10.00")]
    t = tables(spark, orders_summary=rows, games=[{"GameID": 1, "Lottery": "Lucky Day", "Unit_Price": 5}])
    per_draw = A.top_n(t, "Lucky Day", n=1, by="Turnover", draws=[60]).collect()
    assert sorted(r.User_ID for r in per_draw) == ["a", "b"]
    assert {r.Rank for r in per_draw} == {1}
    overall = A.top_n(t, "Lucky Day", n=1, by="Turnover").collect()
    assert [r.User_ID for r in overall] == ["a"]


def test_similar_product_names(spark):
    t = tables(spark, orders=[order("x", lottery="Pick 30"), order("y", lottery="Pick 3")])
    assert [r.User_ID for r in A.non_buyers(t, "Pick 3").collect()] == ["x"]


@pytest.mark.parametrize("days,label", [(29, ">= 0 month"), (30, ">= 1 month"), (59, ">= 1 month"),
                                        (60, ">= 2 month")])
def test_inactive_months(spark, days, label):
    start = dt.datetime(2000, 3, 1, 10, 0)
    last = start - dt.timedelta(days=days)
    t = tables(spark, orders=[order("u", when=last.isoformat(sep=" "))])
    got = X.inactive_months(t, ids(spark, "u"), start).collect()
    assert [r.inactive_month for r in got] == [label]


def test_window_bounds(spark):
    t = tables(spark, orders=[order("s", when=START), order("e", when=END), order("late", when="2000-06-30 23:59:30")])
    base = {r.User_ID for r in X.activity_base(t, ids(spark, "s", "e", "late"), START, END).collect()}
    assert base == {"s", "e"}
    assert X.inactive_months(t, ids(spark, "s"), START).count() == 0  # a row at start is not history


def test_empty_window_report(spark):
    t = tables(spark, orders=[order("u", when="1990-01-01 00:00:00")])
    rep = X.campaign_report(t, ids(spark, "u", "v"), START, END, title="t")
    assert rep["empty"] is True
    s = rep["sections"]
    ov = s["overview"].collect()[0]
    assert ov.Receiver == 2 and ov.Active_players == 0 and ov.Avg_spend is None
    dep = s["deposit"].collect()[0]
    assert dep.Attempt_users == 0 and dep.Attempts == 0 and dep.Success_amount is None
    assert s["by_product"].count() == 0 and s["by_ticket"].count() == 0 and s["reactivation"].count() == 0
    assert [r.stat for r in s["stats"].collect()] == ["average", "min", "median", "max"]


def test_conflicting_status_upload_raises(spark):
    users = frame(spark, "dim_user_authentication", [user("1"), user("2")])
    up = spark.createDataFrame([("2", "close"), ("2", "locked")], "`User ID` string, `User Status` string")
    with pytest.raises(Exception, match="conflicting updates"):
        S.apply_user_status(users, up).collect()
    same = spark.createDataFrame([("2", "close"), ("2", "close")], "`User ID` string, `User Status` string")
    out = {r.User_ID: r.user_status for r in S.apply_user_status(users, same).collect()}
    assert out == {"1": "active", "2": "close"}
    none = spark.createDataFrame([], "`User ID` string, user_id string, mail_status int, message_status int, sms_status int")
    out = S.update_status(users, none, none.drop("User ID"), up, on_conflict="max")
    assert {r.User_ID: r.user_status for r in out.collect()} == {"1": "active", "2": "locked"}


def test_winners_keep_null_draws_and_drop_repeats(spark):
    rows = [order("5", draw=d, prize="1.00") for d in (None, None, 7, 7)]
    got = A.winners(tables(spark, orders=rows), "Lucky Day").collect()
    assert [(r.User_ID, r.Draw_Period) for r in got] == [("5", 7), ("5", None)]


def test_id_types_are_text(spark):
    t = tables(spark, deposits=[deposit("00123"), deposit("123")])
    assert sorted(r.User_ID for r in A.deposit_behavior(t).collect()) == ["00123", "123"]


def test_opt_out_latest_wins_and_rg_never_resets(spark):
    users = frame(spark, "dim_user_authentication", [user("1", rg=1), user("2"), user("3")])
    opt = spark.createDataFrame(
        [("2", 0, 0, 0, dt.date(2001, 2, 1)), ("2", 1, 1, 1, dt.date(2001, 1, 1)), ("9", 0, 0, 0, dt.date(2001, 1, 1))],
        "user_id string, message_status int, mail_status int, sms_status int, updated_time date")
    out = {r.User_ID: r for r in S.apply_opt_out(users, opt).collect()}
    assert len(out) == 3  # unknown id 9 adds nothing
    assert (out["2"].receive_mail, out["2"].receive_message, out["2"].receive_sms) == (0, 0, 0)
    assert out["3"].receive_message == 1
    rg = spark.createDataFrame([("2",), ("2",)], "`User ID` string")
    res = {r.User_ID: r.RG_limit for r in S.apply_rg_limit(users, rg).collect()}
    assert res == {"1": 1, "2": 1, "3": 0}


def test_wallet_test_account_keeps_deposit_but_not_orders(spark):
    t = tables(spark, deposits=[deposit("1", amount="300.00")], orders_summary=[summary("1", turnover="100.00")],
               users=[user("1")])
    row = A.wallet_balance(t, as_of="2000-02-01").collect()[0]
    assert row.balance == Decimal("300.00") and row.inactive_days is None  # D10


def test_withdraw_null_status_and_having(spark):
    t = tables(spark, deposits=[deposit("u", amount="1000.00")],
               withdrawals=[{"User_ID": "u", "withdrawal_amount": Decimal("100.00"), "withdrawal_status": None},
                            {"User_ID": "u", "withdrawal_amount": Decimal("50.00"), "withdrawal_status": "Success"},
                            {"User_ID": "u", "withdrawal_amount": Decimal("70.00"), "withdrawal_status": "Failure"}])
    row = A.wallet_balance(t, as_of="2000-02-01").collect()[0]
    assert row.balance == Decimal("950.00")


def test_audience_paths_agree_and_hot_user(spark):
    from campaignlab.functions.blocks import aggregate_for_audience

    hot = [order("hot", entries=1) for _ in range(300)]
    rows = tables(spark, orders=hot + [order("a", entries=2), order("b", lottery="Instant", entries=3)]).orders
    aud = ids(spark, "hot", "b", "zzz")
    aggs = [F.sum("Entries").alias("n")]
    want = {("hot", "Lucky Day", 300), ("b", "Instant", 3)}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in (old, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            got = aggregate_for_audience(rows, aud, ["User_ID", "Lottery"], aggs)
            assert {tuple(r) for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_null_users_in_wallet_and_declined(spark):
    t = tables(spark, deposits=[deposit(None, amount="1000.00")],
               fail_groups=[{"gateway_memo": "1-URGENT", "fail_group": "Bank declined"}],
               withdrawals=[{"User_ID": None, "withdrawal_amount": Decimal("100.00"), "withdrawal_status": "Success"}],
               refunds=[{"User_ID": None, "Refund_amount": Decimal("50.00"), "Memo": "Success"}])
    row = A.wallet_balance(t, as_of="2000-02-01").collect()[0]
    assert row.User_ID is None and row.balance == Decimal("1000.00")
    assert [tuple(r) for r in A.bank_declined(t).collect()] == [(None, None, None)]


def test_opt_out_text_times(spark):
    from campaignlab.operators.status import apply_opt_out

    users = tables(spark, users=[user("u")]).users
    cols = "user_id string, message_status string, mail_status string, sms_status string, updated_time string"
    up = spark.createDataFrame([("u", "1", "1", "1", "9/30/2025"), ("u", "0", "0", "0", "10/01/2025")], cols)
    row = apply_opt_out(users, up).collect()[0]
    assert (row.receive_message, row.receive_mail, row.receive_sms) == (0, 0, 0)
    with pytest.raises(Exception, match="not a time"):
        apply_opt_out(users, spark.createDataFrame([("u", "1", "1", "1", "yesterday")], cols)).collect()


def test_stored_exclusion_list_and_empty_facts(spark, tmp_path):
    from campaignlab.sources.tables import load_tables, save_tables

    t = tables(spark, users=[user("2x"), user("3y", status="suspend")], abnormal=[{"User_ID": "2x"}])
    save_tables(t, str(tmp_path))
    got = load_tables(spark, str(tmp_path))
    assert [r.User_ID for r in got.abnormal.collect()] == ["2x"]
    assert got.orders.count() == 0 and got.orders.columns == t.orders.columns
    assert [r.User_ID for r in load_tables(spark, str(tmp_path), derive_abnormal=True).abnormal.collect()] == ["3y"]


def test_every_order_line_is_kept(spark, sf001):
    from campaignlab.sources.fixtures import TestData

    lines = spark.read.parquet(f"{sf001}/lineitem.parquet").count()
    assert TestData(spark, sf001).table("fact_orders").count() == lines


def test_metric_rows_display(spark):
    t = tables(spark, orders=[order("u", entries=1500, turnover="12345.67")],
               deposits=[deposit("u", amount="1000.00"), deposit("u", amount="2500.50", top_up_id=2)])
    aud = ids(spark, "u", "v", "w")
    by_user = X.activity_by_user(X.activity_base(t, aud, START, END))
    rows = X.metric_rows(X.activity_summary(aud, by_user), X.SUMMARY_LABELS).collect()
    assert [(r.Metric, r.Value) for r in rows] == [
        ("Receiver", "3"), ("Active players", "1"), ("Active percentage", "33.33%"), ("Ticket sold", "1,500"),
        ("Turnover", "12,345"), ("Avg spend", "12345.67")]
    dep = X.metric_rows(X.deposit_summary(X.activity_deposits(t, aud, START, END)), X.DEPOSIT_LABELS).collect()
    assert dict((r.Metric, r.Value) for r in dep) == {
        "Attempt deposit users": "1", "Total transaction (attempt)": "2", "Success users": "1",
        "Success deposit amount": "3,500", "Min amount": "3,500", "Avg amount": "3500.50", "Max amount": "3,500"}


def test_strict_excludes_test_account_everywhere(spark):
    t = tables(spark, deposits=[deposit("1"), deposit("2")], users=[user("1"), user("2")],
               rfm=[{"User_ID": "1", "Segment": "Loyal"}, {"User_ID": "2", "Segment": "Loyal"}])
    assert {r.User_ID for r in A.deposit_behavior(t).collect()} == {"1", "2"}  # parity (D10)
    assert {r.User_ID for r in A.deposit_behavior(t, strict=True).collect()} == {"2"}
    assert {r.User_ID for r in A.all_users(t, strict=True).collect()} == {"2"}
    assert {r.User_ID for r in A.rfm_segment(t, "Loyal", strict=True).collect()} == {"2"}
    assert {r.User_ID for r in A.wallet_balance(t, "2000-02-01", strict=True).collect()} == {"2"}


def test_opt_out_without_time_column(spark):
    users = frame(spark, "dim_user_authentication", [user("1"), user("2")])
    opt = spark.createDataFrame([("2", 0, 1, 0)], "user_id string, message_status int, mail_status int, sms_status int")
    out = {r.User_ID: (r.receive_mail, r.receive_message, r.receive_sms) for r in S.apply_opt_out(users, opt).collect()}
    assert out == {"1": (1, 1, 1), "2": (1, 0, 0)}
