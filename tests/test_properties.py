"""Cross-operator properties on the derived test views."""

import pytest
from pyspark.sql import functions as F

from campaignlab.operators import activity as X
from campaignlab.operators import audience as A
from campaignlab.operators import status as S
from campaignlab.sources.fixtures import TestData

START, END = "2000-01-01 00:00:00", "2000-06-30 23:59:00"


@pytest.fixture(scope="module")
def td(spark, sf001):
    return TestData(spark, sf001)


def _ids(df):
    return {r.User_ID for r in df.select("User_ID").collect()}


def test_product_modes_partition_users(td):
    t = td.campaign
    allc = {r.User_ID: r.Product_bought for r in A.product_combinations(t).collect()}
    for product in ("Lucky Day", "Instant", "Pick 3", "Merchant App"):
        non = _ids(A.non_buyers(t, product))
        has = {u for u, p in allc.items() if product in p.split(", ")}
        assert non | has == set(allc) and not (non & has)
        assert _ids(A.only_buyers(t, product)) <= has


def test_abnormal_never_extracted(td):
    t = td.campaign
    abn = _ids(t.abnormal)
    assert abn
    for df in (A.all_users(t), A.order_behavior(t, "2002-01-01"), A.winners(t, "Lucky Day"),
               A.buyers(t, "Instant", "2002-01-01"), A.draw_game_players(t), A.product_combinations(t),
               A.top_n(t, "Lucky Day", 1000, "Turnover"), A.rfm_segment(t, "Loyal"), A.deposit_behavior(t),
               A.wallet_balance(t, "2002-01-01"), A.bank_declined(t)):
        assert not (_ids(df) & abn)


def test_sections_add_up(td):
    t = td.campaign
    ids = X.audience(td.table("upload_audience"))
    base = X.activity_base(t, ids, START, END)
    by_user = X.activity_by_user(base)
    tot = by_user.agg(F.count("*").alias("n"), F.sum("Ticket_sold").alias("tk"), F.sum("Turnover").alias("to")) \
        .collect()[0]
    for df, players, tickets in ((X.activity_by_ticket_segment(by_user), "Player", "Ticket_sold"),
                                 (X.reactivation(by_user, X.inactive_months(t, ids, START)),
                                  "Reactivated player", "Ticket sold")):
        s = df.agg(F.sum(F.col(f"`{players}`")).alias("n"), F.sum(F.col(f"`{tickets}`")).alias("tk"),
                   F.sum("Turnover").alias("to")).collect()[0]
        assert (s.n, s.tk, s.to) == (tot.n, tot.tk, tot.to)
    p = X.activity_by_product(base).agg(F.sum("Ticket_sold").alias("tk"), F.sum("Turnover").alias("to")).collect()[0]
    assert (p.tk, p.to) == (tot.tk, tot.to)


def test_report_bundle_sections_in_order(td):
    t = td.campaign
    rep = X.campaign_report(t, td.table("upload_audience"), START, END, "Campaign")
    assert list(rep["sections"]) == list(X.REPORT_SECTIONS)
    assert rep["empty"] is False
    ov = rep["sections"]["overview"].collect()[0]
    assert ov.Receiver == 51 and ov.Active_players == 30
    ticket_order = [r.ticket_segment for r in rep["sections"]["by_ticket"].collect()]
    assert ticket_order == [x for x in X.TICKET_LABELS if x in ticket_order]
    react = [r.inactive_month for r in rep["sections"]["reactivation"].collect()]
    nums = [int(x.split()[1]) for x in react if x != "FTP"]
    assert nums == sorted(nums)


def test_keyed_update_keeps_unmatched_rows(td):
    users = td.table("dim_user_authentication")
    out = S.update_status(users, td.table("upload_rg_limit"), td.table("upload_opt_out"),
                          td.table("upload_user_status"), rg_id_column="user_id", status_id_column="user_id",
                          status_column="user_status")
    assert out.columns == users.columns and out.count() == users.count()
    touched = _ids(td.table("upload_rg_limit").withColumnRenamed("user_id", "User_ID")) \
        | _ids(td.table("upload_opt_out").withColumnRenamed("user_id", "User_ID")) \
        | _ids(td.table("upload_user_status").withColumnRenamed("user_id", "User_ID"))
    untouched_before = users.filter(~F.col("User_ID").isin(list(touched)))
    untouched_after = out.filter(~F.col("User_ID").isin(list(touched)))
    assert untouched_before.exceptAll(untouched_after).count() == 0
    assert untouched_after.exceptAll(untouched_before).count() == 0
    # the must-exclude list follows the updated snapshot
    assert _ids(A.abnormal_users(out)) >= _ids(A.abnormal_users(users))


def test_with_users_refreshes_must_exclude(td):
    t = td.campaign
    updated = S.update_status(t.users, td.table("upload_rg_limit"), td.table("upload_opt_out"),
                              td.table("upload_user_status"), rg_id_column="user_id", status_id_column="user_id",
                              status_column="user_status")
    t2 = t.with_users(updated)
    assert _ids(A.must_exclude(t2)) == _ids(A.abnormal_users(updated))
    assert _ids(A.must_exclude(t2)) > _ids(A.must_exclude(t))
    assert not (_ids(A.deposit_behavior(t2)) & _ids(A.must_exclude(t2)))
