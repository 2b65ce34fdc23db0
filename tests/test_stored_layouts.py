"""Snapshots rewritten in part, tables clustered by user, checkpoint folder."""

import contextlib
import glob
import io
import os
import tempfile

import pytest

from campaignlab.operators import audience as A
from campaignlab.operators import status as S
from campaignlab.session import ensure_checkpoint_dir
from campaignlab.sources import snapshots as P
from campaignlab.sources.clustered import load_clustered, save_clustered
from campaignlab.sources.fixtures import TestData
from tests.helpers import deposit, frame, order, summary, tables, user


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="campaignlab-layout-") + "/t"


def rows(df):
    return sorted(map(str, df.collect()))


def files(path):
    return {f[len(path):] for f in glob.glob(f"{path}/*/*.parquet")}


# ------------------------------------------------------------------ snapshots
def test_only_touched_folders_get_new_files(spark, sf001, folder):
    users = TestData(spark, sf001).table("dim_user_authentication")
    P.save_snapshot(users, folder, parts=16)
    before = files(folder)
    rg = spark.createDataFrame([("11",), (" 22 ",), ("11",), (None,), ("999999999",)], "`User ID` string")
    status = spark.createDataFrame([("11", "close")], "`User ID` string, `User Status` string")
    touched = P.update_snapshot(spark, folder, rg_limit=rg, user_status=status)
    after = files(folder)
    mine = {r["p"] for r in spark.createDataFrame([("11",), ("22",), ("999999999",)], "u string").select(
        P.part_number("u", 16).alias("p")).collect()}
    assert 1 <= len(touched) <= 3 and set(touched) <= mine
    part = lambda f: int(f.split("=")[1].split("/")[0])
    assert {f for f in before if part(f) not in touched} == {f for f in after if part(f) not in touched}
    assert not {f for f in before if part(f) in touched} & after
    want = S.apply_user_status(S.apply_rg_limit(users, rg), status)
    got = P.read_snapshot(spark, folder)
    assert got.columns == users.columns and rows(got) == rows(want)


def test_snapshot_updates_add_up_and_can_run_again(spark, folder):
    users = frame(spark, "dim_user_authentication", [user(str(k)) for k in range(40)] + [user(None)])
    P.save_snapshot(users, folder, parts=4)
    opt = spark.createDataFrame([("3", 0, 1, 0, "2001-02-01"), ("3", 1, 1, 1, "2001-01-01")],
                                "user_id string, message_status int, mail_status int, sms_status int, updated_time string")
    rg = spark.createDataFrame([("3",), ("5",)], "`User ID` string")
    first = [P.update_snapshot(spark, folder, opt_out=opt), P.update_snapshot(spark, folder, rg_limit=rg)]
    before = files(folder)
    again = [P.update_snapshot(spark, folder, opt_out=opt), P.update_snapshot(spark, folder, rg_limit=rg)]
    assert all(first) and again == [[], []] and files(folder) == before  # what is set already is not written again
    got = {r.User_ID: r for r in P.read_snapshot(spark, folder).collect()}
    assert len(got) == 41 and got["3"].receive_message == 0 and got["3"].RG_limit == 1 and got["5"].RG_limit == 1
    assert got["4"].RG_limit == 0 and got[None].RG_limit == 0


def test_failed_and_empty_updates_change_nothing(spark, folder):
    users = frame(spark, "dim_user_authentication", [user(str(k)) for k in range(20)])
    P.save_snapshot(users, folder, parts=4)
    before = files(folder)
    clash = spark.createDataFrame([("1", "close"), ("1", "locked")], "`User ID` string, `User Status` string")
    with pytest.raises(Exception, match="conflicting"):
        P.update_snapshot(spark, folder, user_status=clash)
    empty = spark.createDataFrame([], "`User ID` string")
    unknown = spark.createDataFrame([(None,)], "`User ID` string")
    assert P.update_snapshot(spark, folder, rg_limit=empty) == P.update_snapshot(spark, folder, rg_limit=unknown) == []
    assert P.update_snapshot(spark, folder) == [] and files(folder) == before
    with pytest.raises(ValueError):
        P.save_snapshot(users, folder, parts=0)
    users.write.mode("overwrite").parquet(folder)
    with pytest.raises(ValueError):
        P.read_snapshot(spark, folder)


# ------------------------------------------------------------------ clustered
CASES = {
    "all_users": A.all_users,
    "order_behavior": lambda t: A.order_behavior(t, "2002-01-01"),
    "deposit_behavior": A.deposit_behavior,
    "wallet_balance": lambda t: A.wallet_balance(t, "2002-01-01"),
    "rfm_segment": lambda t: A.rfm_segment(t, "Loyal"),
}


@pytest.fixture(scope="module")
def clustered(spark, sf001):
    path = tempfile.mkdtemp(prefix="campaignlab-clustered-") + "/it's"
    derived = TestData(spark, sf001).campaign
    save_clustered(derived, path, buckets=8)
    return derived, load_clustered(spark, path, derived), path


@pytest.mark.parametrize("name", CASES)
def test_clustered_tables_need_no_exchange(spark, clustered, name):
    derived, t, _ = clustered
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = CASES[name](t)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        assert "Exchange" not in buf.getvalue() and "Bucketed: true" in buf.getvalue()
        assert rows(df) == rows(CASES[name](derived))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_clustered_layout(spark, clustered):
    derived, t, path = clustered
    assert t.by_user and not derived.by_user
    assert len(glob.glob(f"{path}/fact_deposit/*.parquet")) <= 8
    again = load_clustered(spark.newSession(), path, derived)  # another session knows the folder only
    assert again.deposits.count() == derived.deposits.count()
    with pytest.raises(ValueError):
        save_clustered(derived, path, only=("games",))
    part = tempfile.mkdtemp(prefix="campaignlab-clustered-") + "/p"
    save_clustered(derived, part, buckets=3, only=("orders_summary", "abnormal"))
    some = load_clustered(spark, part, derived)
    assert not some.by_user and rows(CASES["order_behavior"](some)) == rows(CASES["order_behavior"](derived))


def test_clustered_null_users_and_empty_tables(spark):
    path = tempfile.mkdtemp(prefix="campaignlab-clustered-") + "/n"
    t = tables(spark, deposits=[deposit(None), deposit("2"), deposit("3", state="Failure")],
               orders_summary=[summary(None), summary("2", turnover="30.00")])
    save_clustered(t, path, buckets=2)
    got = load_clustered(spark, path, t)
    assert got.by_user
    for f in CASES.values():
        assert rows(f(got)) == rows(f(t))


# ------------------------------------------------------------------ checkpoint folder
def test_no_checkpoint_folder_on_a_cluster_fails():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
