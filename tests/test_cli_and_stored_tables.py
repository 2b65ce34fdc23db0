"""Stored table sets (save/load), the reference-named entry points and the CLI."""

import glob
import tempfile

import pytest

from campaignlab.__main__ import main
from campaignlab.operators import audience as A
from campaignlab.plans.extract import OPERATORS, export_audience, extract_data
from campaignlab.sources.fixtures import TestData
from campaignlab.sources.tables import SchemaError, load_tables, save_tables, validate


@pytest.fixture(scope="module")
def stored(spark, sf001):
    out = tempfile.mkdtemp(prefix="campaignlab-tables-") + "/t"
    save_tables(TestData(spark, sf001).campaign, out)
    return out


def _rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_stored_tables_give_same_results(spark, sf001, stored):
    derived = TestData(spark, sf001).campaign
    t = load_tables(spark, stored)
    assert glob.glob(stored + "/fact_orders/DateID=*")  # day-partitioned facts
    for op in (lambda x: A.wallet_balance(x, "2002-01-01"), lambda x: A.non_buyers(x, "Pick 3"),
               lambda x: A.top_n(x, "Lucky Day", 10, "Turnover", draws=[60, 61])):
        assert _rows(op(t)) == _rows(op(derived))


def test_day_partition_pruning_keeps_results(spark, sf001, stored):
    import contextlib
    import io

    from campaignlab.operators import activity as X

    derived_td = TestData(spark, sf001)
    t = load_tables(spark, stored)
    assert t.orders_day == "DateID"
    ids = X.audience(derived_td.table("upload_audience"))
    for start, end in (("2000-01-01 00:00:00", "2000-06-30 23:59:00"), ("1995-06-01 12:00:00", "1995-06-02 08:00:00")):
        got = X.activity_base(t, ids, start, end)
        assert _rows(got) == _rows(X.activity_base(derived_td.campaign, ids, start, end))
        assert _rows(X.inactive_months(t, ids, start)) == _rows(X.inactive_months(derived_td.campaign, ids, start))
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            got.explain("formatted")
        assert "PartitionFilters: [isnotnull(DateID" in buf.getvalue()


def test_validate_reports_missing_columns(spark):
    df = spark.createDataFrame([("1",)], "User_ID string")
    with pytest.raises(SchemaError):
        validate(df, "fact_orders")


def test_extract_data_dispatch(spark, stored):
    t = load_tables(spark, stored)
    cases = {
        "All users": {}, "RFM Segments": {"segment": "Loyal"}, "Order behavior": {},
        "Players by Lottery Type": {"buy_or_not": "Buy product", "by_product": "Lucky Day", "get_LD_player": True,
                                    "draw_period": [60, 61]},
        "Winners by Lottery Type": {"by_product": "Pick 3", "draw_period": []},
        "Top N by Draw series": {"by_product": "Instant", "ticket_price": "All Instant games", "top": 5,
                                 "by_field": "Prize", "draw_period": []},
        "Deposit behavior": {}, "Wallet balance": {}, "Bank-declined users": {}, "Users must exclude": {},
    }
    assert set(cases) == set(OPERATORS)
    for op, f in cases.items():
        df = extract_data(t, op, f, as_of="2002-01-01")
        assert df.columns[0] in ("User_ID", "Draw_Period")
    for mode in ("Not buy product", "Only buy product", "All combinations", "Buy product"):
        extract_data(t, "Players by Lottery Type", {"buy_or_not": mode, "by_product": "Instant"}).columns
    with pytest.raises(ValueError):
        extract_data(t, "Nope")
    with pytest.raises(TypeError):
        extract_data(t, "Winners by Lottery Type", {"by_product": "Lucky Day", "draw_period": ["x"]})


def test_export_counts_and_writes_once(spark, stored):
    t = load_tables(spark, stored)
    out = tempfile.mkdtemp(prefix="campaignlab-exp-") + "/aud"
    n = export_audience(A.rfm_segment(t, "Loyal"), out, single_file=True)
    files = glob.glob(out + "/part-*.csv")
    assert len(files) == 1
    with open(files[0]) as fh:
        assert len(fh.read().splitlines()) == n + 1


def test_cli_commands(spark, sf001, stored, capsys):
    scratch = tempfile.mkdtemp(prefix="campaignlab-cli-")
    assert main(["extract", "--tables", stored, "--operator", "Wallet balance", "--as-of", "2002-01-01",
                 "--out", scratch + "/wallet"]) == 0
    assert "Extracted" in capsys.readouterr().out
    with open(scratch + "/aud.csv", "w") as f:
        f.write("User_ID\n" + "\n".join(str(i) for i in range(3, 150, 3)) + "\n")
    assert main(["activity", "--tables", stored, "--audience", scratch + "/aud.csv", "--start",
                 "2000-01-01 00:00:00", "--end", "2000-06-30 23:59:00", "--out", scratch + "/report"]) == 0
    for sec in ("overview", "deposit", "stats", "by_product", "by_ticket", "reactivation", "_header"):
        assert glob.glob(f"{scratch}/report/{sec}/part-*")
    with open(scratch + "/rg.csv", "w") as f:
        f.write("User ID\n11\n22\n")
    with open(scratch + "/opt.csv", "w") as f:
        f.write("user_id,message_status,mail_status,sms_status,updated_time\n13,0,1,0,2001-02-01\n")
    with open(scratch + "/st.csv", "w") as f:
        f.write("User ID,User Status\n17,close\n")
    assert main(["update-status", "--tables", stored, "--rg-limit", scratch + "/rg.csv", "--opt-out",
                 scratch + "/opt.csv", "--user-status", scratch + "/st.csv", "--out", scratch + "/users"]) == 0
    users = {r.User_ID: r for r in spark.read.parquet(scratch + "/users").collect()}
    assert users["11"].RG_limit == 1 and users["13"].receive_message == 0 and users["17"].user_status == "close"
    assert len(users) == 150


def test_cli_snapshot_campaigns_and_numbered_files(spark, stored, capsys):
    scratch = tempfile.mkdtemp(prefix="campaignlab-cli-")

    def csv(name, text):
        with open(f"{scratch}/{name}.csv", "w") as f:
            f.write(text)
        return f"{scratch}/{name}.csv"

    assert main(["save-snapshot", "--tables", stored, "--snapshot", scratch + "/users", "--parts", "8"]) == 0
    assert main(["update-snapshot", "--snapshot", scratch + "/users", "--rg-limit", csv("rg", "User ID\n11\n"),
                 "--user-status", csv("st", "User ID,User Status\n17,close\n")]) == 0
    assert "rewrote 1 folders" in capsys.readouterr().out.replace("rewrote 2", "rewrote 1")
    users = {r.User_ID: r for r in spark.read.parquet(scratch + "/users").collect()}
    assert users["11"].RG_limit == 1 and users["17"].user_status == "close" and len(users) == 150
    ids = "".join(f"a,{i}\nb,{i + 1}\n" for i in range(3, 140, 3))
    assert main(["campaigns", "--tables", stored, "--campaigns", csv("c", "campaign,start,end\na,1999-01-01 00:00:00,1999-12-31 23:59:00\n"
                 "b,1999-06-01 00:00:00,2000-06-30 23:59:00\n"), "--audiences", csv("i", "campaign,User_ID\n" + ids),
                 "--out", scratch + "/many"]) == 0
    overview = spark.read.option("header", True).csv(scratch + "/many/overview").collect()
    assert {r.campaign: r.Receiver for r in overview} == {"a": "46", "b": "46"}
    assert {f.split("/")[-1] for f in glob.glob(scratch + "/many/*")} == {"overview", "deposit", "stats", "by_product", "by_ticket",
                                                                          "reactivation", "empty"}
    assert main(["extract", "--tables", stored, "--operator", "Top N by Draw series", "--filters",
                 '{"by_product": "Lucky Day", "top": 25}', "--rows-per-file", "10", "--out", scratch + "/top"]) == 0
    assert "3 files" in capsys.readouterr().out and len(glob.glob(scratch + "/top/file=*/part-*.csv")) == 3
