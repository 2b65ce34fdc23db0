"""Many campaigns in one pass, audience algebra, numbered files, upload quarantine."""

import contextlib
import csv
import glob
import io
import os
import tempfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from campaignlab.functions.numbering import numbered
from campaignlab.operators import activity as X
from campaignlab.operators import algebra as G
from campaignlab.operators import audience as A
from campaignlab.operators.campaigns import CampaignSet
from campaignlab.plans.extract import audience_size, export_audience
from campaignlab.sources.fixtures import TestData
from campaignlab.sources.uploads import read_upload_checked, write_audience_files
from tests.helpers import order, tables


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def td(spark, sf001):
    return TestData(spark, sf001)


# ------------------------------------------------------------------ campaigns
def test_sections_equal_single_checks(spark, td):
    many = CampaignSet(td.campaign, td.table("campaign_windows"), td.table("campaign_audiences"))
    for w in many.windows.collect():
        ids = X.audience(td.table("campaign_audiences").filter(F.col("campaign") == w.campaign))
        base = X.activity_base(td.campaign, ids, w.start, w.end)
        by_user, deposits = X.activity_by_user(base), X.activity_deposits(td.campaign, ids, w.start, w.end)
        history = X.inactive_months(td.campaign, ids, w.start)
        pairs = [(many.base, base), (many.by_product(), X.activity_by_product(base)), (many.deposits, deposits),
                 (many.by_ticket_segment(), X.activity_by_ticket_segment(by_user)), (many.inactive_months(), history),
                 (many.reactivation(), X.reactivation(by_user, history)), (many.stats(), X.activity_stats(by_user)),
                 (many.summary(), X.activity_summary(ids, by_user)), (many.deposit_summary(), X.deposit_summary(deposits)),
                 (many.empty(), X.empty_signal(base))]
        for got, want in pairs:
            mine = got.filter(F.col("campaign") == w.campaign).drop("campaign").select(*want.columns)
            assert rows(mine) == rows(want), (w.campaign, want.columns)


def test_no_join_by_time_alone(spark, td):
    many = CampaignSet(td.campaign, td.table("campaign_windows"), td.table("campaign_audiences"))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        for df in (many.base, many.deposits, many.inactive_months()):
            df.explain()
    assert "NestedLoop" not in buf.getvalue() and "Cartesian" not in buf.getvalue()


def test_overlaps_bounds_and_odd_campaigns(spark):
    t = tables(spark, orders=[order("2", when="2000-01-31 23:59:59"), order("2", when="2000-02-01 00:00:00"), order("3")])
    windows = spark.createDataFrame(
        [("a", "2000-01-01 00:00:00", "2000-01-31 23:59:59"), ("b", "2000-01-31 23:59:59", "2000-02-01 00:00:00"), (" b", "2000-01-31 23:59:59", "2000-02-01 00:00:00"),
         ("backwards", "2000-03-01 00:00:00", "2000-01-01 00:00:00"), (None, "2000-01-01", "2000-01-02")], "campaign string, start string, end string")
    ids = spark.createDataFrame([("a", "2"), ("a", " 2"), ("b", "2"), ("b", None), (None, "2"), ("backwards", "2"), ("nowhere", "2")],
                                "campaign string, User_ID string")
    got = CampaignSet(t, windows, ids)
    assert {(r.campaign, r.User_ID, r.Ticket_sold) for r in got.base.collect()} == {("a", "2", 1), ("b", "2", 2)}
    assert {(r.campaign, r.empty) for r in got.empty().collect()} == {("a", False), ("b", False), ("backwards", True)}
    none = CampaignSet(t, windows.limit(0), ids)
    assert none.base.count() == none.summary().count() == none.stats().count() == 0
    for bad in ([("a", "soon", "2000-01-01")], [("a", "2000-01-01", "2000-01-02"), ("a", "2000-01-01", "2000-01-03")]):
        with pytest.raises(Exception, match="not a time|two windows"):
            CampaignSet(t, spark.createDataFrame(bad, windows.schema), ids).base.collect()


# ------------------------------------------------------------------ algebra
@pytest.fixture(scope="module")
def bitmaps(spark, td):
    folder = tempfile.mkdtemp(prefix="campaignlab-bitmaps-")
    G.UserBitmaps.build(G.memberships(td.campaign)).save(folder)
    return G.UserBitmaps.load(spark, folder)


PRODUCTS = ["Lucky Day", "Instant", "Pick 3", "Merchant App"]


@pytest.mark.parametrize("product", PRODUCTS)
def test_sizes_equal_each_mode(td, bitmaps, product):
    t = td.campaign
    want = {"Buy product": A.buyers(t, product), "Not buy product": A.non_buyers(t, product), "Only buy product": A.only_buyers(t, product),
            "All combinations": A.product_combinations(t), "RFM Segments": A.rfm_segment(t, "Loyal"), "Users must exclude": A.must_exclude(t)}
    got = {r.audience: r.audience_size for r in bitmaps.sizes(G.audience_modes(product, PRODUCTS, "Loyal")).collect()}
    assert got == {k: audience_size(v).first()[0] for k, v in want.items()}


def test_members_equal_operators(td, bitmaps):
    modes = G.audience_modes("Pick 3", PRODUCTS, "Loyal")
    assert rows(bitmaps.members(modes["Not buy product"])) == rows(A.non_buyers(td.campaign, "Pick 3").select("User_ID"))
    assert rows(bitmaps.members(modes["RFM Segments"])) == rows(A.rfm_segment(td.campaign, "Loyal").select("User_ID"))


def test_questions_read_no_orders_and_their_criteria_only(bitmaps):
    df = bitmaps.sizes({"x": G.has("bought Instant") & ~G.has("must exclude")})
    assert all("/words/" in f for f in df.inputFiles())
    assert "criterion" in df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


NAMES = ["a", "b", "c"]
SETS = {}


@pytest.fixture(scope="module")
def small(spark):
    import random

    g = random.Random(5)
    SETS.update({c: {f"u{k}" for k in range(300) if g.random() < p} for c, p in zip(NAMES, (0.5, 0.2, 0.7))})
    members = [(c, u) for c, us in SETS.items() for u in us] * 2
    b = G.UserBitmaps.build(spark.createDataFrame(members, "criterion string, User_ID string").repartition(7))
    return G.UserBitmaps(b.numbers.persist(), b.words.persist())


EXPRESSIONS = st.recursive(st.sampled_from(NAMES + ["nobody"]).map(G.has), lambda x: st.one_of(
    x.map(lambda a: ~a), st.tuples(x, x).map(lambda p: p[0] & p[1]), st.tuples(x, x).map(lambda p: p[0] | p[1])), max_leaves=6)


def plain(e):
    every = set().union(*SETS.values())
    if e.op == "has":
        return SETS.get(e.parts[0], set())
    if e.op == "not":
        return every - plain(e.parts[0])
    a, b = map(plain, e.parts)
    return a & b if e.op == "and" else a | b


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(e=EXPRESSIONS)
def test_any_expression(small, e):
    want = plain(e)
    assert small.sizes({"x": e}).first()["audience_size"] == len(want)
    assert {r.User_ID for r in small.members(e).collect()} == want


def test_algebra_of_nobody(spark):
    b = G.UserBitmaps.build(spark.createDataFrame([], "criterion string, User_ID string"))
    assert b.sizes({"x": ~G.has("a")}).first()["audience_size"] == 0 and b.members(~G.has("a")).count() == 0


# ------------------------------------------------------------------ numbers and files
def test_numbers_are_consecutive_and_in_order(spark):
    df = numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).orderBy("k"))
    got = sorted((r.n, r.k) for r in df.collect())
    assert [n for n, _ in got] == list(range(1, 1001)) and [k for _, k in got] == sorted(k for _, k in got)
    assert numbered(spark.range(0)).count() == 0


@pytest.mark.parametrize("n,k", [(1000, 300), (900, 300), (5, 300), (0, 300), (7, 1)])
def test_files_of_exactly_k_rows(spark, n, k):
    folder = tempfile.mkdtemp(prefix="campaignlab-files-") + "/f"
    df = spark.range(n).select(F.format_string("%06d", (F.col("id") * 7919) % 100003).alias("User_ID"), F.lit('a,"b').alias("x"))
    odd = df.unionByName(spark.createDataFrame([(None, "lost")], "User_ID string, x string"))
    assert write_audience_files(odd.orderBy("User_ID"), folder, k) == -(-n // k)
    names, back = glob.glob(f"{folder}/file=*"), []
    assert len(names) == -(-n // k)
    for f in sorted(names, key=lambda x: int(x.split("=")[-1])):
        parts = glob.glob(f"{f}/part-*.csv")
        assert len(parts) == 1
        with open(parts[0], newline="") as fh:
            lines = list(csv.reader(fh))
        assert lines[0] == ["User_ID", "x"]
        back.append([x[0] for x in lines[1:]])
    assert all(len(b) == k for b in back[:-1]) and sum(map(len, back)) == n
    assert [x for b in back for x in b] == sorted(r.User_ID for r in df.collect())


def test_export_counts_as_it_writes(spark, td):
    out = tempfile.mkdtemp(prefix="campaignlab-exp-") + "/aud"
    jobs = lambda: set(spark.sparkContext.statusTracker().getJobIdsForGroup("export"))
    spark.sparkContext.setJobGroup("export", "one write")
    try:
        n = export_audience(A.rfm_segment(td.campaign, "Loyal"), out)
        checkpoints = [j for j in jobs() if "checkpoint" in str(spark.sparkContext.statusTracker().getJobInfo(j))]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert n == A.rfm_segment(td.campaign, "Loyal").count() and not checkpoints
    assert sum(len(open(f).read().splitlines()) - 1 for f in glob.glob(out + "/part-*.csv")) == n


# ------------------------------------------------------------------ quarantine
def upload(text):
    path = tempfile.mkdtemp(prefix="campaignlab-up-") + "/u.csv"
    with open(path, "w") as f:
        f.write(text)
    return path


def test_every_line_is_good_or_rejected(spark):
    path = upload('user_id,flag,day,note\n001,1,2000-01-01,"a,b"\n2,x,2000-01-01,\n3,1,soon,n\n4,1\n5,1,2000-01-02,n,more\n'
                  ',1,2000-01-01,n\n6,,,\n7,x,never,n\n')
    got = read_upload_checked(spark, path, {"user_id": "string", "flag": "int", "day": "date"}, required=["user_id"])
    assert {(r.user_id, r.flag, str(r.day)) for r in got.good.collect()} == {("001", 1, "2000-01-01"), ("6", None, "None")}
    bad = {r.line: r.reason for r in got.rejected.collect()}
    assert set(bad.values()) == {"flag: not a int", "day: not a date", "malformed line", "user_id: no value",
                                 "flag: not a int; day: not a date"}
    assert bad["4,1"] == bad["5,1,2000-01-02,n,more"] == "malformed line" and bad["7,x,never,n"].count(":") == 2
    assert (got.n_good, got.n_rejected) == (2, 6) == (got.good.count(), got.rejected.count())


def test_quarantine_odd_files(spark):
    got = read_upload_checked(spark, upload("user_id,_line\n"), {"user_id": "string"})
    assert (got.n_good, got.n_rejected) == (0, 0) and got.good.columns == ["user_id"]
    got = read_upload_checked(spark, upload("user_id,_line\n1,x\n"), {"_line": "string"})
    assert got.good.first()["_line"] == "x"
    with pytest.raises(ValueError, match="missing"):
        read_upload_checked(spark, upload("user_id\n1\n"), {"flag": "int"})
