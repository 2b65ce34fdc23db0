"""Every registered query against its DuckDB SQL on the derived test views."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as E
from campaignlab.operators.activity import STAT_NAMES, TICKET_LABELS
from campaignlab.plans import load_all
from campaignlab.sources.fixtures import BASE_TABLES, TestData
from tests.oracle import compare, compare_pandas, duck_connect

NAMES = sorted(load_all())  # the campaign queries; corpus queries have tests of their own

# Queries re-checked at sf0.01 (the correctness gate size): one per operator family.
SF01 = ["order_behavior", "wallet_balance", "top_per_draw_instant", "non_buyers", "bank_declined",
        "activity_stats", "reactivation", "status_update_all"]


@pytest.fixture(scope="module")
def duck001(sf001):
    return duck_connect(sf001)


@pytest.fixture(scope="module")
def duck01(sf01):
    return duck_connect(sf01)


def test_every_query_has_sql():
    missing = set(NAMES) - set(E.oracle_sql())
    assert not missing, f"queries without oracle SQL: {missing}"


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql_sf0001(spark, sf001, duck001, name):
    ok, msg = compare(spark, name, sf001, duck001)
    assert ok, msg


@pytest.mark.parametrize("name", SF01)
def test_matches_sql_sf001(spark, sf01, duck01, name):
    ok, msg = compare(spark, name, sf01, duck01)
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["User_ID", "balance", "Withdrawable_amount", "balance_group", "inactive_days"]
    assert df.count() > 0


def test_matches_sql_through_pandas_and_survey_counts(spark, sf001, duck001):
    bad, counts = [], {}
    for n in NAMES:
        pdf = E.queries()[n](spark, sf001).toPandas()
        counts[n] = len(pdf)
        ok, msg = compare_pandas(spark, n, sf001, duck001, spark_pdf=pdf)
        if not ok:
            bad.append(msg)
    assert not bad, bad
    assert {n: counts[n] for n in SURVEY_COUNTS_SF0001} == SURVEY_COUNTS_SF0001


_TYPE_NAMES = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "StringType()": "VARCHAR", "DateType()": "DATE",
               "TimestampNTZType()": "TIMESTAMP", "DoubleType()": "DOUBLE", "BooleanType()": "BOOLEAN"}


def _spark_type(t):
    if hasattr(t, "precision"):
        return f"DECIMAL({t.precision},{t.scale})"
    return _TYPE_NAMES.get(repr(t), repr(t))


def test_column_types_match_sql(spark, sf001, duck001):
    bad = {}
    for n in NAMES:
        s = {f.name: _spark_type(f.dataType) for f in E.queries()[n](spark, sf001).schema.fields}
        rel = duck001.sql(E.oracle_sql()[n])
        d = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        if s != d:
            bad[n] = {c: (s.get(c), d.get(c)) for c in set(s) | set(d) if s.get(c) != d.get(c)}
    assert not bad, bad


# Row counts at sf0.001 (those of SURVEY §7.2, taken anew over the uncut fixture views).
SURVEY_COUNTS_SF0001 = {
    "all_users": 141, "order_behavior": 142, "winners_all": 522, "winners_by_draw": 17, "winners_by_series": 3,
    "buyers": 123, "draw_game_by_draw": 5, "draw_game_all": 58, "non_buyers": 37, "product_combinations": 142,
    "only_buyers": 18, "top_overall_series": 50, "top_overall_price": 50, "top_per_draw": 20, "rfm_segment": 32,
    "rfm_segments": 5, "deposit_behavior": 144, "wallet_balance": 139, "bank_declined": 125, "must_exclude": 7,
    "ticket_prices": 5, "audience": 51, "activity_base": 74, "activity_by_user": 30, "activity_by_product": 4,
    "activity_by_ticket_segment": 6, "activity_deposits": 30, "inactive_months": 50, "reactivation": 12,
    "reactivation_early": 5, "rg_limit_update": 150, "opt_out_update": 150, "user_status_update": 150,
    "status_update_all": 150,
}


# Ordered results: sort key of each row, ascending.
_MONTHS = lambda r: (r.inactive_month == "FTP", int("".join(c for c in r.inactive_month if c.isdigit()) or 0))
ORDERED = {
    "winners_all": lambda r: (-r.Draw_Period, r.User_ID),
    "top_overall": lambda r: (-r.Prize, r.User_ID),
    "top_overall_series": lambda r: (-r.Turnover, r.User_ID),
    "top_overall_price": lambda r: (-r.Ticket, r.User_ID),
    "activity_by_ticket_segment": lambda r: TICKET_LABELS.index(r.ticket_segment),
    "activity_stats": lambda r: STAT_NAMES.index(r.stat),
    "reactivation": _MONTHS,
    "reactivation_early": _MONTHS,
}


@pytest.mark.parametrize("name", ORDERED)
def test_ordered_results(spark, sf001, name):
    keys = [ORDERED[name](r) for r in E.queries()[name](spark, sf001).collect()]
    assert len(keys) > 1 and keys == sorted(keys)


# Queries that write and read files, or look at the campaigns' windows first.
WITH_JOBS = {"audience_csv_round_trip", "order_behavior_stored", "wallet_balance_at", "wallet_balance_clustered",
             "status_update_partial", "audience_sizes", "audience_algebra", "audience_criteria", "audience_numbered_files",
             "upload_quarantine", "inactive_months_maintained", "last_days_agree"}


# Building a plan runs nothing but schema reads of the inputs.
def test_building_plans_runs_no_query_jobs(spark, sf001):
    specs = {n: s for n, s in load_all().items() if n not in WITH_JOBS and not n.startswith("campaigns_")}
    td = TestData(spark, sf001)
    for t in BASE_TABLES:
        td.table(t)
    spark.sparkContext.setJobGroup("plans", "building plans")
    try:
        for s in specs.values():
            s.build(td)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plans")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name", ["winners_by_draw", "winners_by_series", "buyers", "order_behavior", "wallet_balance"])
def test_exclusion_reuses_the_shuffle_by_user(spark, sf001, name):
    """Without broadcasts only the list is shuffled besides the rows: two exchanges by user alone."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        td = TestData(spark, sf001)
        df = load_all()[name].build(td)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        assert len(re.findall(r"hashpartitioning\(User_ID#\d+, \d+\)", buf.getvalue())) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
