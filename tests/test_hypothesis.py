"""Randomised checks of the building blocks against plain-Python models."""

import statistics
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from campaignlab.functions.quantile import grouped_median
from campaignlab.operators import activity as X
from campaignlab.operators import status as S
from tests.helpers import frame, user

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def _ticket_model(v):
    if v is None:
        return ">200"
    if v == 1:
        return "1"
    for edge, label in zip(X.TICKET_EDGES[1:], X.TICKET_LABELS[1:]):
        if v <= edge:
            return label
    return ">200"


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.integers(-5, 400)), min_size=1, max_size=40))
def test_ticket_segment_model(spark, vals):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v bigint")
    got = [r.s for r in df.select("i", X.ticket_segment(F.col("v")).alias("s")).orderBy("i").collect()]
    assert got == [_ticket_model(v) for v in vals]


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(-1000, 1000)), min_size=0, max_size=60))
def test_grouped_median_model(spark, rows):
    df = spark.createDataFrame([(g, Decimal(v) / 100) for g, v in rows], "g string, v decimal(18,2)")
    got = {r.g: Decimal(r.median) for r in grouped_median(df.repartition(3), "g", "v").collect()}
    want = {}
    for g in {g for g, _ in rows}:
        vs = sorted(Decimal(v) / 100 for gg, v in rows if gg == g)
        want[g] = Decimal(statistics.median(vs))
    q = Decimal("0.001")
    assert {k: v.quantize(q, ROUND_HALF_UP) for k, v in got.items()} == \
        {k: v.quantize(q, ROUND_HALF_UP) for k, v in want.items()}


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 12), st.sampled_from(["active", "close", "locked"])), max_size=25))
def test_keyed_update_model(spark, ups):
    users = frame(spark, "dim_user_authentication", [user(str(i)) for i in range(10)])
    # keep one value per id so the upload is conflict-free
    model = {}
    for k, v in ups:
        model.setdefault(str(k), v)
    up = spark.createDataFrame([(k, v) for k, v in model.items()] + [(k, v) for k, v in model.items()],
                               "`User ID` string, `User Status` string")
    out = {r.User_ID: r.user_status for r in S.apply_user_status(users, up).collect()}
    assert out == {str(i): model.get(str(i), "active") for i in range(10)}
