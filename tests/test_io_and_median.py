"""CSV round trips, upload reading, JDBC argument checks, exact median."""

import glob
import random
import statistics
import tempfile
from decimal import ROUND_HALF_UP, Decimal

import pytest

from campaignlab.functions.quantile import grouped_median, median_frame
from campaignlab.operators.activity import load_audience
from campaignlab.sources import jdbc
from campaignlab.sources.uploads import read_upload, write_audience_csv


def _scratch():
    return tempfile.mkdtemp(prefix="campaignlab-test-")


def test_csv_export_drops_null_key_keeps_empty_and_newlines(spark):
    df = spark.createDataFrame([("a", "x"), (None, "lost"), ("", "empty"), ("b", "two\nlines")],
                               "User_ID string, note string")
    out = _scratch() + "/aud"
    write_audience_csv(df, out, single_file=True)
    assert len(glob.glob(out + "/part-*.csv")) == 1
    back = read_upload(spark, out, multi_line=True)
    rows = sorted((r.User_ID or "", r.note) for r in back.collect())
    assert rows == [("", "empty"), ("a", "x"), ("b", "two\nlines")]


def test_upload_reads_text_ids_and_casts(spark):
    p = _scratch() + "/up.csv"
    with open(p, "w") as f:
        f.write("User ID,User Status\n00123,close\n123,locked\n 7 ,active\n")
    df = read_upload(spark, p, {"User ID": "string", "User Status": "string"})
    assert sorted(r["User ID"] for r in df.collect()) == [" 7 ", "00123", "123"]
    with pytest.raises(ValueError):
        read_upload(spark, p, {"missing": "string"})
    p2 = _scratch() + "/aud.csv"
    with open(p2, "w") as f:
        f.write("User_ID\n00123\n00123\n 7\n")
    assert sorted(r.User_ID for r in load_audience(spark, p2).collect()) == ["00123", "7"]


def test_jdbc_argument_checks(spark):
    with pytest.raises(ValueError):
        jdbc.read_jdbc(spark, "jdbc:none", table="a", query="select 1")
    with pytest.raises(ValueError):
        jdbc.read_jdbc(spark, "jdbc:none", query="select 1", partition_column="id", lower_bound=0,
                       upper_bound=10, num_partitions=2)
    with pytest.raises(ValueError):
        jdbc.read_jdbc(spark, "jdbc:none", table="t", partition_column="id")


def test_jdbc_table_set_needs_bounds(spark):
    with pytest.raises(ValueError):
        jdbc.load_tables_jdbc(spark, "jdbc:none", partitions={"fact_orders": ("DateID", None, None, 4)})
    with pytest.raises(ValueError, match="unknown table"):
        jdbc.load_tables_jdbc(spark, "jdbc:none", partitions={"orders": ("DateID", "2020-01-01", "2021-01-01", 4)})


def _exact_median(xs):
    m = Decimal(str(statistics.median(sorted(Decimal(str(x)) for x in xs))))
    return m.quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_median_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    n = rnd.randint(1, 3000)
    # heavy duplicates plus one hot value holding a third of the rows
    xs = [round(rnd.choice([rnd.uniform(-50, 500), rnd.randint(0, 20)]), 2) for _ in range(n)]
    xs += [7.5] * (n // 2)
    df = spark.createDataFrame([(Decimal(str(x)),) for x in xs], "v decimal(18,2)")
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        got = median_frame(df.repartition(7), "v").collect()[0].median
        spark.conf.unset("spark.sql.exchange.reuse")
        assert Decimal(got).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP) == _exact_median(xs)


def test_median_of_many_values_without_exchange_reuse(spark):
    """Two million distinct values in two groups, one of them negative."""
    n = 1_000_001
    df = spark.range(2 * n).selectExpr("id % 2 as k", "cast((id div 2) * 7919 % 1000003 * (1 - 2 * (id % 2)) / 100 as decimal(18,2)) as v")
    values = sorted(i * 7919 % 1000003 for i in range(n))
    want = Decimal(values[n // 2]) / 100
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {r.k: r.median for r in grouped_median(df, "k", "v").collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert got == {0: want, 1: -want}


def test_median_of_nothing_is_null(spark):
    df = spark.createDataFrame([(None,)], "v decimal(18,2)")
    assert median_frame(df, "v").collect()[0].median is None
