"""The streaming activity monitor ends with the batch activity base."""

import tempfile

from campaignlab.operators import activity as X
from campaignlab.sources.fixtures import TestData
from campaignlab.streaming.activity import current_activity, start_activity_monitor, upserted_activity

START, END = "2000-01-01 00:00:00", "2000-06-30 23:59:00"


def _rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.select("User_ID", "Lottery", "Ticket_sold", "Turnover",
                                                             "Prize").collect())


def test_monitor_matches_batch(spark, sf001):
    td = TestData(spark, sf001)
    t = td.campaign
    ids = X.audience(td.table("upload_audience"))
    scratch = tempfile.mkdtemp(prefix="campaignlab-stream-")
    orders = t.orders.select(*[c for c in t.orders.columns if c in
                               ("User_ID", "GameID", "Lottery", "Creation_date", "DateID", "Draw_Period",
                                "Series_No", "Entries", "Turnover", "Prize")])
    # orders arrive as several files
    orders.repartition(4).write.parquet(scratch + "/orders")
    q = start_activity_monitor(spark, scratch + "/orders", ids, START, END, scratch + "/out",
                               scratch + "/ckpt", trigger_seconds=1, max_files_per_trigger=1)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = current_activity(spark, scratch + "/out")
    assert _rows(got) == _rows(X.activity_base(t, ids, START, END))


def test_upserts_end_with_the_batch_result(spark, sf001):
    """Only changed totals are written: later triggers with few users leave other folders alone."""
    import glob

    td = TestData(spark, sf001)
    t, ids = td.campaign, X.audience(td.table("upload_audience"))
    scratch = tempfile.mkdtemp(prefix="campaignlab-stream-")
    orders = t.orders.select(*[f for f in ("User_ID", "GameID", "Lottery", "Creation_date", "DateID", "Draw_Period", "Series_No",
                                           "Entries", "Turnover", "Prize")])
    one = orders.filter("User_ID = '3'")
    orders.filter("User_ID <> '3'").repartition(3).write.parquet(scratch + "/orders")
    run = lambda: start_activity_monitor(spark, scratch + "/orders", ids, START, END, scratch + "/out", scratch + "/ckpt",
                                         trigger_seconds=1, max_files_per_trigger=1, upsert_parts=8)
    q = run()
    try:
        q.processAllAvailable()
        before = set(glob.glob(scratch + "/out/upserts/*/*.parquet"))
        one.coalesce(1).write.mode("append").parquet(scratch + "/orders")
        q.processAllAvailable()
    finally:
        q.stop()
    after = set(glob.glob(scratch + "/out/upserts/*/*.parquet"))
    assert len({f.split("user_part=")[1].split("/")[0] for f in after - before}) <= 1
    assert _rows(upserted_activity(spark, scratch + "/out")) == _rows(X.activity_base(t, ids, START, END))
