"""Campaign activity check (A1-A13): what an uploaded audience did in a time
window after a campaign.

The reference pulls results to the driver with 17 separate Spark actions;
here every section is a DataFrame and the report bundle materialises the
shared per-user base once (reliable checkpoint when the cluster names a
checkpoint folder), so each section reads the small base, not the facts.

Scale notes: the window filter on ``Creation_date`` reaches the parquet scan
(row groups are skipped by their min/max); a semi join with the audience drops
other users' rows before they are aggregated, at every size
(``aggregate_for_audience``); every grouping is map-side combined, and the few-group sections (product, ticket bucket,
reactivation bucket) never ship more than one partial row per group per task.
No activity operator excludes abnormal or test accounts (SURVEY D11).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlab.functions.blocks import (
    MONEY, USER, aggregate_for_audience, as_date, avg_spend, before, bucket, bucket_rank, in_window, inactive_label,
    money_sum,
)
from campaignlab.functions.quantile import VALUE_TYPE, median_from_histogram, value_bins, value_histogram
from campaignlab.sources.tables import CampaignTables
from campaignlab.session import checkpoint_dir

# Fixed values.
TICKET_EDGES = (1, 5, 10, 50, 100, 200)
TICKET_LABELS = ("1", "<=5", "<=10", "<=50", "<=100", "<=200", ">200")
ACTIVITY_DEPOSIT_STATES = ("Handling", "Success")
FIRST_TIME = "FTP"
STAT_NAMES = ("average", "min", "median", "max")
STAT_COLUMNS = ("Ticket_sold", "Turnover", "Prize")


def _avg(total: str, count: str):
    return avg_spend(F.col(total), F.col(count)).cast(MONEY)


def _sorted_small(df: DataFrame, *keys) -> DataFrame:
    """Order a section that has one row per bucket (a handful of rows by
    construction) inside one partition: no range-partitioning sample job.
    Unbounded results keep the distributed ``orderBy``."""
    return df.coalesce(1).sortWithinPartitions(*keys)


# ----------------------------------------------------------------------- A1
def audience(ids: DataFrame, column: str = USER) -> DataFrame:
    """Distinct, trimmed user ids of an upload as ``User_ID`` strings."""
    return ids.select(F.trim(F.col(column).cast("string")).alias(USER)).distinct()


def load_audience(spark: SparkSession, path: str, column: str = USER) -> DataFrame:
    """A1: read an uploaded CSV (header row) of user ids. Ids are read as text,
    never inferred (leading zeros are kept)."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return audience(raw, column)


# ----------------------------------------------------------------------- A2
def activity_base(t: CampaignTables, ids: DataFrame, start, end) -> DataFrame:
    """A2: in-window orders of the audience per (User_ID, Lottery)."""
    cols = [USER, "Lottery", "Entries", "Turnover", "Prize", "Creation_date"] + ([t.orders_day] if t.orders_day else [])
    o = in_window(t.orders.select(*cols), "Creation_date", start, end, day_col=t.orders_day)
    return aggregate_for_audience(o, ids, [USER, "Lottery"], [
        F.sum("Entries").alias("Ticket_sold"),
        money_sum("Turnover").alias("Turnover"),
        money_sum("Prize").alias("Prize")])


# ----------------------------------------------------------------------- A3
def activity_by_user(base: DataFrame) -> DataFrame:
    """A3: per active user totals."""
    return base.groupBy(USER).agg(
        F.sum("Ticket_sold").alias("Ticket_sold"),
        money_sum("Turnover").alias("Turnover"),
        money_sum("Prize").alias("Prize"))


# ----------------------------------------------------------------------- A4
def activity_by_product(base: DataFrame) -> DataFrame:
    """A4: per product players, totals and average spend. ``base`` is unique
    on (User_ID, Lottery), so players = rows (no distinct aggregation)."""
    return base.groupBy("Lottery").agg(
        F.count(F.lit(1)).alias("Player"),
        F.sum("Ticket_sold").alias("Ticket_sold"),
        money_sum("Turnover").alias("Turnover"),
        money_sum("Prize").alias("Prize"),
    ).withColumn("Avg spend", _avg("Turnover", "Player"))


# ----------------------------------------------------------------------- A5
def ticket_segment(c) -> "F.Column":
    """Ticket bucket: exactly 1, then <=5 ... <=200, else >200 (null and
    0/negative fall into '>200' and '<=5', SURVEY D8)."""
    return bucket(c, TICKET_EDGES, TICKET_LABELS, equal_first=True)


def activity_by_ticket_segment(by_user: DataFrame) -> DataFrame:
    """A5: per ticket bucket players, tickets, turnover, average spend, in
    bucket order."""
    seg = by_user.withColumn("ticket_segment", ticket_segment(F.col("Ticket_sold")))
    out = seg.groupBy("ticket_segment").agg(
        F.count(F.lit(1)).alias("Player"),
        F.sum("Ticket_sold").alias("Ticket_sold"),
        money_sum("Turnover").alias("Turnover"),
    ).withColumn("Avg spend", _avg("Turnover", "Player"))
    return _sorted_small(out, bucket_rank(F.col("ticket_segment"), TICKET_LABELS))


# ----------------------------------------------------------------------- A6
def activity_deposits(t: CampaignTables, ids: DataFrame, start, end,
                      success_states=ACTIVITY_DEPOSIT_STATES) -> DataFrame:
    """Per audience user deposits in the window: attempts (all rows) and
    the amount in a success state (handling counts, D12)."""
    d = in_window(t.deposits.select(USER, "top_up_amount", "top_up_state", "creation_date"),
                  "creation_date", start, end)
    ok = F.when(F.col("top_up_state").isin(list(success_states)), F.col("top_up_amount"))
    return aggregate_for_audience(d, ids, [USER], [
        F.count(F.lit(1)).alias("attempt_depo"),
        F.sum(ok).cast(MONEY).alias("success_depo_amount")])


# ----------------------------------------------------------------------- A7
def inactive_months(t: CampaignTables, ids: DataFrame, start) -> DataFrame:
    """For audience users with orders strictly before ``start``, whole
    30-day months from the last order day to the start day (D2)."""
    cols = list(dict.fromkeys([USER, "DateID", "Creation_date"] + ([t.orders_day] if t.orders_day else [])))
    o = before(t.orders.select(*cols), "Creation_date", start, day_col=t.orders_day)
    return aggregate_for_audience(o, ids, [USER], [F.max("DateID").alias("_last")]).select(
        USER, inactive_label(F.col("_last"), as_date(start)).alias("inactive_month"))


# ----------------------------------------------------------------------- A8
def activity_summary(ids: DataFrame, by_user: DataFrame) -> DataFrame:
    """One KPI row: receivers, active players, active percentage, tickets,
    turnover, average spend. One global aggregate over the stacked audience
    and per-user rows (no cross join of separate aggregates)."""
    stacked = ids.select(F.col(USER).alias("_receiver")).unionByName(
        by_user.select(F.col(USER).alias("_player"), "Ticket_sold", "Turnover"), allowMissingColumns=True)
    kpi = stacked.agg(
        F.count("_receiver").alias("Receiver"),
        F.count("_player").alias("Active_players"),
        F.sum("Ticket_sold").alias("Ticket_sold"),
        money_sum("Turnover").alias("Turnover"))
    pct = F.round(F.try_divide(F.col("Active_players").cast("decimal(20,0)") * 100, F.col("Receiver")), 2)
    return kpi.select("Receiver", "Active_players", pct.cast(MONEY).alias("Active_percentage"),
                      "Ticket_sold", "Turnover", _avg("Turnover", "Active_players").alias("Avg_spend"))


# ----------------------------------------------------------------------- A9
def deposit_summary(deposits: DataFrame) -> DataFrame:
    """One KPI row over the per-user deposits of A6. Zero counts and null
    amounts when nobody deposited (D27)."""
    amt = F.col("success_depo_amount")
    kpi = deposits.agg(
        F.count(F.lit(1)).alias("Attempt_users"),
        F.coalesce(F.sum("attempt_depo"), F.lit(0)).cast("bigint").alias("Attempts"),
        F.count(F.when(amt > 0, F.lit(1))).alias("Success_users"),
        money_sum("success_depo_amount").alias("Success_amount"),
        F.min(amt).cast(MONEY).alias("Min_amount"),
        F.count(amt).alias("_n"),
        F.max(amt).cast(MONEY).alias("Max_amount"))
    return kpi.select("Attempt_users", "Attempts", "Success_users", "Success_amount", "Min_amount",
                      _avg("Success_amount", "_n").alias("Avg_amount"), "Max_amount")


# ---------------------------------------------------------------------- A10
def activity_stats(by_user: DataFrame, columns=STAT_COLUMNS) -> DataFrame:
    """A10: average, min, median and max of the per-user columns, 2 decimals
    (rows ``stat`` in that order, one column per statistic input).

    The columns are stacked into one value histogram per column; the moments
    (sum, count, min, max) come from the histogram's bins, the exact medians
    from the values of the middle bins, and a single one-row aggregate
    assembles the table (no pivot)."""
    stacked = by_user.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("g"), F.col(c).cast(VALUE_TYPE).alias("v")) for c in columns])))
    hist = value_histogram(stacked, "g", "v")
    bins = value_bins(hist)
    cells = bins.select("g", "total", F.col("n").alias("count"), "min", "max").unionByName(
        median_from_histogram(hist, bins), allowMissingColumns=True)
    fold = {"total": F.sum, "count": F.sum, "min": F.min, "max": F.max, "median": F.max}
    one = cells.agg(*[f(F.when(F.col("g") == c, F.col(x))).alias(f"{c}__{x}") for c in columns for x, f in fold.items()])
    cell = {
        "average": lambda c: avg_spend(F.col(f"{c}__total"), F.col(f"{c}__count")),
        "min": lambda c: F.col(f"{c}__min"),
        "median": lambda c: F.round(F.col(f"{c}__median"), 2),
        "max": lambda c: F.col(f"{c}__max"),
    }
    rows = [F.struct(F.lit(s).alias("stat"), *[cell[s](c).cast(MONEY).alias(c) for c in columns])
            for s in STAT_NAMES]
    # one input row -> one partition: the rows keep the array order
    return one.select(F.inline(F.array(*rows)))


# ---------------------------------------------------------------------- A11
def reactivation(by_user: DataFrame, history: DataFrame) -> DataFrame:
    """Active users by months of inactivity before the campaign; users
    without earlier orders are first-time players ('FTP'). Sorted by month
    number, FTP last (D3)."""
    j = by_user.join(history, USER, "left").withColumn(
        "inactive_month", F.coalesce(F.col("inactive_month"), F.lit(FIRST_TIME)))
    out = j.groupBy("inactive_month").agg(
        F.count(F.lit(1)).alias("Reactivated player"),
        F.sum("Ticket_sold").alias("Ticket sold"),
        money_sum("Turnover").alias("Turnover"),
    ).withColumn("Avg spend", _avg("Turnover", "Reactivated player"))
    key = F.when(F.col("inactive_month") == FIRST_TIME, F.lit(None).cast("int")) \
        .otherwise(F.regexp_extract("inactive_month", r"(\d+)", 1).cast("int"))
    return _sorted_small(out, key.asc_nulls_last())


# ---------------------------------------------------------------- A12, A13
def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a frame several sections reuse: a reliable
    checkpoint in the cluster's checkpoint folder when one is named, else a
    memory-and-disk persist (recomputed from lineage if an executor dies)."""
    if checkpoint_dir(df.sparkSession):
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def empty_signal(base: DataFrame) -> DataFrame:
    """One row, ``empty``: the audience has no order in the window."""
    return base.agg((F.count(F.lit(1)) == 0).alias("empty"))


REPORT_SECTIONS = ("overview", "deposit", "stats", "by_product", "by_ticket", "reactivation")


def campaign_report(t: CampaignTables, ids: DataFrame, start, end, title: str = "") -> dict:
    """The report bundle: header fields plus six sections in fixed order
    (typed), and the two KPI sections as labelled display tables.

    ``ids`` is the audience (distinct ids, see ``audience``). The base, the
    per-user totals, the deposits and the two KPI rows are materialised once; ``empty`` is the A12 signal
    (no in-window order of the audience), in which case the sections are
    empty or zero rather than an error (D26)."""
    ids = materialize(audience(ids))
    base = materialize(activity_base(t, ids, start, end))
    deposits = materialize(activity_deposits(t, ids, start, end))
    by_user = materialize(activity_by_user(base))
    history = inactive_months(t, ids, start)
    sections = {
        "overview": materialize(activity_summary(ids, by_user)),
        "deposit": materialize(deposit_summary(deposits)),
        "stats": activity_stats(by_user),
        "by_product": activity_by_product(base),
        "by_ticket": activity_by_ticket_segment(by_user),
        "reactivation": reactivation(by_user, history),
    }
    display = {"overview": metric_rows(sections["overview"], SUMMARY_LABELS),
               "deposit": metric_rows(sections["deposit"], DEPOSIT_LABELS)}
    return {"title": title, "start": str(start), "end": str(end), "empty": empty_signal(base).first()["empty"],
            "sections": sections, "display": display}


# Fixed display labels of the reference's report tables.
SUMMARY_LABELS = {"Receiver": "Receiver", "Active_players": "Active players",
                  "Active_percentage": "Active percentage", "Ticket_sold": "Ticket sold", "Turnover": "Turnover",
                  "Avg_spend": "Avg spend"}
DEPOSIT_LABELS = {"Attempt_users": "Attempt deposit users", "Attempts": "Total transaction (attempt)",
                  "Success_users": "Success users", "Success_amount": "Success deposit amount",
                  "Min_amount": "Min amount", "Avg_amount": "Avg amount", "Max_amount": "Max amount"}
_PLAIN = {"Active_percentage", "Avg_spend", "Avg_amount"}


def metric_rows(kpi: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """A KPI row as the reference's two-column (Metric, Value) display table:
    whole numbers with thousands separators, averages with two decimals, the
    percentage with a % sign, empty for null."""
    labels = labels or {c: c for c in kpi.columns}
    out = []
    for c, label in labels.items():
        v = F.col(c)
        if c == "Active_percentage":
            text = F.concat(v.cast("string"), F.lit("%"))
        elif c in _PLAIN:
            text = v.cast("string")
        else:
            text = F.format_number(F.floor(v), 0)
        out.append(F.coalesce(text, F.lit("")).alias(label))
    return kpi.select(*out).unpivot([], list(labels.values()), "Metric", "Value")


def write_report(report: dict, path: str, fmt: str = "csv") -> None:
    """Write every section to ``<path>/<section>`` (header row for CSV) and
    the header fields to ``<path>/_header``."""
    spark = next(iter(report["sections"].values())).sparkSession
    header = spark.createDataFrame(
        [(report["title"], report["start"], report["end"], bool(report["empty"]))],
        T.StructType([T.StructField("title", T.StringType()), T.StructField("start", T.StringType()),
                      T.StructField("end", T.StringType()), T.StructField("empty", T.BooleanType())]))
    items = [("_header", header)] + [(k, report["sections"][k]) for k in REPORT_SECTIONS] \
        + [(f"{k}_table", v) for k, v in report.get("display", {}).items()]
    for name, df in items:
        w = df.write.mode("overwrite")
        if fmt == "csv":
            w.option("header", True).csv(f"{path.rstrip('/')}/{name}")
        else:
            w.format(fmt).save(f"{path.rstrip('/')}/{name}")
