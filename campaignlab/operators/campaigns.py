"""The activity check (A2-A11) for a table of campaigns in one pass.

``campaigns`` has a row (campaign, start, end) for each campaign, ``audiences`` rows
(campaign, User_ID). Windows and audiences may overlap. Every campaign's window is
cut into bins of ``BIN_DAYS`` days; members meet the orders on (user, bin) and the
exact times decide, so one scan of the facts serves all campaigns, a row is
compared only with the campaigns of its own user around its own day, and a hot
user's rows are spread over the bins. Nothing is joined by time alone.

Each section has a row, or rows, per campaign and equals what the single check
of that campaign gives. A campaign of the table without audience has zero rows in the
per-user sections and a row of zeros in the summaries.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignlab.functions.blocks import MONEY, USER, avg_spend, inactive_label, money_sum
from campaignlab.functions.quantile import VALUE_TYPE, median_from_histogram, value_bins, value_histogram
from campaignlab.operators import activity as X
from campaignlab.operators.last_activity import monthly_last_days
from campaignlab.sources.tables import CampaignTables

CAMPAIGN = "campaign"
BIN_DAYS = 32


def campaign_table(campaigns: DataFrame) -> DataFrame:
    """(campaign, start, end), trimmed text and times; rows that repeat one collapse. A name with
    two windows or a window that is no time fails the job."""
    def time(c: str) -> Column:
        t = F.try_to_timestamp(F.col(c).cast("string")).cast("timestamp_ntz")
        return F.when(t.isNotNull(), t).otherwise(F.raise_error(F.concat(
            F.lit(f"campaign {c} is not a time: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast("timestamp_ntz"))

    rows = campaigns.filter(F.col(CAMPAIGN).isNotNull()).select(
        F.trim(F.col(CAMPAIGN).cast("string")).alias(CAMPAIGN), F.struct(time("start").alias("start"), time("end").alias("end")).alias("w"))
    g = rows.groupBy(CAMPAIGN).agg(F.min("w").alias("low"), F.max("w").alias("w"))
    w = F.when(F.col("low") == F.col("w"), F.col("w")).otherwise(
        F.raise_error(F.concat(F.lit("two windows for campaign "), F.col(CAMPAIGN))))
    return g.select(CAMPAIGN, w.alias("w")).select(CAMPAIGN, "w.start", "w.end")


def day_bin(time: Column) -> Column:
    return F.floor(F.unix_date(time.cast("date")) / BIN_DAYS)


@dataclass(frozen=True)
class CampaignSet:
    """Sections of many campaigns; each is built when first asked for."""

    tables: CampaignTables
    campaigns: DataFrame
    audiences: DataFrame

    @cached_property
    def windows(self) -> DataFrame:
        return campaign_table(self.campaigns)

    @cached_property
    def members(self) -> DataFrame:
        """A1: distinct trimmed (campaign, User_ID, start, end) of campaigns in the table."""
        ids = self.audiences.select(F.trim(F.col(CAMPAIGN).cast("string")).alias(CAMPAIGN),
                                    F.trim(F.col(USER).cast("string")).alias(USER)).distinct()
        return ids.join(self.windows, CAMPAIGN)

    @cached_property
    def hull(self):
        """First start and last end: one row on the driver, so the facts' scan is pruned."""
        return self.windows.agg(F.min("start").alias("start"), F.max("end").alias("end")).first()

    def in_windows(self, rows: DataFrame, time: str, day_col: str | None = None) -> DataFrame:
        """``rows`` once for each campaign of their user whose window holds ``time``."""
        if self.hull["start"] is None:
            return rows.filter(F.lit(False)).withColumn(CAMPAIGN, F.lit(None).cast("string"))
        rows = X.in_window(rows, time, self.hull["start"], self.hull["end"], day_col=day_col)
        at = F.col(time).cast("timestamp_ntz")
        rows = rows.withColumn("_bin", day_bin(at))
        wanted = self.members.filter(F.col("start") <= F.col("end")).withColumn(
            "_bin", F.explode(F.sequence(day_bin(F.col("start")), day_bin(F.col("end")))))
        return rows.join(wanted, [USER, "_bin"]).filter(at.between(F.col("start"), F.col("end")))

    # ------------------------------------------------------------- A2, A3
    @cached_property
    def base(self) -> DataFrame:
        """A2 per (campaign, User_ID, Lottery)."""
        t = self.tables
        cols = [USER, "Lottery", "Entries", "Turnover", "Prize", "Creation_date"] + ([t.orders_day] if t.orders_day else [])
        rows = self.in_windows(t.orders.select(*cols), "Creation_date", t.orders_day)
        return rows.groupBy(CAMPAIGN, USER, "Lottery").agg(
            F.sum("Entries").alias("Ticket_sold"), money_sum("Turnover").alias("Turnover"), money_sum("Prize").alias("Prize"))

    @cached_property
    def by_user(self) -> DataFrame:
        """A3."""
        return self.base.groupBy(CAMPAIGN, USER).agg(
            F.sum("Ticket_sold").alias("Ticket_sold"), money_sum("Turnover").alias("Turnover"), money_sum("Prize").alias("Prize"))

    # ------------------------------------------------------------- A4, A5
    @staticmethod
    def _players(rows: DataFrame, group: str, player: str, tickets: str, *more: Column) -> DataFrame:
        return rows.groupBy(CAMPAIGN, group).agg(
            F.count(F.lit(1)).alias(player), F.sum("Ticket_sold").alias(tickets), money_sum("Turnover").alias("Turnover"), *more,
        ).withColumn("Avg spend", avg_spend(F.col("Turnover"), F.col(player)).cast(MONEY))

    def by_product(self) -> DataFrame:
        """A4."""
        return self._players(self.base, "Lottery", "Player", "Ticket_sold", money_sum("Prize").alias("Prize"))

    def by_ticket_segment(self) -> DataFrame:
        """A5."""
        rows = self.by_user.withColumn("ticket_segment", X.ticket_segment(F.col("Ticket_sold")))
        return self._players(rows, "ticket_segment", "Player", "Ticket_sold")

    # ------------------------------------------------------------- A6, A9
    @cached_property
    def deposits(self) -> DataFrame:
        """A6 per (campaign, User_ID)."""
        d = self.tables.deposits.select(USER, "top_up_amount", "top_up_state", "creation_date")
        ok = F.when(F.col("top_up_state").isin(list(X.ACTIVITY_DEPOSIT_STATES)), F.col("top_up_amount"))
        return self.in_windows(d, "creation_date").groupBy(CAMPAIGN, USER).agg(
            F.count(F.lit(1)).alias("attempt_depo"), F.sum(ok).cast(MONEY).alias("success_depo_amount"))

    def _every(self, rows: DataFrame) -> DataFrame:
        """``rows`` and, for each campaign, one row of nulls: a campaign without rows keeps its group."""
        return self.windows.select(CAMPAIGN).unionByName(rows, allowMissingColumns=True)

    def deposit_summary(self) -> DataFrame:
        """A9."""
        amt = F.col("success_depo_amount")
        kpi = self._every(self.deposits).groupBy(CAMPAIGN).agg(
            F.count("attempt_depo").alias("Attempt_users"),
            F.coalesce(F.sum("attempt_depo"), F.lit(0)).cast("bigint").alias("Attempts"),
            F.count(F.when(amt > 0, F.lit(1))).alias("Success_users"), money_sum("success_depo_amount").alias("Success_amount"),
            F.min(amt).cast(MONEY).alias("Min_amount"), F.count(amt).alias("_n"), F.max(amt).cast(MONEY).alias("Max_amount"))
        return kpi.select(CAMPAIGN, "Attempt_users", "Attempts", "Success_users", "Success_amount", "Min_amount",
                          avg_spend(F.col("Success_amount"), F.col("_n")).cast(MONEY).alias("Avg_amount"), "Max_amount")

    # ------------------------------------------------------------- A7, A11
    def inactive_months(self, last_days: DataFrame | None = None) -> DataFrame:
        """A7 per (campaign, User_ID), from the months before each start and the orders of its
        own month. ``last_days`` is a maintained table (``last_activity``); without it it is derived here."""
        t = self.tables
        kept = monthly_last_days(t.orders) if last_days is None else last_days
        first = F.trunc(F.col("start").cast("date"), "month")
        closed = kept.join(self.members, USER).filter(F.col("month") < first).select(CAMPAIGN, USER, "start", "last_day")
        months = F.trunc(F.col("Creation_date").cast("date"), "month")
        orders = t.orders.select(USER, "Creation_date", "DateID").withColumn("_month", months)
        recent = orders.join(self.members.withColumn("_month", first), [USER, "_month"]).filter(
            F.col("Creation_date").cast("timestamp_ntz") < F.col("start")).select(CAMPAIGN, USER, "start", F.col("DateID").alias("last_day"))
        last = closed.unionByName(recent).groupBy(CAMPAIGN, USER, "start").agg(F.max("last_day").alias("_last"))
        return last.select(CAMPAIGN, USER, inactive_label(F.col("_last"), F.col("start").cast("date")).alias("inactive_month"))

    def reactivation(self, last_days: DataFrame | None = None) -> DataFrame:
        """A11."""
        j = self.by_user.join(self.inactive_months(last_days), [CAMPAIGN, USER], "left").withColumn(
            "inactive_month", F.coalesce(F.col("inactive_month"), F.lit(X.FIRST_TIME)))
        return self._players(j, "inactive_month", "Reactivated player", "Ticket sold")

    # ------------------------------------------------------------- A8, A10, A12
    def summary(self) -> DataFrame:
        """A8."""
        receivers = self.members.select(CAMPAIGN, F.col(USER).alias("_receiver"))
        players = self.by_user.select(CAMPAIGN, F.col(USER).alias("_player"), "Ticket_sold", "Turnover")
        kpi = self._every(receivers.unionByName(players, allowMissingColumns=True)).groupBy(CAMPAIGN).agg(
            F.count("_receiver").alias("Receiver"), F.count("_player").alias("Active_players"),
            F.sum("Ticket_sold").alias("Ticket_sold"), money_sum("Turnover").alias("Turnover"))
        pct = F.round(F.try_divide(F.col("Active_players").cast("decimal(20,0)") * 100, F.col("Receiver")), 2)
        return kpi.select(CAMPAIGN, "Receiver", "Active_players", pct.cast(MONEY).alias("Active_percentage"), "Ticket_sold",
                          "Turnover", avg_spend(F.col("Turnover"), F.col("Active_players")).cast(MONEY).alias("Avg_spend"))

    def stats(self) -> DataFrame:
        """A10: four rows a campaign."""
        group = F.struct(F.col(CAMPAIGN).alias("k"), F.col("c"))
        stacked = self.by_user.select(CAMPAIGN, F.inline(F.array(*[
            F.struct(F.lit(c).alias("c"), F.col(c).cast(VALUE_TYPE).alias("v")) for c in X.STAT_COLUMNS]))).select(group.alias("g"), "v")
        hist = value_histogram(stacked, "g", "v")
        bins = value_bins(hist)
        cells = bins.select("g", "total", F.col("n").alias("count"), "min", "max").unionByName(
            median_from_histogram(hist, bins), allowMissingColumns=True).select(F.col("g.k").alias(CAMPAIGN), F.col("g.c").alias("c"), "*")
        fold = {"total": F.sum, "count": F.sum, "min": F.min, "max": F.max, "median": F.max}
        one = self._every(cells.drop("g")).groupBy(CAMPAIGN).agg(*[
            f(F.when(F.col("c") == c, F.col(x))).alias(f"{c}__{x}") for c in X.STAT_COLUMNS for x, f in fold.items()])
        cell = {"average": lambda c: avg_spend(F.col(f"{c}__total"), F.col(f"{c}__count")), "min": lambda c: F.col(f"{c}__min"),
                "median": lambda c: F.round(F.col(f"{c}__median"), 2), "max": lambda c: F.col(f"{c}__max")}
        return one.select(CAMPAIGN, F.inline(F.array(*[F.struct(
            F.lit(s).alias("stat"), *[cell[s](c).cast(MONEY).alias(c) for c in X.STAT_COLUMNS]) for s in X.STAT_NAMES])))

    def empty(self) -> DataFrame:
        """Whether the audience has no order in the window."""
        rows = self.base.select(CAMPAIGN, F.lit(1).alias("_one"))
        return self._every(rows).groupBy(CAMPAIGN).agg((F.count("_one") == 0).alias("empty"))

    # ------------------------------------------------------------- A13
    def report(self, last_days: DataFrame | None = None) -> dict[str, DataFrame]:
        """The sections of all campaigns. What several of them read (members, base, per-user
        totals, deposits) is written once to the shared checkpoint folder."""
        for name in ("windows", "members", "base", "by_user", "deposits"):
            self.__dict__[name] = X.materialize(getattr(self, name))  # what cached_property keeps
        return {"overview": self.summary(), "deposit": self.deposit_summary(), "stats": self.stats(), "by_product": self.by_product(),
                "by_ticket": self.by_ticket_segment(), "reactivation": self.reactivation(last_days), "empty": self.empty()}
