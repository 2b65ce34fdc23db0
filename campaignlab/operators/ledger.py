"""Wallet balances as of any day, from a ledger of months.

The four money flows are summed per (user, month) with map-side combine, so a
user holding a third of all rows ships one row a month and task. A running sum
over a user's months (hundreds of rows at most) closes each month. The balance at
a day is the closing row of the last month before the day's own, plus that
month's movements up to the day: the ledger and one month of facts are read,
not the whole history. A kept ledger stays valid for every earlier day; months that get new
rows are summed again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from campaignlab.functions.blocks import USER, exclude_abnormal
from campaignlab.operators.audience import DRAW_GAME_ID, JACKPOT_CUTOFF, WALLET_SUMS, wallet_flows, wallets
from campaignlab.sources.tables import CampaignTables

UNDATED = dt.date(1900, 1, 1)  # month of movements without a date: they count at every later day


def _movements(t: CampaignTables, draw_game_id: int, jackpot_cutoff: int, strict: bool) -> DataFrame:
    flows = wallet_flows(t, draw_game_id, jackpot_cutoff, strict).values()
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), flows)


def _sums():
    return [agg(c).alias(c) for c, agg in WALLET_SUMS.items()]


def monthly_ledger(t: CampaignTables, draw_game_id: int = DRAW_GAME_ID, jackpot_cutoff: int = JACKPOT_CUTOFF,
                   strict: bool = False) -> DataFrame:
    """Rows (User_ID, month, sums of all movements up to the end of the month), one for each month
    in which the user moved money. Null users keep their deposits."""
    month = F.coalesce(F.trunc("day", "month"), F.lit(UNDATED)).alias("month")
    by_month = _movements(t, draw_game_id, jackpot_cutoff, strict).groupBy(USER, month).agg(*_sums())
    upto = Window.partitionBy(USER).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return by_month.select(USER, "month", *[agg(c).over(upto).alias(c) for c, agg in WALLET_SUMS.items()])


def wallet_balances_at(t: CampaignTables, ledger: DataFrame, days: Sequence, draw_game_id: int = DRAW_GAME_ID,
                       jackpot_cutoff: int = JACKPOT_CUTOFF, strict: bool = False) -> DataFrame:
    """E8 at each of ``days`` (a short list): ``as_of`` and the columns of ``wallet_balance``.

    A row of the ledger or of the facts serves every day it counts for, so any
    number of days takes one pass over each."""
    days = sorted({d if type(d) is dt.date else dt.date.fromisoformat(str(d)[:10]) for d in days})
    if not days:
        raise ValueError("no day given")
    listed = F.array(*[F.lit(d) for d in days])
    # the month's end before each day: the last closing row of an earlier month
    closed = ledger.select(F.explode(F.filter(listed, lambda d: F.trunc(d, "month") > F.col("month"))).alias("as_of"), USER,
                           "month", F.struct(*WALLET_SUMS).alias("sums"))
    closed = closed.groupBy("as_of", USER).agg(F.max_by("sums", "month").alias("sums")).select("as_of", USER, "sums.*")
    # the day's own month; a literal range for each day prunes the facts
    moves = _movements(t, draw_game_id, jackpot_cutoff, strict)
    inside = reduce(lambda a, b: a | b, [F.col("day").between(F.lit(d.replace(day=1)), F.lit(d)) for d in days])
    open_month = moves.filter(inside).select(
        F.explode(F.filter(listed, lambda d: (F.trunc(d, "month") == F.trunc("day", "month")) & (d >= F.col("day")))).alias("as_of"),
        USER, *WALLET_SUMS)
    sums = closed.unionByName(open_month).groupBy("as_of", USER).agg(*_sums())
    return exclude_abnormal(wallets(sums, F.col("as_of")), t.abnormal)
