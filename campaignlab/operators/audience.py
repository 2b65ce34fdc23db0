"""Audience extraction.

Each operator maps the campaign table set to one DataFrame of users to
contact. Exclusions follow the reference placement exactly: the must-not-
contact list applies everywhere, the test account only on the order-side
extracts (SURVEY D10, D13).

Scale notes, shared by all operators:
* per-user aggregates group on ``User_ID`` with map-side partial
  aggregation, so a user holding a third of all rows still ships at most one
  partial row per map task;
* the test-account filter applies to the fact rows (Catalyst pushes it into
  the scan); the must-not-contact anti join applies to the per-user
  aggregate; where that is grouped by ``User_ID`` alone, only the list itself
  is shuffled to meet it (or broadcast by Spark, which knows its bytes);
* joins carry no hints: Spark picks broadcast or shuffle from bytes, also at
  run time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campaignlab.functions.blocks import (
    MONEY, USER, as_date, bucket, clamp0, exclude_abnormal, exclude_test_accounts, inactive_days,
    money_sum, until,
)
from campaignlab.sources.tables import CampaignTables

# Fixed values of the business.
DRAW_GAME_ID = 72
JACKPOT_CUTOFF = 100000
ALL_INSTANT = "All Instant games"
SERIES_PRODUCTS = ("Lucky Day",)
BLOCKED_STATUSES = ("suspend", "close", "locked", "restricted")
BANK_DECLINED = "Bank declined"
WALLET_EDGES = (200, 1000, 5000)
WALLET_LABELS = ("<=200", "<=1000", "<=5000", ">5000")


def _strict(df: DataFrame, strict: bool) -> DataFrame:
    """The reference drops the test account only on the order-side
    extracts; ``strict=True`` drops it on the others too."""
    return exclude_test_accounts(df) if strict else df


def _draw_list(draws: Sequence[int] | None) -> list[int] | None:
    """``None`` and ``[]`` both mean every draw (D17); anything but ints raises."""
    if not draws:
        return None
    out = []
    for d in draws:
        if isinstance(d, bool) or not isinstance(d, int):
            raise TypeError(f"draw ids must be integers, got {d!r}")
        out.append(d)
    return out


# --------------------------------------------------------------------- E10b
def abnormal_users(users: DataFrame) -> DataFrame:
    """Users that must not be contacted (RG limit, opted out of
    messages, or a blocked account status)."""
    cond = ((F.col("RG_limit") == 1) | (F.col("receive_message") == 0)
            | F.col("user_status").isin(list(BLOCKED_STATUSES)))
    return users.filter(cond).select(USER)


def must_exclude(t: CampaignTables) -> DataFrame:
    """The whole must-exclude list."""
    return t.abnormal


# ----------------------------------------------------------------------- E1
def all_users(t: CampaignTables, strict: bool = False) -> DataFrame:
    """Registered users that may be contacted (``strict`` also drops the
    test account, D10)."""
    users = _strict(t.users.filter(F.col("registerTime").isNotNull()), strict)
    return exclude_abnormal(users, t.abnormal).select(
        USER, "registerTime", "verification_status", "nationality", "attempt_depo", "FTD", "FTP")


# ----------------------------------------------------------------------- E2
def order_behavior(t: CampaignTables, as_of=None) -> DataFrame:
    """Per user days since last order and lifetime totals (up to ``as_of``, where given)."""
    fs = until(exclude_test_accounts(t.orders_summary), "DateID", as_of)
    agg = fs.groupBy(USER).agg(
        inactive_days("DateID", as_of).alias("inactive_days"),
        F.sum("Orders").alias("Orders"),
        F.sum("Entries").alias("Tickets"),
        money_sum("Turnover").alias("Turnover"),
        money_sum("Prize").alias("Prize"),
    )
    return exclude_abnormal(agg, t.abnormal)


# ----------------------------------------------------------------------- E3
def winners(t: CampaignTables, product: str, draws: Sequence[int] | None = None,
            by: str | None = None) -> DataFrame:
    """E3a-c: distinct winners of a product, per draw.

    With no draws, all draws, newest first (D6: distinct, then sort). With
    draws, only those draws; "Pick 3" selects on ``Series_No`` (D18).

    The distinct is combined map-side, so a hot user ships one row per draw and
    task, and what is left is shuffled by user to meet the exclusion list."""
    draws = _draw_list(draws)
    if by is None:
        by = "Series_No" if (product == "Pick 3" and draws is not None) else "Draw_Period"
    o = t.orders.filter((F.col("Lottery") == product) & (F.col("Prize") > 0))
    o = exclude_test_accounts(o)
    if draws is not None:
        o = o.filter(F.col(by).isin(draws))
    out = exclude_abnormal(o.select(USER, by).distinct(), t.abnormal)
    if draws is None:
        out = out.orderBy(F.col(by).desc(), F.col(USER))
    return out


# ----------------------------------------------------------------------- E4
def _per_series(fs: DataFrame, keys: list[str]) -> DataFrame:
    """First level of the series count: one row per ``keys`` + series with
    partial totals (map-side combined)."""
    return fs.groupBy(*keys, "Game_series").agg(
        F.max("DateID").alias("_last_day"), F.max("Draw_Period").alias("_last_draw"),
        F.sum("Entries").alias("_entries"), F.sum("Turnover").alias("_turnover"), F.sum("Prize").alias("_prize"))


def buyers(t: CampaignTables, product: str, as_of=None) -> DataFrame:
    """Per buyer of a product, recency and totals (fact joined to games; up to ``as_of``, where given).
    ``distinct_series_bought`` comes from a two-level aggregate (per series,
    then per user) instead of a distinct aggregate."""
    games = t.games.filter(F.col("Lottery") == product).select("GameID")
    fs = until(exclude_test_accounts(t.orders_summary), "DateID", as_of).join(games, "GameID")
    agg = _per_series(fs, [USER]).groupBy(USER).agg(
        F.lit(product).alias("Lottery"),
        inactive_days("_last_day", as_of).alias("inactive_days"),
        F.count("Game_series").alias("distinct_series_bought"),
        F.max("_last_draw").alias("Last_active_period"),
        F.sum("_entries").alias("Tickets"),
        money_sum("_turnover").alias("Turnover"),
        money_sum("_prize").alias("Prize"),
    )
    return exclude_abnormal(agg, t.abnormal)


def draw_game_players(t: CampaignTables, draws: Sequence[int] | None = None,
                      game_id: int = DRAW_GAME_ID) -> DataFrame:
    """Distinct players of the draw game, optionally in given draws."""
    draws = _draw_list(draws)
    fs = t.orders_summary.filter(F.col("GameID") == game_id)
    if draws is not None:
        fs = fs.filter(F.col("Draw_Period").isin(draws))
    fs = exclude_test_accounts(fs)
    return exclude_abnormal(fs.select(USER).distinct(), t.abnormal)


def _product_sets(t: CampaignTables) -> DataFrame:
    """Per user the sorted set of products ever bought. Distinct pairs first: they
    are combined map-side in generated code, and the lists gathered from them
    hold at most the product count, whatever the user's order count."""
    pairs = exclude_test_accounts(t.orders.select(USER, "Lottery")).distinct()
    sets = pairs.groupBy(USER).agg(F.sort_array(F.collect_list("Lottery")).alias("_products"))
    return exclude_abnormal(sets, t.abnormal)


def _with_label(df: DataFrame) -> DataFrame:
    return df.select(USER, F.concat_ws(", ", "_products").alias("Product_bought"))


def non_buyers(t: CampaignTables, product: str) -> DataFrame:
    """E4d: users who never bought ``product`` (exact set membership, D4)."""
    return _with_label(_product_sets(t).filter(~F.array_contains("_products", product)))


def product_combinations(t: CampaignTables) -> DataFrame:
    """E4e: every user with the comma-joined set of products bought."""
    return _with_label(_product_sets(t))


def only_buyers(t: CampaignTables, product: str) -> DataFrame:
    """E4f: users whose only product is ``product``."""
    sets = _product_sets(t).filter((F.size("_products") == 1) & F.array_contains("_products", product))
    return _with_label(sets)


# ----------------------------------------------------------------------- E5
_TOP_FIELDS = ("Turnover", "Ticket", "Prize")


def top_n(t: CampaignTables, product: str, n: int = 50, by: str = "Turnover",
          draws: Sequence[int] | None = None, ticket_price: int | str | None = None) -> DataFrame:
    """E5a-e: top spenders of a product.

    Over all draws: one row per user, the top ``n`` by ``by`` (ties broken by
    ``User_ID``, D7), with ``distinct_series_bought`` for "Lucky Day" or "All
    Instant games". Per draw: ``rank()`` within each draw, keeping ranks <= n
    (ties may exceed n). "Instant" can be restricted to one ticket price and
    carries the price as a text tag."""
    if by not in _TOP_FIELDS:
        raise ValueError(f"sort field must be one of {_TOP_FIELDS}")
    if n < 1:
        raise ValueError("n must be >= 1")
    draws = _draw_list(draws)
    if product == "Instant" and ticket_price is None:
        ticket_price = ALL_INSTANT
    games = t.games.filter(F.col("Lottery") == product)
    if product == "Instant" and ticket_price != ALL_INSTANT:
        games = games.filter(F.col("Unit_Price") == int(ticket_price))
    games = games.select("GameID")
    fs = exclude_test_accounts(t.orders_summary).join(games, "GameID")
    sums = [F.sum("Entries").alias("Ticket"), money_sum("Turnover").alias("Turnover"), money_sum("Prize").alias("Prize")]

    if draws is None:
        if product in SERIES_PRODUCTS or ticket_price == ALL_INSTANT:
            # distinct series per user as a two-level aggregate (no Expand)
            fs = _per_series(fs, [USER]).withColumnRenamed("_entries", "Entries") \
                .withColumnRenamed("_turnover", "Turnover").withColumnRenamed("_prize", "Prize")
            sums.insert(0, F.count("Game_series").alias("distinct_series_bought"))
        out = (exclude_abnormal(fs.groupBy(USER).agg(*sums), t.abnormal)
               .orderBy(F.col(by).desc_nulls_last(), F.col(USER).asc())
               .limit(n))
    else:
        per_draw = fs.filter(F.col("Draw_Period").isin(draws)).groupBy("Draw_Period", USER).agg(*sums)
        per_draw = exclude_abnormal(per_draw, t.abnormal)
        w = Window.partitionBy("Draw_Period").orderBy(F.col(by).desc_nulls_last())
        out = (per_draw.withColumn("Rank", F.rank().over(w))
               .filter(F.col("Rank") <= n)
               .withColumn("Lottery", F.lit(product)))
    if product == "Instant":
        out = out.withColumn("Unit_Price", F.lit(str(ticket_price)))
    return out


def ticket_prices(t: CampaignTables, product: str = "Instant") -> DataFrame:
    """Distinct ticket prices of a product."""
    return t.games.filter(F.col("Lottery") == product).select("Unit_Price").distinct()


# ----------------------------------------------------------------------- E6
def rfm_segment(t: CampaignTables, segment: str, strict: bool = False) -> DataFrame:
    """Contactable users of one RFM segment."""
    rfm = _strict(t.rfm.filter(F.col("Segment") == segment), strict)
    return exclude_abnormal(rfm.select(USER, "Segment"), t.abnormal)


def rfm_segments(t: CampaignTables) -> DataFrame:
    """The list of segments."""
    return t.rfm.select("Segment").distinct()


# ----------------------------------------------------------------------- E7
def _deposit_columns(success_states: Sequence[str] = ("Success",)):
    amount = F.when(F.col("top_up_state").isin(list(success_states)), F.col("top_up_amount"))
    return [F.count("top_up_id").alias("attempt_transaction"), F.sum(amount).cast(MONEY).alias("success_amount")]


def deposit_behavior(t: CampaignTables, strict: bool = False) -> DataFrame:
    """Per depositor, attempts and the successful amount (null if none)."""
    agg = _strict(t.deposits, strict).groupBy(USER).agg(*_deposit_columns())
    return exclude_abnormal(agg, t.abnormal)


# ----------------------------------------------------------------------- E9
def bank_declined(t: CampaignTables, strict: bool = False) -> DataFrame:
    """Depositors with at least one deposit whose gateway memo maps to the
    "Bank declined" group, with their E7 deposit columns.

    One pass over the deposits: a join with the memo dimension flags each
    deposit (a null user matches no deposit total: its columns are null), and a single per-user aggregate yields both the flag and the
    E7 columns (the reference runs two queries and joins them)."""
    declined = (t.fail_groups.filter(F.col("fail_group") == BANK_DECLINED)
                .select("gateway_memo", F.lit(True).alias("_declined")).distinct())
    d = _strict(t.deposits, strict).join(declined, "gateway_memo", "left")
    agg = d.groupBy(USER).agg(F.max(F.coalesce("_declined", F.lit(False))).alias("_any_declined"),
                              *_deposit_columns())
    out = agg.filter("_any_declined").drop("_any_declined")
    out = out.select(USER, *[F.when(F.col(USER).isNotNull(), F.col(c)).alias(c) for c in out.columns if c != USER])
    return exclude_abnormal(out, t.abnormal)


# ----------------------------------------------------------------------- E8
_MONEY = MONEY


def wallet_flows(t: CampaignTables, draw_game_id: int = DRAW_GAME_ID, jackpot_cutoff: int = JACKPOT_CUTOFF,
                 strict: bool = False) -> dict[str, DataFrame]:
    """The four money flows of E8, each with its user and a column ``day`` (null where the table
    has no date: deposits ``creation_date``, orders ``DateID``, withdrawals ``withdrawal_date`` and
    refunds ``refund_date``, the last two optional).

    Per-source filters keep the reference placement: orders drop the test account,
    withdrawals drop the reverted and failed (and null-status) rows, refunds keep
    successful ones. A null user meets no other flow; deposits keep theirs (D13)."""
    money = lambda c: F.col(c).cast(_MONEY)

    def day(df: DataFrame, col: str):
        return (F.col(col) if col in df.columns else F.lit(None)).cast("date").alias("day")

    known = F.col(USER).isNotNull()
    dep, fs = _strict(t.deposits, strict), exclude_test_accounts(t.orders_summary)
    wd = _strict(t.withdrawals, strict).filter(~F.col("withdrawal_status").isin("Bank reverted", "Failure"))
    rf = _strict(t.refunds, strict).filter(F.col("Memo") == "Success")
    return {
        "deposits": dep.select(USER, day(dep, "creation_date"),
                               F.when(F.col("top_up_state") == "Success", money("top_up_amount")).alias("dep_success")),
        "orders": fs.filter(known).select(
            USER, day(fs, "DateID"), money("Turnover").alias("turnover"), F.col("DateID").alias("last_date"),
            F.when((F.col("GameID") == draw_game_id) & (F.col("Prize") < jackpot_cutoff), money("Prize")).alias("draw_prize"),
            F.when(F.col("GameID") != draw_game_id, money("Prize")).alias("other_prize")),
        "withdrawals": wd.filter(known).select(USER, day(wd, "withdrawal_date"), money("withdrawal_amount").alias("withdraw")),
        "refunds": rf.filter(known).select(USER, day(rf, "refund_date"), money("Refund_amount").alias("refund")),
    }


# How the columns of the flows add up per user.
WALLET_SUMS = {"dep_success": F.sum, "turnover": F.sum, "last_date": F.max, "draw_prize": F.sum, "other_prize": F.sum,
               "withdraw": F.sum, "refund": F.sum}


def wallets(sums: DataFrame, as_of) -> DataFrame:
    """E8 columns from per-user sums (``WALLET_SUMS``; other columns of ``sums`` stay, first).
    Only users with a positive successful deposit have a wallet."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    # HAVING sum(withdrawal) > 0: a non-positive total counts as no withdrawal.
    withdraw = F.when(F.col("withdraw") > 0, F.col("withdraw")).otherwise(F.lit(0))
    prizes = z("other_prize") + z("draw_prize")
    balance = clamp0(F.col("dep_success") - z("turnover") - z("refund") - withdraw + prizes)
    withdrawable = clamp0(prizes - withdraw - z("turnover"))
    keys = [c for c in sums.columns if c not in WALLET_SUMS]
    as_of = as_of if isinstance(as_of, Column) else as_date(as_of)
    out = sums.filter(F.col("dep_success") > 0).select(
        *keys, balance.cast(_MONEY).alias("balance"), withdrawable.cast(_MONEY).alias("Withdrawable_amount"),
        F.datediff(as_of, F.col("last_date")).alias("inactive_days"))
    out = out.withColumn("balance_group", bucket(F.col("balance"), WALLET_EDGES, WALLET_LABELS))
    return out.select(*keys, "balance", "Withdrawable_amount", "balance_group", "inactive_days")


def wallet_balance(t: CampaignTables, as_of=None, draw_game_id: int = DRAW_GAME_ID,
                   jackpot_cutoff: int = JACKPOT_CUTOFF, strict: bool = False) -> DataFrame:
    """Estimated wallet balance of depositors, as of a day where one is given:
    later movements do not count.

    Instead of four aggregates joined three times, the four money flows are
    stacked as one ledger (``unionByName``) and aggregated once per user: one
    shuffle with map-side combine. Where all four are stored clustered by user
    (``t.by_user``) nothing has to be shuffled: each flow is aggregated in
    its buckets and the aggregates meet bucket against bucket."""
    flows = [until(f, "day", as_of).drop("day") for f in wallet_flows(t, draw_game_id, jackpot_cutoff, strict).values()]
    sums = lambda df: [agg(c).alias(c) for c, agg in WALLET_SUMS.items() if c in df.columns]
    if t.by_user:
        per_user, *others = [f.groupBy(USER).agg(*sums(f)) for f in flows]
        for o in others:
            per_user = per_user.join(o, USER, "left")
    else:
        ledger = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), flows)
        per_user = ledger.groupBy(USER).agg(*sums(ledger))
    return exclude_abnormal(wallets(per_user, as_of), t.abnormal)
