"""Entry points with the reference's operator names and filter keys, so an
existing caller can switch: ``extract_data``, ``run_activity_check``,
``run_update_user_status``, plus ``export_audience`` (count and CSV export
from one execution)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from campaignlab.operators import activity as X
from campaignlab.operators import audience as A
from campaignlab.operators import status as S
from campaignlab.sources.tables import CampaignTables
from campaignlab.sources.uploads import write_audience_csv

# Fixed operator names and modes offered by the reference's extraction page.
OPERATORS = ("All users", "RFM Segments", "Order behavior", "Players by Lottery Type", "Winners by Lottery Type",
             "Top N by Draw series", "Deposit behavior", "Wallet balance", "Bank-declined users",
             "Users must exclude")
BUY_MODES = ("Buy product", "Not buy product", "Only buy product", "All combinations")


def extract_data(t: CampaignTables, operator: str, filters: Mapping | None = None, as_of=None) -> DataFrame:
    """One audience by the reference's operator name and filter dict
    (``segment``, ``buy_or_not``, ``by_product``, ``get_LD_player``,
    ``draw_period``, ``ticket_price``, ``top``, ``by_field``). ``as_of``
    replaces the server clock (default: today)."""
    f = dict(filters or {})
    draws = f.get("draw_period")
    if operator == "All users":
        return A.all_users(t)
    if operator == "Order behavior":
        return A.order_behavior(t, as_of)
    if operator == "Winners by Lottery Type":
        return A.winners(t, f["by_product"], draws)
    if operator == "Players by Lottery Type":
        mode = f.get("buy_or_not")
        if mode == "Buy product":
            if f.get("by_product") == "Lucky Day" and f.get("get_LD_player"):
                return A.draw_game_players(t, draws)
            return A.buyers(t, f["by_product"], as_of)
        if mode == "Not buy product":
            return A.non_buyers(t, f["by_product"])
        if mode == "All combinations":
            return A.product_combinations(t)
        if mode == "Only buy product":
            return A.only_buyers(t, f["by_product"])
        raise ValueError(f"unknown buy_or_not mode {mode!r}; one of {BUY_MODES}")
    if operator == "Top N by Draw series":
        return A.top_n(t, f["by_product"], int(f.get("top", 50)), f.get("by_field", "Turnover"), draws,
                       f.get("ticket_price"))
    if operator == "RFM Segments":
        return A.rfm_segment(t, f["segment"])
    if operator == "Deposit behavior":
        return A.deposit_behavior(t)
    if operator == "Wallet balance":
        return A.wallet_balance(t, as_of)
    if operator == "Bank-declined users":
        return A.bank_declined(t)
    if operator == "Users must exclude":
        return A.must_exclude(t)
    raise ValueError(f"unknown operator {operator!r}; one of {OPERATORS}")


def audience_size(df: DataFrame) -> DataFrame:
    """One row, ``audience_size``: the number of rows of an extract."""
    return df.agg(F.count(F.lit(1)).alias("audience_size"))


def export_audience(df: DataFrame, path: str, single_file: bool = False) -> int:
    """E12 + I4: the audience size and its CSV export from one execution of
    the plan: the rows are counted as they are written."""
    size = Observation()
    write_audience_csv(df.observe(size, F.count(F.lit(1)).alias("audience_size")), path, single_file=single_file)
    return size.get["audience_size"]


def run_activity_check(t: CampaignTables, ids: DataFrame, start, end, title: str = "") -> dict:
    """A13 under the reference's name."""
    return X.campaign_report(t, ids, start, end, title)


def run_update_user_status(users: DataFrame, rg_limit: DataFrame, opt_out: DataFrame,
                           user_status: DataFrame, on_conflict: str = "error") -> DataFrame:
    """U5 under the reference's name: the updated user snapshot."""
    return S.update_status(users, rg_limit, opt_out, user_status, on_conflict=on_conflict)
