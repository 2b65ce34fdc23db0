"""Audience extraction queries (E1-E12) with their fixture parameters
(SURVEY §7.2) and oracle SQL.

The SQL is written from the operators' definitions, apart from how Spark
computes them: exclusion by anti join on the list, recency by date
subtraction, money by filtered sums over one list of signed movements."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from campaignlab.operators import algebra as G
from campaignlab.operators import audience as A
from campaignlab.operators import ledger as L
from campaignlab.plans.extract import audience_size
from campaignlab.plans.registry import CONTACTABLE, query
from campaignlab.session import ensure_checkpoint_dir
from campaignlab.sources.clustered import WALLET, load_clustered, save_clustered
from campaignlab.sources.tables import load_tables, save_tables
from campaignlab.sources.uploads import read_upload, read_upload_checked, write_audience_csv, write_audience_files

# Fixed test parameters.
AS_OF = "2002-01-01"
DRAWS = [60, 61]
DRAW_GAME_DRAWS = [60, 61, 62, 63, 64, 65]
PICK3_SERIES = list(range(991201, 991232))

_ABN = ("vw_abnormal_users",)
_in = lambda xs: ", ".join(str(x) for x in xs)


@query("all_users", ("dim_user_authentication",) + _ABN, f"""
select User_ID, registerTime, verification_status, nationality, attempt_depo, FTD, FTP
from dim_user_authentication {CONTACTABLE}
where registerTime is not null""")
def _all_users(td):
    return A.all_users(td.campaign)


# Orders: neither the test account nor a null id.
_ACTIVE = "User_ID is distinct from '1' and User_ID is not null"


@query("order_behavior", ("fact_orders_summary",) + _ABN, f"""
, totals as (
 select User_ID, max(DateID) as latest, sum(Orders) as n, sum(Entries) as tickets, sum(Turnover) as spent, sum(Prize) as won
 from fact_orders_summary where DateID <= date '{AS_OF}' group by User_ID)
select User_ID, cast(date '{AS_OF}' - latest as int) as inactive_days, cast(n as bigint) as Orders,
 cast(tickets as bigint) as Tickets, cast(spent as decimal(18,2)) as Turnover, cast(won as decimal(18,2)) as Prize
from totals {CONTACTABLE} where {_ACTIVE}""")
def _order_behavior(td):
    return A.order_behavior(td.campaign, as_of=AS_OF)


_WINNERS = f"""
select User_ID, {{col}} from fact_orders {CONTACTABLE}
where {_ACTIVE} and Lottery = '{{product}}' {{extra}}
group by all having max(Prize) > 0"""


@query("winners_all", ("fact_orders",) + _ABN, _WINNERS.format(col="Draw_Period", product="Lucky Day", extra=""))
def _winners_all(td):
    return A.winners(td.campaign, "Lucky Day")


@query("winners_by_draw", ("fact_orders",) + _ABN,
       _WINNERS.format(col="Draw_Period", product="Lucky Day", extra=f"and Draw_Period in ({_in(DRAWS)})"))
def _winners_by_draw(td):
    return A.winners(td.campaign, "Lucky Day", draws=DRAWS)


@query("winners_by_series", ("fact_orders",) + _ABN,
       _WINNERS.format(col="Series_No", product="Pick 3", extra=f"and Series_No in ({_in(PICK3_SERIES)})"))
def _winners_by_series(td):
    return A.winners(td.campaign, "Pick 3", draws=PICK3_SERIES)


@query("buyers", ("fact_orders_summary", "dim_games") + _ABN, f"""
, played as (
 select * from fact_orders_summary semi join (select GameID from dim_games where Lottery = 'Lucky Day') using (GameID)
 where DateID <= date '{AS_OF}')
select User_ID, 'Lucky Day' as Lottery, cast(date '{AS_OF}' - max(DateID) as int) as inactive_days,
 cast(len(list_distinct(list(Game_series))) as bigint) as distinct_series_bought, max(Draw_Period) as Last_active_period,
 cast(sum(Entries) as bigint) as Tickets, cast(sum(Turnover) as decimal(18,2)) as Turnover,
 cast(sum(Prize) as decimal(18,2)) as Prize
from played {CONTACTABLE} where {_ACTIVE} group by User_ID""")
def _buyers(td):
    return A.buyers(td.campaign, "Lucky Day", as_of=AS_OF)


_DRAW_GAME = f"""
select User_ID from fact_orders_summary {CONTACTABLE}
where {_ACTIVE} and GameID = 72 {{extra}} group by User_ID"""


@query("draw_game_by_draw", ("fact_orders_summary",) + _ABN,
       _DRAW_GAME.format(extra=f"and Draw_Period in ({_in(DRAW_GAME_DRAWS)})"))
def _draw_game_by_draw(td):
    return A.draw_game_players(td.campaign, draws=DRAW_GAME_DRAWS)


@query("draw_game_all", ("fact_orders_summary",) + _ABN, _DRAW_GAME.format(extra=""))
def _draw_game_all(td):
    return A.draw_game_players(td.campaign)


_SETS = f"""
select User_ID, Product_bought from (
 select fs.User_ID, array_to_string(list_sort(list_distinct(list(Lottery))), ', ') as Product_bought,
  bool_or(Lottery = '{{product}}') as has_product, count(distinct Lottery) as n_products
 from fact_orders fs {CONTACTABLE} where {_ACTIVE} group by fs.User_ID) s
where {{cond}}"""


@query("non_buyers", ("fact_orders",) + _ABN, _SETS.format(product="Pick 3", cond="not has_product"))
def _non_buyers(td):
    return A.non_buyers(td.campaign, "Pick 3")


@query("product_combinations", ("fact_orders",) + _ABN, _SETS.format(product="", cond="true"))
def _product_combinations(td):
    return A.product_combinations(td.campaign)


@query("only_buyers", ("fact_orders",) + _ABN,
       _SETS.format(product="Instant", cond="has_product and n_products = 1"))
def _only_buyers(td):
    return A.only_buyers(td.campaign, "Instant")


def _top_sql(product: str, by: str, n: int, series: bool = False, price: int | None = None,
             tag: str | None = None) -> str:
    price_cond = f"and g.Unit_Price = {price}" if price is not None else ""
    series_col = "cast(count(distinct fs.Game_series) as bigint) as distinct_series_bought," if series else ""
    tag_col = f", '{tag}' as Unit_Price" if tag is not None else ""
    return f"""
select q.*{tag_col} from (
 select fs.User_ID, {series_col}
  cast(sum(fs.Entries) as bigint) as Ticket, cast(sum(fs.Turnover) as decimal(18,2)) as Turnover,
  cast(sum(fs.Prize) as decimal(18,2)) as Prize
 from fact_orders_summary fs join dim_games g on fs.GameID = g.GameID {CONTACTABLE}
 where g.Lottery = '{product}' {price_cond} and {_ACTIVE}
 group by fs.User_ID) q
order by q.{by} desc nulls last, q.User_ID
limit {n}"""


def _top_draw_sql(product: str, by: str, n: int, draws: list[int], price: int | None = None,
                  tag: str | None = None) -> str:
    price_cond = f"and g.Unit_Price = {price}" if price is not None else ""
    tag_col = f", '{tag}' as Unit_Price" if tag is not None else ""
    return f"""
select r.*, '{product}' as Lottery{tag_col} from (
 select q.*, cast(rank() over (partition by q.Draw_Period order by q.{by} desc nulls last) as int) as Rank from (
  select fs.Draw_Period, fs.User_ID,
   cast(sum(fs.Entries) as bigint) as Ticket, cast(sum(fs.Turnover) as decimal(18,2)) as Turnover,
   cast(sum(fs.Prize) as decimal(18,2)) as Prize
  from fact_orders_summary fs join dim_games g on fs.GameID = g.GameID {CONTACTABLE}
  where g.Lottery = '{product}' {price_cond} and fs.Draw_Period in ({_in(draws)}) and {_ACTIVE}
  group by fs.Draw_Period, fs.User_ID) q) r
where r.Rank <= {n}"""


_TOP_VIEWS = ("fact_orders_summary", "dim_games") + _ABN


@query("top_overall", _TOP_VIEWS, _top_sql("Pick 3", "Prize", 50))
def _top_overall(td):
    return A.top_n(td.campaign, "Pick 3", n=50, by="Prize")


@query("top_overall_series", _TOP_VIEWS, _top_sql("Lucky Day", "Turnover", 50, series=True))
def _top_overall_series(td):
    return A.top_n(td.campaign, "Lucky Day", n=50, by="Turnover")


@query("top_overall_price", _TOP_VIEWS, _top_sql("Instant", "Ticket", 50, price=10, tag="10"))
def _top_overall_price(td):
    return A.top_n(td.campaign, "Instant", n=50, by="Ticket", ticket_price=10)


@query("top_all_instant", _TOP_VIEWS, _top_sql("Instant", "Turnover", 50, series=True, tag=A.ALL_INSTANT))
def _top_all_instant(td):
    return A.top_n(td.campaign, "Instant", n=50, by="Turnover", ticket_price=A.ALL_INSTANT)


@query("top_per_draw", _TOP_VIEWS, _top_draw_sql("Lucky Day", "Turnover", 10, DRAWS))
def _top_per_draw(td):
    return A.top_n(td.campaign, "Lucky Day", n=10, by="Turnover", draws=DRAWS)


@query("top_per_draw_instant", _TOP_VIEWS, _top_draw_sql("Instant", "Turnover", 10, DRAWS, price=10, tag="10"))
def _top_per_draw_instant(td):
    return A.top_n(td.campaign, "Instant", n=10, by="Turnover", draws=DRAWS, ticket_price=10)


@query("rfm_segment", ("rfm_score",) + _ABN, f"""
select User_ID, Segment from rfm_score {CONTACTABLE} where Segment = 'Loyal'""")
def _rfm_segment(td):
    return A.rfm_segment(td.campaign, "Loyal")


@query("rfm_segments", ("rfm_score",), "select distinct Segment from rfm_score")
def _rfm_segments(td):
    return A.rfm_segments(td.campaign)


_DEPOSIT_SQL = f"""
select User_ID, cast(count(top_up_id) as bigint) as attempt_transaction,
 cast(sum(top_up_amount) filter (top_up_state = 'Success') as decimal(18,2)) as success_amount
from fact_deposit {CONTACTABLE} group by User_ID"""


@query("deposit_behavior", ("fact_deposit",) + _ABN, _DEPOSIT_SQL)
def _deposit_behavior(td):
    return A.deposit_behavior(td.campaign)


# One list of movements per user. Signs: what a movement does to the balance.
# A null user's deposits meet no other movement; withdrawals count only where their sum is positive.
def _wallet_sql(as_of: str) -> str:
    return f"""
 select User_ID, cast(balance as decimal(18,2)) as balance, cast(withdrawable as decimal(18,2)) as Withdrawable_amount,
  coalesce((select label from (values (200, '<=200'), (1000, '<=1000'), (5000, '<=5000')) b(upto, label)
            where balance <= upto order by upto limit 1), '>5000') as balance_group,
  cast(idle as int) as inactive_days
 from (
  select User_ID, greatest(sum(amount), 0) as balance,
   greatest(coalesce(sum(amount) filter (kind in ('stake', 'win', 'out')), 0), 0) as withdrawable,
   date '{as_of}' - max(played) as idle
  from (
   select User_ID, 'paid in' as kind, top_up_amount as amount, null as played from fact_deposit
    where top_up_state = 'Success' and creation_date < date '{as_of}' + 1
   union all select User_ID, 'stake', -Turnover, DateID from fact_orders_summary where {_ACTIVE} and DateID <= date '{as_of}'
   union all select User_ID, 'win', Prize, null from fact_orders_summary
    where {_ACTIVE} and (GameID <> 72 or Prize < 100000) and DateID <= date '{as_of}'
   union all select User_ID, 'refund', -Refund_amount, null from fact_refund
    where Memo = 'Success' and User_ID is not null and refund_date <= date '{as_of}'
   union all select User_ID, 'out', -greatest(sum(withdrawal_amount), 0), null from fact_withdraw
    where withdrawal_status not in ('Bank reverted', 'Failure') and User_ID is not null
     and withdrawal_date <= date '{as_of}' group by User_ID) moves
  {CONTACTABLE} group by User_ID having sum(amount) filter (kind = 'paid in') > 0) wallets"""


_WALLET_VIEWS = ("fact_deposit", "fact_orders_summary", "fact_withdraw", "fact_refund") + _ABN


@query("wallet_balance", _WALLET_VIEWS, _wallet_sql(AS_OF))
def _wallet_balance(td):
    return A.wallet_balance(td.campaign, as_of=AS_OF)


# Three days: within a month, a month's last and first day.
LEDGER_DAYS = ("1996-07-13", "1998-02-28", "2000-01-01")


@query("wallet_balance_at", _WALLET_VIEWS, "\nunion all ".join(
    f"select date '{d}' as as_of, w.* from ({_wallet_sql(d)}) w" for d in LEDGER_DAYS))
def _wallet_balance_at(td):
    """E8 at several days from the monthly ledger, which is kept as a table of its own."""
    ledger = L.monthly_ledger(td.campaign)
    folder = f"{ensure_checkpoint_dir(td.spark).rstrip('/')}/ledger-{uuid.uuid4()}"
    ledger.write.parquet(folder)
    return L.wallet_balances_at(td.campaign, td.spark.read.parquet(folder), LEDGER_DAYS)


@query("wallet_balance_clustered", _WALLET_VIEWS, _wallet_sql(AS_OF))
def _wallet_balance_clustered(td):
    """The four flows and the list stored clustered by user, and E8 over the stored tables."""
    folder = f"{ensure_checkpoint_dir(td.spark).rstrip('/')}/clustered-{uuid.uuid4()}"
    buckets = max(16, td.tasks // 4)  # a bucket's rows are sorted by one task
    save_clustered(td.campaign, folder, buckets=buckets, only=(*WALLET, "abnormal"))
    return A.wallet_balance(load_clustered(td.spark, folder, td.campaign), as_of=AS_OF)


@query("bank_declined", ("fact_deposit", "dim_fail_deposit_group") + _ABN, f"""
, refused as (
 select User_ID from fact_deposit
 where gateway_memo in (select gateway_memo from dim_fail_deposit_group where fail_group = 'Bank declined') group by User_ID)
select r.User_ID, t.attempt_transaction, t.success_amount
from refused r {CONTACTABLE} left join ({_DEPOSIT_SQL}) t on t.User_ID = r.User_ID""")
def _bank_declined(td):
    return A.bank_declined(td.campaign)


@query("must_exclude", _ABN, "select * from vw_abnormal_users")
def _must_exclude(td):
    return A.must_exclude(td.campaign)


@query("ticket_prices", ("dim_games",), "select distinct Unit_Price from dim_games where Lottery = 'Instant'")
def _ticket_prices(td):
    return A.ticket_prices(td.campaign, "Instant")


@query("audience_size", ("rfm_score",) + _ABN, f"""
select count(*) as audience_size from rfm_score {CONTACTABLE} where Segment = 'Loyal'""")
def _audience_size(td):
    return audience_size(A.rfm_segment(td.campaign, "Loyal"))


@query("audience_csv_round_trip", ("rfm_score",) + _ABN, f"""
select User_ID, Segment from rfm_score {CONTACTABLE} where Segment = 'Loyal'""")
def _audience_csv_round_trip(td):
    """I4 then I1: an extract exported as CSV to the shared folder and read as an upload."""
    folder = f"{ensure_checkpoint_dir(td.spark).rstrip('/')}/audience-{uuid.uuid4()}"
    write_audience_csv(A.rfm_segment(td.campaign, "Loyal"), folder)
    return read_upload(td.spark, folder, {"User_ID": "string", "Segment": "string"})


@query("order_behavior_stored", ("fact_orders_summary", "rfm_score"), f"""
, totals as (
 select User_ID, max(DateID) as latest, sum(Orders) as n, sum(Entries) as tickets, sum(Turnover) as spent, sum(Prize) as won
 from fact_orders_summary where DateID <= date '{AS_OF}' group by User_ID),
listed as (select User_ID from rfm_score where Segment = 'Loyal')
select User_ID, cast(date '{AS_OF}' - latest as int) as inactive_days, cast(n as bigint) as Orders,
 cast(tickets as bigint) as Tickets, cast(spent as decimal(18,2)) as Turnover, cast(won as decimal(18,2)) as Prize
from totals anti join listed using (User_ID) where {_ACTIVE}""")
def _order_behavior_stored(td):
    """A table set saved to the shared folder and loaded again. Its stored
    must-exclude list is a segment, not what the rule over the users gives."""
    folder = f"{ensure_checkpoint_dir(td.spark).rstrip('/')}/tables-{uuid.uuid4()}"
    loyal = td.table("rfm_score").filter("Segment = 'Loyal'").select("User_ID")
    t, read = replace(td.campaign, abnormal=loyal), ("orders_summary", "abnormal")
    save_tables(t, folder, partition_facts=False, only=read)
    return A.order_behavior(load_tables(td.spark, folder, base=t, only=read), as_of=AS_OF)


# ----------------------------------------------------------------------- audience algebra
_ALGEBRA_VIEWS = ("fact_orders", "rfm_score") + _ABN
_PRODUCTS = ["Lucky Day", "Instant", "Pick 3", "Merchant App"]


def _bitmaps(td) -> G.UserBitmaps:
    """Built once and kept; every question below reads the kept words only."""
    folder = f"{ensure_checkpoint_dir(td.spark).rstrip('/')}/bitmaps-{uuid.uuid4()}"
    G.UserBitmaps.build(G.memberships(td.campaign)).save(folder)
    return G.UserBitmaps.load(td.spark, folder)


@query("audience_sizes", _ALGEBRA_VIEWS, f"""
, sets as (
 select User_ID, list_distinct(list(Lottery)) as bought from fact_orders {CONTACTABLE} where {_ACTIVE} group by User_ID)
select 'Buy product' as audience, count(*) as audience_size from sets where list_contains(bought, 'Pick 3')
union all select 'Not buy product', count(*) from sets where not list_contains(bought, 'Pick 3')
union all select 'Only buy product', count(*) from sets where bought = ['Pick 3']
union all select 'All combinations', count(*) from sets
union all select 'RFM Segments', count(*) from rfm_score {CONTACTABLE} where Segment = 'Loyal'
union all select 'Users must exclude', count(*) from vw_abnormal_users""")
def _audience_sizes(td):
    return _bitmaps(td).sizes(G.audience_modes("Pick 3", _PRODUCTS, "Loyal"))


@query("audience_algebra", _ALGEBRA_VIEWS, f"""
, sets as (select User_ID, list(Lottery) as bought from fact_orders where {_ACTIVE} group by User_ID)
select User_ID from rfm_score left join sets using (User_ID) {CONTACTABLE}
where Segment in ('Loyal', 'Champions') and not (list_contains(coalesce(bought, []), 'Instant')
 and list_contains(coalesce(bought, []), 'Pick 3'))""")
def _audience_algebra(td):
    """Two segments, without those who bought both products and those not to be contacted."""
    both = G.has("bought Instant") & G.has("bought Pick 3")
    return _bitmaps(td).members(G.any_of("segment Loyal", "segment Champions") & ~both & ~G.has(G.EXCLUDED))


@query("audience_criteria", _ALGEBRA_VIEWS, f"""
, pairs as (
 select distinct 'bought ' || Lottery as criterion, User_ID from fact_orders where {_ACTIVE}
 union select 'segment ' || Segment, User_ID from rfm_score union select 'must exclude', User_ID from vw_abnormal_users)
select criterion, count(*) as audience_size from pairs group by criterion
union all select 'everyone', count(distinct User_ID) from pairs""")
def _audience_criteria(td):
    return G.criteria(_bitmaps(td))


@query("audience_numbered_files", ("rfm_score",) + _ABN, f"""
, kept as (select User_ID, row_number() over (order by User_ID) as n from rfm_score {CONTACTABLE} where Segment = 'Loyal')
select cast((n - 1) // 100 + 1 as int) as file, count(*) as n_rows, min(User_ID) as first_user, max(User_ID) as last_user
from kept group by all""")
def _audience_numbered_files(td):
    """I4: an ordered audience exported in files of 100 rows and read again, a row a file."""
    folder = f"{ensure_checkpoint_dir(td.spark).rstrip('/')}/files-{uuid.uuid4()}"
    write_audience_files(A.rfm_segment(td.campaign, "Loyal").orderBy("User_ID"), folder, 100)
    back = td.spark.read.option("header", True).schema("User_ID string, Segment string, file int").csv(folder)
    return back.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.min("User_ID").alias("first_user"),
                                    F.max("User_ID").alias("last_user"))


@query("upload_quarantine", ("upload_opt_out",), """
, lines as (
 select user_id, case when cast(user_id as int) % 5 = 0 then 'x' || user_id else cast(message_status as varchar) end as flag
 from upload_opt_out)
select reason, count(*) as n_lines from (
 select case when flag like 'x%' then 'message_status: not a int' else 'good' end as reason from lines) r group by reason""")
def _upload_quarantine(td):
    """An upload in which every fifth user's flag is no number, as good and rejected lines."""
    folder = f"{ensure_checkpoint_dir(td.spark).rstrip('/')}/upload-{uuid.uuid4()}"
    broken = F.when(F.col("user_id").cast("int") % 5 == 0, F.concat(F.lit("x"), "user_id")).otherwise(F.col("message_status").cast("string"))
    td.table("upload_opt_out").select("user_id", broken.alias("message_status")).write.option("header", True).csv(folder)
    got = read_upload_checked(td.spark, folder, {"user_id": "string", "message_status": "int"}, required=["user_id"])
    return got.good.select(F.lit("good").alias("reason")).unionByName(got.rejected.select("reason")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n_lines"))
