"""Queries over a table of campaigns (A2-A12 for many windows and audiences) and over
the maintained last-activity table (A7), with oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from campaignlab.operators import activity as X
from campaignlab.operators import last_activity as H
from campaignlab.operators.campaigns import CampaignSet
from campaignlab.plans.activity_queries import START, _avg_sql, _history, _median_sql
from campaignlab.plans.registry import query
from campaignlab.session import ensure_checkpoint_dir

_VIEWS = ("fact_orders", "campaign_windows", "campaign_audiences")
_DEPOSIT_VIEWS = ("fact_deposit", "campaign_windows", "campaign_audiences")

_MEMBERS = """, members as (
 select distinct a.campaign, a.User_ID, cast(c."start" as timestamp) as t0, cast(c."end" as timestamp) as t1
 from campaign_audiences a join campaign_windows c on a.campaign = c.campaign)"""
_BASE = _MEMBERS + """, base as (
 select m.campaign, o.User_ID, o.Lottery, cast(sum(Entries) as bigint) as Ticket_sold,
  cast(sum(Turnover) as decimal(18,2)) as Turnover, cast(sum(Prize) as decimal(18,2)) as Prize
 from fact_orders o join members m on o.User_ID = m.User_ID and o.Creation_date between m.t0 and m.t1
 group by all),
u as (
 select campaign, User_ID, cast(sum(Ticket_sold) as bigint) as Ticket_sold, cast(sum(Turnover) as decimal(18,2)) as Turnover,
  cast(sum(Prize) as decimal(18,2)) as Prize
 from base group by all)"""
_DEPOSITS = _MEMBERS + """, d as (
 select m.campaign, f.User_ID, count(*) as attempt_depo,
  cast(sum(case when top_up_state in ('Handling', 'Success') then top_up_amount end) as decimal(18,2)) as success_depo_amount
 from fact_deposit f join members m on f.User_ID = m.User_ID and f.creation_date between m.t0 and m.t1
 group by all)"""


def _set(td) -> CampaignSet:
    return CampaignSet(td.campaign, td.table("campaign_windows"), td.table("campaign_audiences"))


@query("campaigns_base", _VIEWS, _BASE + "\nselect * from base")
def _campaigns_base(td):
    return _set(td).base


@query("campaigns_by_product", _VIEWS, _BASE + f"""
select campaign, Lottery, count(*) as Player, cast(sum(Ticket_sold) as bigint) as Ticket_sold,
 cast(sum(Turnover) as decimal(18,2)) as Turnover, cast(sum(Prize) as decimal(18,2)) as Prize,
 {_avg_sql('sum(Turnover)', 'count(*)')} as "Avg spend"
from base group by all""")
def _campaigns_by_product(td):
    return _set(td).by_product()


@query("campaigns_by_ticket_segment", _VIEWS, _BASE + f"""
, seg as (
 select *, coalesce((select label from (values (1, '1'), (5, '<=5'), (10, '<=10'), (50, '<=50'), (100, '<=100'), (200, '<=200')) b(upto, label)
  where (upto = 1 and Ticket_sold = 1) or (upto > 1 and Ticket_sold <= upto) order by upto limit 1), '>200') as ticket_segment from u)
select campaign, ticket_segment, count(*) as Player, cast(sum(Ticket_sold) as bigint) as Ticket_sold,
 cast(sum(Turnover) as decimal(18,2)) as Turnover, {_avg_sql('sum(Turnover)', 'count(*)')} as "Avg spend"
from seg group by all""")
def _campaigns_by_ticket_segment(td):
    return _set(td).by_ticket_segment()


@query("campaigns_deposits", _DEPOSIT_VIEWS, _DEPOSITS + "\nselect * from d")
def _campaigns_deposits(td):
    return _set(td).deposits


@query("campaigns_deposit_summary", _DEPOSIT_VIEWS, _DEPOSITS + f"""
select c.campaign, count(d.User_ID) as Attempt_users, cast(coalesce(sum(attempt_depo), 0) as bigint) as Attempts,
 count(case when success_depo_amount > 0 then 1 end) as Success_users,
 cast(sum(success_depo_amount) as decimal(18,2)) as Success_amount, cast(min(success_depo_amount) as decimal(18,2)) as Min_amount,
 {_avg_sql('sum(success_depo_amount)', 'count(success_depo_amount)')} as Avg_amount,
 cast(max(success_depo_amount) as decimal(18,2)) as Max_amount
from campaign_windows c left join d on c.campaign = d.campaign group by c.campaign""")
def _campaigns_deposit_summary(td):
    return _set(td).deposit_summary()


@query("campaigns_summary", _VIEWS, _BASE + f"""
, n as (select campaign, count(*) as Receiver from members group by campaign)
select c.campaign, cast(coalesce(n.Receiver, 0) as bigint) as Receiver, count(u.User_ID) as Active_players,
 cast(((cast(count(u.User_ID) as hugeint) * 10000 * 2 + n.Receiver) // (2 * n.Receiver)) / 100 as decimal(18,2)) as Active_percentage,
 cast(sum(u.Ticket_sold) as bigint) as Ticket_sold, cast(sum(u.Turnover) as decimal(18,2)) as Turnover,
 {_avg_sql('sum(u.Turnover)', 'count(u.User_ID)')} as Avg_spend
from campaign_windows c left join n on c.campaign = n.campaign left join u on c.campaign = u.campaign group by c.campaign, n.Receiver""")
def _campaigns_summary(td):
    return _set(td).summary()


def _stats_sql() -> str:
    cells = {"average": lambda c: _avg_sql(f"sum({c})", f"count({c})"), "min": lambda c: f"cast(min({c}) as decimal(18,2))",
             "median": _median_sql, "max": lambda c: f"cast(max({c}) as decimal(18,2))"}
    return _BASE + "\n" + "\nunion all ".join(
        f"select c.campaign, '{s}' as stat, " + ", ".join(f"{f(x)} as {x}" for x in X.STAT_COLUMNS)
        + " from campaign_windows c left join u on c.campaign = u.campaign group by c.campaign" for s, f in cells.items())


@query("campaigns_stats", _VIEWS, _stats_sql())
def _campaigns_stats(td):
    return _set(td).stats()


_REACTIVATION = _BASE + f"""
, h as (
 select m.campaign, o.User_ID,
  concat('>= ', cast(datediff('day', max(DateID), cast(m.t0 as date)) // 30 as varchar), ' month') as inactive_month
 from fact_orders o join members m on o.User_ID = m.User_ID and o.Creation_date < m.t0 group by m.campaign, m.t0, o.User_ID)"""


@query("campaigns_inactive_months", _VIEWS, _REACTIVATION + "\nselect * from h")
def _campaigns_inactive_months(td):
    return _set(td).inactive_months()


@query("campaigns_reactivation", _VIEWS, _REACTIVATION + f"""
select u.campaign, coalesce(h.inactive_month, 'FTP') as inactive_month, count(*) as "Reactivated player",
 cast(sum(u.Ticket_sold) as bigint) as "Ticket sold", cast(sum(u.Turnover) as decimal(18,2)) as Turnover,
 {_avg_sql('sum(u.Turnover)', 'count(*)')} as "Avg spend"
from u left join h on u.campaign = h.campaign and u.User_ID = h.User_ID group by u.campaign, coalesce(h.inactive_month, 'FTP')""")
def _campaigns_reactivation(td):
    return _set(td).reactivation()


@query("campaigns_empty", _VIEWS, _BASE + """
select c.campaign, count(base.User_ID) = 0 as empty
from campaign_windows c left join base on c.campaign = base.campaign group by c.campaign""")
def _campaigns_empty(td):
    return _set(td).empty()


# ----------------------------------------------------------------------- A7, maintained
def _maintained(td):
    """The table as deployments keep it: the first years at once, then two later lots of orders."""
    folder = f"{ensure_checkpoint_dir(td.spark).rstrip('/')}/last-days-{uuid.uuid4()}"
    orders, year = td.campaign.orders, F.year("Creation_date")
    for lot in (year < 1998, year == 1998, year > 1998):
        H.add_orders(td.spark, folder, orders.filter(lot))
    return H.read_last_days(td.spark, folder)


@query("inactive_months_maintained", ("fact_orders", "upload_audience"), _history(START) + "\nselect * from h")
def _inactive_months_maintained(td):
    ids = X.audience(td.table("upload_audience"))
    return H.inactive_months_maintained(td.campaign, _maintained(td), ids, START)


@query("last_days_agree", ("fact_orders",), """
select cast(date_trunc('month', Creation_date) as date) as month, count(distinct User_ID) as users, true as agree
from fact_orders group by all""")
def _last_days_agree(td):
    return H.last_days_agree(_maintained(td), td.campaign.orders)
