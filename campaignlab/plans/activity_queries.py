"""Campaign activity queries (A1-A11) with fixture parameters
and oracle SQL. Averages and percentages are rounded half-up on exact
decimals in Spark; the SQL reproduces that with integer cents, because DuckDB
divides decimals in floating point."""

from __future__ import annotations

from campaignlab.operators import activity as X
from campaignlab.plans.registry import query

# Fixed test parameters.
START, END = "2000-01-01 00:00:00", "2000-06-30 23:59:00"
EARLY_START, EARLY_END = "1995-06-01 00:00:00", "1995-11-30 23:59:00"

_V = ("fact_orders", "upload_audience")
_VD = ("fact_deposit", "upload_audience")


def _avg_sql(total: str, n: str) -> str:
    """round(total / n, 2) half-up, exact, as decimal(18,2)."""
    return f"cast(((cast(({total}) * 100 as hugeint) * 2 + ({n})) // (2 * ({n}))) / 100 as decimal(18,2))"


def _median_sql(x: str) -> str:
    return f"cast(floor(quantile_cont(cast({x} * 100 as bigint), 0.5) + 0.5) / 100 as decimal(18,2))"


_IDS = "(select distinct trim(User_ID) as User_ID from upload_audience)"


def _base(start: str, end: str) -> str:
    return f""", base as (
 select o.User_ID, o.Lottery, cast(sum(Entries) as bigint) as Ticket_sold,
  cast(sum(Turnover) as decimal(18,2)) as Turnover, cast(sum(Prize) as decimal(18,2)) as Prize
 from fact_orders o
 where o.Creation_date between timestamp '{start}' and timestamp '{end}' and o.User_ID in (select User_ID from {_IDS})
 group by o.User_ID, o.Lottery),
u as (
 select User_ID, cast(sum(Ticket_sold) as bigint) as Ticket_sold, cast(sum(Turnover) as decimal(18,2)) as Turnover,
  cast(sum(Prize) as decimal(18,2)) as Prize
 from base group by User_ID)"""


def _history(start: str) -> str:
    day = start[:10]
    return f""", h as (
 select User_ID, concat('>= ', cast(datediff('day', max(DateID), date '{day}') // 30 as varchar), ' month')
  as inactive_month
 from fact_orders where Creation_date < timestamp '{start}' and User_ID in (select User_ID from {_IDS})
 group by User_ID)"""


def _deposits(start: str, end: str) -> str:
    return f""", d as (
 select User_ID, count(*) as attempt_depo,
  cast(sum(case when top_up_state in ('Handling', 'Success') then top_up_amount end) as decimal(18,2))
   as success_depo_amount
 from fact_deposit
 where creation_date between timestamp '{start}' and timestamp '{end}' and User_ID in (select User_ID from {_IDS})
 group by User_ID)"""


def _ids(td):
    return X.audience(td.table("upload_audience"))


@query("audience", ("upload_audience",), f"select * from {_IDS} a")
def _audience(td):
    return _ids(td)


@query("activity_base", _V, _base(START, END) + "\nselect * from base")
def _activity_base(td):
    return X.activity_base(td.campaign, _ids(td), START, END)


@query("activity_by_user", _V, _base(START, END) + "\nselect * from u")
def _activity_by_user(td):
    return X.activity_by_user(X.activity_base(td.campaign, _ids(td), START, END))


@query("activity_by_product", _V, _base(START, END) + f"""
select Lottery, count(*) as Player, cast(sum(Ticket_sold) as bigint) as Ticket_sold,
 cast(sum(Turnover) as decimal(18,2)) as Turnover, cast(sum(Prize) as decimal(18,2)) as Prize,
 {_avg_sql('sum(Turnover)', 'count(*)')} as "Avg spend"
from base group by Lottery""")
def _activity_by_product(td):
    return X.activity_by_product(X.activity_base(td.campaign, _ids(td), START, END))


@query("activity_by_ticket_segment", _V, _base(START, END) + f"""
, seg as (
 select *, case when Ticket_sold = 1 then '1' when Ticket_sold <= 5 then '<=5' when Ticket_sold <= 10 then '<=10'
  when Ticket_sold <= 50 then '<=50' when Ticket_sold <= 100 then '<=100' when Ticket_sold <= 200 then '<=200'
  else '>200' end as ticket_segment
 from u)
select ticket_segment, count(*) as Player, cast(sum(Ticket_sold) as bigint) as Ticket_sold,
 cast(sum(Turnover) as decimal(18,2)) as Turnover, {_avg_sql('sum(Turnover)', 'count(*)')} as "Avg spend"
from seg group by ticket_segment""")
def _activity_by_ticket_segment(td):
    by_user = X.activity_by_user(X.activity_base(td.campaign, _ids(td), START, END))
    return X.activity_by_ticket_segment(by_user)


@query("activity_deposits", _VD, _deposits(START, END) + "\nselect * from d")
def _activity_deposits(td):
    return X.activity_deposits(td.campaign, _ids(td), START, END)


@query("inactive_months", _V, _history(START) + "\nselect * from h")
def _inactive_months(td):
    return X.inactive_months(td.campaign, _ids(td), START)


_SUMMARY = _base(START, END) + f"""
, r as (select count(*) as Receiver from {_IDS} a),
kpi as (
 select cast(r.Receiver as bigint) as Receiver, count(u.User_ID) as Active_players,
  cast(((cast(count(u.User_ID) as hugeint) * 10000 * 2 + r.Receiver) // (2 * r.Receiver)) / 100 as decimal(18,2))
   as Active_percentage,
  cast(sum(u.Ticket_sold) as bigint) as Ticket_sold, cast(sum(u.Turnover) as decimal(18,2)) as Turnover,
  {_avg_sql('sum(u.Turnover)', 'count(u.User_ID)')} as Avg_spend
 from r left join u on true group by r.Receiver)"""


def _summary(td):
    ids = _ids(td)
    return X.activity_summary(ids, X.activity_by_user(X.activity_base(td.campaign, ids, START, END)))


@query("activity_summary", _V, _SUMMARY + "\nselect * from kpi")
def _activity_summary(td):
    return _summary(td)


_DEPOSIT_KPI = _deposits(START, END) + f"""
, kpi as (
 select count(*) as Attempt_users, cast(coalesce(sum(attempt_depo), 0) as bigint) as Attempts,
  count(case when success_depo_amount > 0 then 1 end) as Success_users,
  cast(sum(success_depo_amount) as decimal(18,2)) as Success_amount,
  cast(min(success_depo_amount) as decimal(18,2)) as Min_amount,
  {_avg_sql('sum(success_depo_amount)', 'count(success_depo_amount)')} as Avg_amount,
  cast(max(success_depo_amount) as decimal(18,2)) as Max_amount
 from d)"""


def _deposit_kpi(td):
    return X.deposit_summary(X.activity_deposits(td.campaign, _ids(td), START, END))


@query("deposit_summary", _VD, _DEPOSIT_KPI + "\nselect * from kpi")
def _deposit_summary(td):
    return _deposit_kpi(td)


def _table_sql(labels: dict[str, str]) -> str:
    """The KPI row as (Metric, Value) text rows."""
    whole = lambda c: f"format('{{:,}}', cast(floor({c}) as bigint))"
    text = {"Active_percentage": "cast(Active_percentage as varchar) || '%'", "Avg_spend": "cast(Avg_spend as varchar)",
            "Avg_amount": "cast(Avg_amount as varchar)"}
    return "\n" + "\nunion all ".join(
        f"select '{label}' as Metric, coalesce({text.get(c, whole(c))}, '') as Value from kpi" for c, label in labels.items())


@query("report_overview_table", _V, _SUMMARY + _table_sql(X.SUMMARY_LABELS))
def _report_overview_table(td):
    return X.metric_rows(_summary(td), X.SUMMARY_LABELS)


@query("report_deposit_table", _VD, _DEPOSIT_KPI + _table_sql(X.DEPOSIT_LABELS))
def _report_deposit_table(td):
    return X.metric_rows(_deposit_kpi(td), X.DEPOSIT_LABELS)


@query("report_empty", _V, _base(START, END) + "\nselect count(*) = 0 as empty from base")
def _report_empty(td):
    return X.empty_signal(X.activity_base(td.campaign, _ids(td), START, END))


def _stats_sql() -> str:
    cols = X.STAT_COLUMNS
    avg = ", ".join(f"{_avg_sql(f'sum({c})', f'count({c})')} as {c}" for c in cols)
    mn = ", ".join(f"cast(min({c}) as decimal(18,2)) as {c}" for c in cols)
    med = ", ".join(f"{_median_sql(c)} as {c}" for c in cols)
    mx = ", ".join(f"cast(max({c}) as decimal(18,2)) as {c}" for c in cols)
    return _base(START, END) + f"""
select 'average' as stat, {avg} from u
union all select 'min', {mn} from u
union all select 'median', {med} from u
union all select 'max', {mx} from u"""


@query("activity_stats", _V, _stats_sql())
def _activity_stats(td):
    return X.activity_stats(X.activity_by_user(X.activity_base(td.campaign, _ids(td), START, END)))


def _reactivation_sql(start: str, end: str) -> str:
    return _base(start, end) + _history(start) + f"""
select coalesce(h.inactive_month, 'FTP') as inactive_month, count(*) as "Reactivated player",
 cast(sum(u.Ticket_sold) as bigint) as "Ticket sold", cast(sum(u.Turnover) as decimal(18,2)) as Turnover,
 {_avg_sql('sum(u.Turnover)', 'count(*)')} as "Avg spend"
from u left join h on u.User_ID = h.User_ID
group by coalesce(h.inactive_month, 'FTP')"""


def _reactivation(td, start, end):
    ids = _ids(td)
    by_user = X.activity_by_user(X.activity_base(td.campaign, ids, start, end))
    return X.reactivation(by_user, X.inactive_months(td.campaign, ids, start))


@query("reactivation", _V, _reactivation_sql(START, END))
def _reactivation_w(td):
    return _reactivation(td, START, END)


@query("reactivation_early", _V, _reactivation_sql(EARLY_START, EARLY_END))
def _reactivation_early(td):
    return _reactivation(td, EARLY_START, EARLY_END)
