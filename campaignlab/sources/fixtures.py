"""Campaign tables derived from the star-schema test data.

The test data ships TPC-H-like tables (customer, orders, lineitem, part,
events, ...). The campaign domain (users, orders facts, deposits, ...) is a set
of views over them, defined once as SQL text. The same text feeds Spark (each
``{name}`` placeholder is bound to a DataFrame through ``spark.sql`` keyword
arguments, so no global temp view is registered) and the DuckDB oracle (where
the placeholders become the pre-registered table names, inlined as a WITH
list). See FIXTURES.md for the reasoning behind each view.
"""

from __future__ import annotations

import math
import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Fixed view definitions (FIXTURES.md). Order matters: a view may only use
# base tables and views defined above it.
FIXTURE_SQL: dict[str, str] = {
    "dim_games": """
select cast(p_partkey % 100 as int) as GameID,
 case p_partkey % 4 when 0 then 'Lucky Day' when 1 then 'Instant' when 2 then 'Pick 3' else 'Merchant App' end as Lottery,
 cast((sum(p_size) % 5 + 1) * 5 as int) as Unit_Price
from {part} group by p_partkey % 100, p_partkey % 4""",
    "fact_orders": """
select cast(o.o_custkey as string) as User_ID, o.o_orderkey as Order_ID, g.GameID, g.Lottery,
 o.o_orderdate as Creation_date, cast(o.o_orderdate as date) as DateID,
 cast((year(l.l_shipdate) - 1995) * 12 + month(l.l_shipdate) as int) as Draw_Period,
 cast((year(l.l_shipdate) % 100) * 10000 + month(l.l_shipdate) * 100 + day(l.l_shipdate) as int) as Series_No,
 concat(cast(g.GameID as string), '-', cast((year(l.l_shipdate) - 1995) * 4 + quarter(l.l_shipdate) as string)) as Game_series,
 cast(case o.o_custkey % 4 when 0 then 1 when 1 then ceil(l.l_quantity / 10) else l.l_quantity end as bigint) as Entries,
 cast(case o.o_custkey % 4 when 0 then 1 when 1 then ceil(l.l_quantity / 10) else l.l_quantity end * g.Unit_Price as decimal(18,2)) as Turnover,
 cast(case when l.l_returnflag <> 'R' then 0 when l.l_linenumber = 7 and g.GameID = 72 then 150000
      else floor(l.l_extendedprice / 200) end as decimal(18,2)) as Prize
from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey
join {dim_games} g on g.GameID = l.l_partkey % 100
 + case when o.o_custkey % 8 = 2 then 1 - l.l_partkey % 4 when o.o_custkey % 8 = 3 and l.l_partkey % 4 = 2 then -2
        when o.o_custkey % 8 = 5 and l.l_partkey % 4 in (1, 3) then -1 else 0 end""",
    "fact_orders_summary": """
select User_ID, GameID, DateID, Draw_Period, Game_series, count(distinct Order_ID) as Orders,
 cast(sum(Entries) as bigint) as Entries, cast(sum(Turnover) as decimal(18,2)) as Turnover,
 cast(sum(Prize) as decimal(18,2)) as Prize
from {fact_orders} group by User_ID, GameID, DateID, Draw_Period, Game_series""",
    "fact_deposit": """
select case when o_orderkey % 97 = 0 then null else cast(o_custkey as string) end as User_ID, o_orderkey as top_up_id,
 cast(floor(o_totalprice / 100) as decimal(18,2)) as top_up_amount,
 case o_orderstatus when 'F' then 'Success' when 'O' then 'Handling' else 'Failure' end as top_up_state,
 o_orderdate as creation_date, o_orderpriority as gateway_memo
from {orders}""",
    "dim_fail_deposit_group": """
select distinct o_orderpriority as gateway_memo,
 case when o_orderpriority like '1%' then 'Bank declined' when o_orderpriority like '2%' then 'Insufficient funds'
      else 'Timeout' end as fail_group
from {orders} where o_orderpriority < '4'""",
    "fact_withdraw": """
select case when event_id % 89 = 0 then null else cast(user_id as string) end as User_ID,
 cast(value as decimal(18,2)) as withdrawal_amount,
 case when event_id % 11 = 0 then null when event_id % 7 = 0 then 'Failure' when event_id % 7 = 1 then 'Bank reverted'
      else 'Success' end as withdrawal_status, date '1995-01-01' + cast(event_id % 2500 as int) as withdrawal_date
from {events} where event_type = 'purchase'""",
    "fact_refund": """
select case when event_id % 83 = 0 then null else cast(user_id as string) end as User_ID,
 cast(value as decimal(18,2)) as Refund_amount,
 case when event_id % 5 = 0 then 'Failure' else 'Success' end as Memo,
 date '1995-01-01' + cast(event_id * 7 % 2500 as int) as refund_date
from {events} where event_type = 'error'""",
    "dim_user_authentication": """
select cast(c.c_custkey as string) as User_ID, case when c.c_custkey % 50 = 0 then null else f.first_order end as registerTime,
 case c.c_custkey % 3 when 0 then 'Verified' when 1 then 'Pending' else 'Rejected' end as verification_status,
 n.n_name as nationality, cast(coalesce(f.orders, 0) as int) as attempt_depo,
 cast(f.first_success as date) as FTD, cast(f.first_order as date) as FTP,
 case when c.c_acctbal < -900 then 'suspend' when c.c_acctbal < -800 then 'close' when c.c_acctbal < -700 then 'locked'
      when c.c_acctbal < -600 then 'restricted' else 'active' end as user_status,
 case when c.c_acctbal >= -600 and c.c_acctbal < -400 then 1 else 0 end as RG_limit,
 1 as receive_mail, case when c.c_acctbal >= -400 and c.c_acctbal < -200 then 0 else 1 end as receive_message, 1 as receive_sms
from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey
left join (select o_custkey, min(o_orderdate) as first_order, min(case when o_orderstatus = 'F' then o_orderdate end) as first_success,
           count(*) as orders from {orders} group by o_custkey) f on f.o_custkey = c.c_custkey""",
    "vw_abnormal_users": """
select User_ID from {dim_user_authentication}
where RG_limit = 1 or receive_message = 0 or user_status in ('suspend','close','locked','restricted')""",
    "rfm_score": """
select cast(c_custkey as string) as User_ID,
 case c_mktsegment when 'AUTOMOBILE' then 'Champions' when 'BUILDING' then 'Loyal' when 'FURNITURE' then 'At risk'
      when 'HOUSEHOLD' then 'New' else 'Hibernating' end as Segment
from {customer}""",
    "upload_audience": """
select cast(c_custkey as string) as User_ID from {customer} where c_custkey % 3 = 0
union all select cast(c_custkey as string) from {customer} where c_custkey % 6 = 0
union all select '999999999'""",
    "campaign_windows": """
select concat('campaign ', cast(r_regionkey as string)) as campaign,
 concat(cast(date '1995-03-11' + cast(r_regionkey * 410 as int) as string), ' 06:30:00') as start,
 concat(cast(date '1995-03-11' + cast(r_regionkey * 410 + 500 as int) as string), ' 23:59:00') as end
from {region}
union all select concat('test ', cast(r_regionkey as string)), '1990-01-01 00:00:00', '1990-02-01 00:00:00' from {region} where r_regionkey < 2""",
    "campaign_audiences": """
select 'campaign 0' as campaign, cast(c_custkey as string) as User_ID from {customer} where c_custkey % 2 = 0
union all select 'campaign 1', cast(c_custkey as string) from {customer} where c_custkey % 3 = 0
union all select 'campaign 2', cast(c_custkey as string) from {customer} where c_custkey % 4 = 0
union all select 'campaign 3', cast(c_custkey as string) from {customer} where c_custkey % 5 = 0
union all select concat('campaign ', cast(r_regionkey as string)), '999999999' from {region} where r_regionkey < 4
union all select 'test 1', cast(c_custkey as string) from {customer} where c_custkey % 7 = 0
union all select 'unknown', cast(c_custkey as string) from {customer} where c_custkey % 7 = 0""",
    "upload_rg_limit": """
select cast(c_custkey as string) as user_id from {customer} where c_custkey % 11 = 0
union all select cast(c_custkey as string) from {customer} where c_custkey % 22 = 0
union all select '999999999'""",
    "upload_opt_out": """
select cast(c_custkey as string) as user_id, 0 as message_status, cast(c_custkey % 2 as int) as mail_status,
 0 as sms_status, date '2001-02-01' as updated_time from {customer} where c_custkey % 13 = 0
union all select cast(c_custkey as string), 1, 1, 1, date '2001-01-01' from {customer} where c_custkey % 26 = 0""",
    "upload_user_status": """
select cast(c_custkey as string) as user_id, 'close' as user_status from {customer} where c_custkey % 17 = 0""",
}

# What a view's input is dealt out by where it is large (``TestData.tasks``): {view: {input: keys}}. The two sides of the
# join of the order facts by its key, the facts by the key of their summary: the steps that hold rows in memory.
DEALT = {
    "fact_orders": {"lineitem": ("l_orderkey",), "orders": ("o_orderkey",)},
    "fact_orders_summary": {"fact_orders": ("User_ID", "GameID", "DateID", "Draw_Period", "Game_series")},
}
COUNTED = ("lineitem", "orders")
ROWS_PER_TASK = 1 << 18
FEW_TASKS = 16  # up to here Spark's own number of partitions stays
MOST_TASKS = 20_000  # or what the session is set to, if more: the driver keeps track of every partition

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def dependencies(view: str) -> list[str]:
    """Names (base tables or views) a view's SQL reads."""
    return list(dict.fromkeys(_PLACEHOLDER.findall(FIXTURE_SQL[view])))


def view_closure(views: list[str]) -> list[str]:
    """The given views plus every view they depend on, in definition order."""
    need: set[str] = set()
    stack = list(views)
    while stack:
        v = stack.pop()
        if v in need or v not in FIXTURE_SQL:
            continue
        need.add(v)
        stack.extend(dependencies(v))
    return [v for v in FIXTURE_SQL if v in need]


def duckdb_with(views: list[str]) -> str:
    """``WITH a AS (...), b AS (...)`` for the DuckDB oracle (no trailing space)."""
    parts = []
    for v in view_closure(views):
        body = _PLACEHOLDER.sub(lambda m: m.group(1), FIXTURE_SQL[v]).strip()
        parts.append(f"{v} AS ({body})")
    return "WITH " + ",\n".join(parts)


class TestData:
    """Lazily derived campaign views over one test-data folder.

    Every attribute is a lazy DataFrame; nothing runs until an action. Only the
    views a query touches are built, and Catalyst prunes the columns and pushes
    the filters of each query down into the parquet scans.
    """

    __test__ = False  # not a pytest test class

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}
        self._rows: dict[str, int] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in FIXTURE_SQL:
                deps = {d: self._dealt(name, d) for d in dependencies(name)}
                self._frames[name] = self.spark.sql(FIXTURE_SQL[name], **deps)
            else:
                self._frames[name] = self._scan(name)
        return self._frames[name]

    def _scan(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in COUNTED:  # from the files' footers, as the schema
            self._rows[name] = df.count()
        return df

    @property
    def tasks(self) -> int:
        """Tasks that take ``ROWS_PER_TASK`` rows of the order facts' inputs each, so that a task's memory stays when the
        tables grow. The session's number of partitions does not follow the tables, and AQE joins small ones by
        their compressed bytes."""
        for name in COUNTED:
            self.table(name)
        most = max(MOST_TASKS, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return min(math.ceil(sum(self._rows.values()) / ROWS_PER_TASK), most)

    def _dealt(self, view: str, name: str) -> DataFrame:
        df, keys = self.table(name), DEALT.get(view, {}).get(name)
        if keys is None or self.tasks <= FEW_TASKS:
            return df
        return df.repartition(self.tasks, *keys)

    @cached_property
    def campaign(self):
        from campaignlab.sources.tables import CampaignTables

        return CampaignTables(
            users=self.table("dim_user_authentication"),
            orders=self.table("fact_orders"),
            orders_summary=self.table("fact_orders_summary"),
            games=self.table("dim_games"),
            deposits=self.table("fact_deposit"),
            fail_groups=self.table("dim_fail_deposit_group"),
            withdrawals=self.table("fact_withdraw"),
            refunds=self.table("fact_refund"),
            rfm=self.table("rfm_score"),
            abnormal=self.table("vw_abnormal_users"),
        )


class StoredTestData(TestData):
    """Like ``TestData``, but the campaign tables are read from a folder
    written once by ``save_tables`` (uploads are still derived)."""

    def __init__(self, spark: SparkSession, sf_dir: str, tables_dir: str):
        super().__init__(spark, sf_dir)
        self.tables_dir = tables_dir.rstrip("/")

    @cached_property
    def campaign(self):
        from dataclasses import replace

        # save_tables writes DateID as the date of Creation_date
        return replace(super().campaign, orders_day="DateID")

    def table(self, name: str) -> DataFrame:
        from campaignlab.sources.tables import TABLE_NAMES

        if name in TABLE_NAMES.values() and name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.tables_dir}/{name}")
        return super().table(name)
