"""Small hand-made campaign tables for unit tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

from campaignlab.sources.tables import SCHEMAS, TABLE_NAMES, CampaignTables

D = Decimal


def schema_of(table: str) -> T.StructType:
    return T.StructType([T.StructField(c, t, True) for c, t in SCHEMAS[table].items()])


def frame(spark, table: str, rows: list[dict] | None = None):
    cols = list(SCHEMAS[table])
    data = [tuple(r.get(c) for c in cols) for r in (rows or [])]
    return spark.createDataFrame(data, schema_of(table))


def tables(spark, **rows) -> CampaignTables:
    """A table set where each keyword (attribute name) gives the rows of one
    table; the others are empty."""
    return CampaignTables(**{attr: frame(spark, name, rows.get(attr)) for attr, name in TABLE_NAMES.items()})


def order(user, lottery="Lucky Day", game=1, when="2000-01-10 10:00:00", entries=1, turnover="5.00",
          prize="0.00", draw=60, series=991201):
    ts = dt.datetime.fromisoformat(when)
    return {"User_ID": user, "GameID": game, "Lottery": lottery, "Creation_date": ts, "DateID": ts.date(),
            "Draw_Period": draw, "Series_No": series, "Entries": entries, "Turnover": D(turnover), "Prize": D(prize)}


def summary(user, game=1, day="2000-01-10", draw=60, series="1-1", orders=1, entries=1, turnover="5.00",
            prize="0.00"):
    return {"User_ID": user, "GameID": game, "DateID": dt.date.fromisoformat(day), "Draw_Period": draw,
            "Game_series": series, "Orders": orders, "Entries": entries, "Turnover": D(turnover), "Prize": D(prize)}


def deposit(user, amount="100.00", state="Success", when="2000-01-10 10:00:00", memo="1-URGENT", top_up_id=1):
    return {"User_ID": user, "top_up_id": top_up_id, "top_up_amount": D(amount), "top_up_state": state,
            "creation_date": dt.datetime.fromisoformat(when), "gateway_memo": memo}


def user(uid, status="active", rg=0, msg=1, registered=True):
    return {"User_ID": uid, "registerTime": dt.datetime(1999, 1, 1) if registered else None,
            "verification_status": "Verified", "nationality": "X", "attempt_depo": 0, "FTD": None, "FTP": None,
            "user_status": status, "RG_limit": rg, "receive_mail": 1, "receive_message": msg, "receive_sms": 1}
