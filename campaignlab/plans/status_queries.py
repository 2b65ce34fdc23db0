"""Status-update queries (U1-U5, and E10b on the updated snapshot) with
oracle SQL. The fixture uploads name the id column ``user_id`` (the CSV
headers ``User ID`` / ``User Status`` are the operator defaults)."""

from __future__ import annotations

import uuid

from campaignlab.operators import audience as A
from campaignlab.operators import status as S
from campaignlab.plans.registry import query
from campaignlab.session import ensure_checkpoint_dir
from campaignlab.sources import snapshots as P

_USER_COLS = ["User_ID", "registerTime", "verification_status", "nationality", "attempt_depo", "FTD", "FTP",
              "user_status", "RG_limit", "receive_mail", "receive_message", "receive_sms"]

_RG = "(select distinct trim(user_id) as user_id from upload_rg_limit where user_id is not null)"
_OPT = """(select user_id, receive_mail, receive_message, receive_sms from (
  select trim(user_id) as user_id, mail_status as receive_mail, message_status as receive_message,
   sms_status as receive_sms,
   row_number() over (partition by trim(user_id) order by updated_time desc nulls last, mail_status desc nulls last,
    message_status desc nulls last, sms_status desc nulls last) as rn
  from upload_opt_out where user_id is not null) x where rn = 1)"""
_ST = "(select distinct trim(user_id) as user_id, user_status from upload_user_status where user_id is not null)"


def _select(overrides: dict[str, str], src: str) -> str:
    cols = [f"{overrides.get(c, f'{src}.{c}')} as {c}" for c in _USER_COLS]
    return ", ".join(cols)


def _rg_step(src: str) -> str:
    return (f"select {_select({'RG_limit': 'case when rg.user_id is not null then 1 else u.RG_limit end'}, 'u')} "
            f"from {src} u left join {_RG} rg on u.User_ID = rg.user_id")


def _opt_step(src: str) -> str:
    over = {c: f"case when o.user_id is not null then o.{c} else u.{c} end"
            for c in ("receive_mail", "receive_message", "receive_sms")}
    return f"select {_select(over, 'u')} from {src} u left join {_OPT} o on u.User_ID = o.user_id"


def _status_step(src: str) -> str:
    over = {"user_status": "case when s.user_id is not null then s.user_status else u.user_status end"}
    return f"select {_select(over, 'u')} from {src} u left join {_ST} s on u.User_ID = s.user_id"


_ALL = f""", s1 as ({_rg_step('dim_user_authentication')}),
s2 as ({_opt_step('s1')}),
s3 as ({_status_step('s2')})"""


def _users(td):
    return td.table("dim_user_authentication")


@query("rg_limit_update", ("dim_user_authentication", "upload_rg_limit"), _rg_step("dim_user_authentication"))
def _rg_limit_update(td):
    return S.apply_rg_limit(_users(td), td.table("upload_rg_limit"), id_column="user_id")


@query("opt_out_update", ("dim_user_authentication", "upload_opt_out"), _opt_step("dim_user_authentication"))
def _opt_out_update(td):
    return S.apply_opt_out(_users(td), td.table("upload_opt_out"))


@query("user_status_update", ("dim_user_authentication", "upload_user_status"),
       _status_step("dim_user_authentication"))
def _user_status_update(td):
    return S.apply_user_status(_users(td), td.table("upload_user_status"), id_column="user_id",
                               status_column="user_status")


def _all(td):
    return S.update_status(_users(td), td.table("upload_rg_limit"), td.table("upload_opt_out"),
                           td.table("upload_user_status"), rg_id_column="user_id",
                           status_id_column="user_id", status_column="user_status")


_ALL_VIEWS = ("dim_user_authentication", "upload_rg_limit", "upload_opt_out", "upload_user_status")


@query("status_update_all", _ALL_VIEWS, _ALL + "\nselect * from s3")
def _status_update_all(td):
    return _all(td)


@query("status_update_partial", _ALL_VIEWS, _ALL + "\nselect * from s3")
def _status_update_partial(td):
    """U4, U5 on a stored snapshot: only the folders that hold an uploaded id are rewritten."""
    folder = f"{ensure_checkpoint_dir(td.spark).rstrip('/')}/users-{uuid.uuid4()}"
    P.save_snapshot(_users(td), folder, parts=32)
    P.update_snapshot(td.spark, folder, td.table("upload_rg_limit"), td.table("upload_opt_out"), td.table("upload_user_status"),
                      rg_id_column="user_id", status_id_column="user_id", status_column="user_status")
    return P.read_snapshot(td.spark, folder)


@query("must_exclude_after_update", _ALL_VIEWS, _ALL + """
select User_ID from s3
where RG_limit = 1 or receive_message = 0 or user_status in ('suspend','close','locked','restricted')""")
def _must_exclude_after_update(td):
    return A.abnormal_users(_all(td))
