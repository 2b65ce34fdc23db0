"""User-status updates (U1-U5): uploads applied to the user table.

The reference stages each upload into a SQL table and runs ``UPDATE ... FROM
... JOIN``. Here the user table is an immutable snapshot: an update is a left
join of the snapshot with the de-duplicated upload and a ``when(matched,
new).otherwise(old)`` per updated column; the caller writes the new snapshot
once (one atomic overwrite, or ``MERGE INTO`` on a table format that has it).

Scale: the upload is reduced to one row per key by a map-side-combined
aggregate, then joined by key; Spark picks broadcast or shuffle from its bytes.
Chained updates join on the same key, so the user table is shuffled at most
once for all three.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlab.functions.blocks import USER

# Fixed column names of the uploads (CSV headers as exported by the source systems).
RG_UPLOAD_ID = "User ID"
STATUS_UPLOAD_ID, STATUS_UPLOAD_VALUE = "User ID", "User Status"
OPT_OUT_RENAMES = {"user_id": USER, "message_status": "receive_message", "mail_status": "receive_mail",
                   "sms_status": "receive_sms"}
OPT_OUT_COLUMNS = ("receive_mail", "receive_message", "receive_sms")


def unique_updates(updates: DataFrame, key: str, columns: Sequence[str], on_conflict: str = "error") -> DataFrame:
    """One row per non-null key. Equal duplicates collapse; a key with
    different values fails the job (JVM-side ``raise_error``, no collect), or
    takes the largest values with ``on_conflict="max"``."""
    if on_conflict not in ("error", "max"):
        raise ValueError(f"on_conflict: {on_conflict}")
    vals = F.struct(*[F.col(c) for c in columns])
    g = updates.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(vals).alias("_low"), F.max(vals).alias("_v"))
    checked = F.col("_v") if on_conflict == "max" else F.when(F.col("_low") == F.col("_v"), F.col("_v")).otherwise(
        F.raise_error(F.concat(F.lit("conflicting updates for key "), F.col(key).cast("string"))))
    return g.select(key, checked.alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in columns])


def keyed_update(target: DataFrame, updates: DataFrame, columns: Sequence[str], key: str = USER,
                 dedupe: bool = True, on_conflict: str = "error") -> DataFrame:
    """U4: overwrite ``columns`` of ``target`` rows whose ``key`` appears in
    ``updates``. Unmatched rows and all other columns are unchanged, row count
    and column order are kept; keys absent from ``target`` are ignored; a
    matched null overwrites (D25)."""
    columns = list(columns)
    upd = unique_updates(updates, key, columns, on_conflict) if dedupe else updates.select(key, *columns)
    upd = upd.select(F.col(key).alias("_key"), F.lit(True).alias("_matched"),
                     *[F.col(c).alias(f"_new_{c}") for c in columns])
    j = target.join(upd, target[key] == F.col("_key"), "left")
    out = []
    for f in target.schema.fields:
        if f.name in columns:
            out.append(F.when(F.col("_matched"), F.col(f"_new_{f.name}")).otherwise(target[f.name])
                       .cast(f.dataType).alias(f.name))
        else:
            out.append(target[f.name])
    return j.select(*out)


def _ids(upload: DataFrame, column: str) -> DataFrame:
    return upload.select(F.trim(F.col(column).cast("string")).alias(USER))


def apply_rg_limit(users: DataFrame, upload: DataFrame, id_column: str = RG_UPLOAD_ID) -> DataFrame:
    """Uploaded ids get ``RG_limit = 1``; never reset to 0."""
    upd = _ids(upload, id_column).withColumn("RG_limit", F.lit(1))
    return keyed_update(users, upd, ["RG_limit"])


def upload_time(df: DataFrame, column: str) -> "F.Column":
    """The column as a timestamp. Text must be ISO or month/day/year with an
    optional time; any other text fails instead of being compared as text."""
    c = F.col(column)
    if not isinstance(df.schema[column].dataType, T.StringType):
        return c.cast("timestamp")
    text = F.nullif(F.trim(c), F.lit(""))
    parsed = F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("M/d/yyyy[ H:mm[:ss]]")))
    return F.when(text.isNull() | parsed.isNotNull(), parsed).otherwise(
        F.raise_error(F.concat(F.lit("not a time: "), c)))


def apply_opt_out(users: DataFrame, upload: DataFrame) -> DataFrame:
    """Overwrite the three contact flags of uploaded ids. Duplicate ids:
    the row with the latest ``updated_time`` wins (D24); a tie on time (or an
    upload without that column) keeps the larger flags (deterministic)."""
    up = upload
    for old, new in OPT_OUT_RENAMES.items():
        up = up.withColumnRenamed(old, new)
    up = up.withColumn(USER, F.trim(F.col(USER).cast("string")))
    if "updated_time" not in up.columns:  # no time: duplicates resolve to the larger flags
        up = up.withColumn("updated_time", F.lit(None).cast("timestamp"))
    up = up.withColumns({"updated_time": upload_time(up, "updated_time"),
                         **{c: F.col(c).cast("int") for c in OPT_OUT_COLUMNS}})
    latest = up.filter(F.col(USER).isNotNull()).groupBy(USER).agg(
        F.max(F.struct("updated_time", *OPT_OUT_COLUMNS)).alias("_r"))
    latest = latest.select(USER, *[F.col(f"_r.{c}").alias(c) for c in OPT_OUT_COLUMNS])
    return keyed_update(users, latest, OPT_OUT_COLUMNS, dedupe=False)


def apply_user_status(users: DataFrame, upload: DataFrame, id_column: str = STATUS_UPLOAD_ID,
                      status_column: str = STATUS_UPLOAD_VALUE, on_conflict: str = "error") -> DataFrame:
    """Overwrite ``user_status`` of uploaded ids; equal duplicate rows
    collapse, conflicting ones fail or take the largest (D24)."""
    upd = upload.select(F.trim(F.col(id_column).cast("string")).alias(USER),
                        F.col(status_column).alias("user_status"))
    return keyed_update(users, upd, ["user_status"], on_conflict=on_conflict)


def update_status(users: DataFrame, rg_limit: DataFrame, opt_out: DataFrame, user_status: DataFrame,
                  rg_id_column: str = RG_UPLOAD_ID, status_id_column: str = STATUS_UPLOAD_ID,
                  status_column: str = STATUS_UPLOAD_VALUE, on_conflict: str = "error") -> DataFrame:
    """The three updates in the reference order (RG limit, opt-out,
    status) as one snapshot transform; ``on_conflict`` as in U3."""
    out = apply_rg_limit(users, rg_limit, rg_id_column)
    out = apply_opt_out(out, opt_out)
    return apply_user_status(out, user_status, status_id_column, status_column, on_conflict)
