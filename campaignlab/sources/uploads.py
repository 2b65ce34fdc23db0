"""CSV uploads (I1), with a quarantine for bad lines, and audience exports (I4)."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlab.functions.numbering import numbered
from campaignlab.session import ensure_checkpoint_dir


def read_upload(spark: SparkSession, path: str, columns: Mapping[str, T.DataType | str] | None = None,
                multi_line: bool = False) -> DataFrame:
    """Read an uploaded CSV with a header row.

    Every column is read as text (no schema inference, so ids keep leading
    zeros, D14) and then cast to the requested types; a requested column that
    is missing raises. ``multi_line`` allows quoted line breaks inside values
    (the file is then read whole by one task, fine for uploads)."""
    df = (spark.read.option("header", True).option("inferSchema", False)
          .option("multiLine", multi_line).option("escape", '"').csv(path))
    if columns is None:
        return df
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"upload {path}: missing columns {missing}")
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])


@dataclass(frozen=True)
class CheckedUpload:
    """``good``: rows of the requested types. ``rejected``: (line, reason). Counts of both."""

    good: DataFrame
    rejected: DataFrame
    n_good: int
    n_rejected: int


def read_upload_checked(spark: SparkSession, path: str, columns: Mapping[str, T.DataType | str],
                        required: Sequence[str] = ()) -> CheckedUpload:
    """I1 with a quarantine: every line of an uploaded CSV (header row) is a good row or a
    rejected line with its reason; none is lost or turned into nulls.

    Rejected are lines with more or fewer fields than the header or broken quotes,
    values that are not of the requested type, and lines without a value in a
    ``required`` column. An empty value is null. The file is parsed once: both kinds
    are written to the shared checkpoint folder in one job, which counts them as it
    writes. A requested column missing from the header raises."""
    reader = lambda: spark.read.option("header", True).option("escape", '"')
    header = reader().option("inferSchema", False).csv(path).columns
    missing = [c for c in columns if c not in header]
    if missing:
        raise ValueError(f"upload {path}: missing columns {missing}")
    bad = "_line"
    while bad in header:
        bad += "_"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header] + [T.StructField(bad, T.StringType())])
    raw = reader().schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad) \
        .option("enforceSchema", True).csv(path)
    quoted = {c: F.col(f"`{c}`") for c in header}
    typed = {c: quoted[c].try_cast(t) for c, t in columns.items()}
    reasons = [F.when(quoted[c].isNotNull() & typed[c].isNull(),
                      F.lit(f"{c}: not a {_type_name(t)}")) for c, t in columns.items()]
    reasons += [F.when(F.trim(F.coalesce(quoted[c], F.lit(""))) == "", F.lit(f"{c}: no value")) for c in required]
    reason = F.when(F.col(bad).isNotNull(), F.lit("malformed line")).otherwise(
        F.nullif(F.concat_ws("; ", *reasons), F.lit("")))
    line = F.coalesce(F.col(bad), F.concat_ws(",", *[F.coalesce(quoted[c], F.lit("")) for c in header]))
    rows = raw.select(F.struct(*[typed[c].alias(c) for c in columns]).alias("row"), line.alias("line"), reason.alias("reason"))
    rows = rows.select(F.when(F.col("reason").isNull(), F.col("row")).alias("row"),
                       F.when(F.col("reason").isNotNull(), F.col("line")).alias("line"), "reason")
    counts = Observation()
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/upload-{uuid.uuid4()}"
    rows.observe(counts, F.count(F.when(F.col("reason").isNull(), 1)).alias("good"),
                 F.count("reason").alias("rejected")).write.parquet(out)
    kept = spark.read.schema(rows.schema).parquet(out)
    return CheckedUpload(kept.filter(F.col("reason").isNull()).select("row.*"),
                         kept.filter(F.col("reason").isNotNull()).select("line", "reason"),
                         counts.get["good"], counts.get["rejected"])


def _type_name(t: T.DataType | str) -> str:
    return t if isinstance(t, str) else t.simpleString()


def write_audience_files(df: DataFrame, path: str, rows_per_file: int) -> int:
    """I4 as files of exactly ``rows_per_file`` rows in the order of ``df`` (the last has the rest):
    folders ``file=1``, ``file=2``, ... with one CSV each, header included. Returns their number.

    Rows get consecutive numbers without a single task; each file is written by one
    task, all files in parallel. Rows whose first column is null are left out."""
    if rows_per_file < 1:
        raise ValueError("rows_per_file must be >= 1")
    rows = numbered(df.dropna(subset=[df.columns[0]]), "_n")
    rows = rows.withColumn("file", F.floor((F.col("_n") - 1) / rows_per_file) + 1)
    files = Observation()
    (rows.repartition("file").sortWithinPartitions("file", "_n").observe(files, F.max("file").alias("files")).drop("_n")
     .write.mode("overwrite").partitionBy("file").option("header", True).option("escape", '"').csv(path))
    return files.get["files"] or 0


def write_audience_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """I4: write an audience as CSV with a header, overwriting ``path``.

    Rows whose first column is null are left out (the reference drops the
    lines that start with a comma; an empty string is kept, D22). By default
    every task writes its own part file in parallel. ``single_file`` gives one
    downloadable part, written by one task that streams the rows: ask for it
    only where one download is the point."""
    out = df.dropna(subset=[df.columns[0]])
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
