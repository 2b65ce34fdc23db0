"""Command line: ``python -m campaignlab <command> ...`` (or via spark-submit).

Commands
  extract        one audience by operator name, exported as CSV
  activity       campaign report for an uploaded audience, one folder per section
  campaigns      the sections of many campaigns (a CSV of windows, a CSV of audiences) in one pass
  update-status  apply the three status uploads, write the new user snapshot
  save-snapshot  store the users in folders by id, so that updates rewrite only what they touch
  update-snapshot  apply status uploads to such a stored snapshot, in place
  derive-tables  derive the campaign tables from a test-data folder and store them
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from campaignlab.session import BASE_CONF


def _session() -> SparkSession:
    b = SparkSession.builder.appName("campaignlab")
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    return b.getOrCreate()


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="campaignlab", description=__doc__,
                                formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="cmd", required=True)
    e = sub.add_parser("extract")
    e.add_argument("--tables", required=True)
    e.add_argument("--operator", required=True)
    e.add_argument("--filters", default="{}", help="JSON object with the filter keys")
    e.add_argument("--as-of")
    e.add_argument("--out", required=True)
    how = e.add_mutually_exclusive_group()
    how.add_argument("--single-file", action="store_true")
    how.add_argument("--rows-per-file", type=int, help="files of exactly so many rows, in the audience's order")
    a = sub.add_parser("activity")
    a.add_argument("--tables", required=True)
    a.add_argument("--audience", required=True, help="CSV with a User_ID header")
    a.add_argument("--start", required=True)
    a.add_argument("--end", required=True)
    a.add_argument("--title", default="")
    a.add_argument("--out", required=True)
    c = sub.add_parser("campaigns")
    c.add_argument("--tables", required=True)
    c.add_argument("--campaigns", required=True, help="CSV: campaign, start, end")
    c.add_argument("--audiences", required=True, help="CSV: campaign, User_ID")
    c.add_argument("--out", required=True)
    sv = sub.add_parser("save-snapshot")
    sv.add_argument("--tables", required=True)
    sv.add_argument("--snapshot", required=True)
    sv.add_argument("--parts", type=int, default=64)
    us = sub.add_parser("update-snapshot")
    us.add_argument("--snapshot", required=True)
    for name in ("--rg-limit", "--opt-out", "--user-status"):
        us.add_argument(name)
    us.add_argument("--on-conflict", choices=("error", "max"), default="error")
    u = sub.add_parser("update-status")
    u.add_argument("--tables", required=True)
    u.add_argument("--rg-limit", required=True)
    u.add_argument("--opt-out", required=True)
    u.add_argument("--user-status", required=True)
    u.add_argument("--on-conflict", choices=("error", "max"), default="error",
                   help="user ids uploaded with different statuses: fail, or take the largest text")
    u.add_argument("--out", required=True)
    d = sub.add_parser("derive-tables")
    d.add_argument("--sf-dir", required=True)
    d.add_argument("--out", required=True)
    args = p.parse_args(argv)

    spark = _session()
    from campaignlab.operators import activity as X
    from campaignlab.plans.extract import export_audience, extract_data, run_update_user_status
    from campaignlab.sources.tables import load_tables, save_tables
    from campaignlab.sources.uploads import read_upload, write_audience_files

    if args.cmd == "extract" and args.rows_per_file:
        t = load_tables(spark, args.tables)
        n = write_audience_files(extract_data(t, args.operator, json.loads(args.filters), args.as_of), args.out,
                                 args.rows_per_file)
        print(f"Extracted {n} files to {args.out}")
    elif args.cmd == "campaigns":
        from campaignlab.operators.campaigns import CampaignSet
        many = CampaignSet(load_tables(spark, args.tables), read_upload(spark, args.campaigns), read_upload(spark, args.audiences))
        for name, section in many.report().items():
            section.write.mode("overwrite").option("header", True).csv(f"{args.out.rstrip('/')}/{name}")
        print(f"sections of all campaigns written to {args.out}")
    elif args.cmd == "save-snapshot":
        from campaignlab.sources.snapshots import save_snapshot
        save_snapshot(load_tables(spark, args.tables).users, args.snapshot, args.parts)
        print(f"user snapshot in {args.parts} folders written to {args.snapshot}")
    elif args.cmd == "update-snapshot":
        from campaignlab.sources.snapshots import update_snapshot
        uploads = {k: read_upload(spark, p) for k, p in (("rg_limit", args.rg_limit), ("opt_out", args.opt_out),
                                                         ("user_status", args.user_status)) if p}
        print(f"rewrote {len(update_snapshot(spark, args.snapshot, **uploads, on_conflict=args.on_conflict))} folders of {args.snapshot}")
    elif args.cmd == "extract":
        t = load_tables(spark, args.tables)
        n = export_audience(extract_data(t, args.operator, json.loads(args.filters), args.as_of), args.out,
                            single_file=args.single_file)
        print(f"Extracted {n} users to {args.out}")
    elif args.cmd == "activity":
        t = load_tables(spark, args.tables)
        rep = X.campaign_report(t, X.load_audience(spark, args.audience), args.start, args.end, args.title)
        X.write_report(rep, args.out)
        print(("No activity in the window; " if rep["empty"] else "") + f"report written to {args.out}")
    elif args.cmd == "update-status":
        if args.out.rstrip("/") == f"{args.tables.rstrip('/')}/dim_user_authentication":
            raise SystemExit("write the new snapshot to another folder, then swap it in")
        t = load_tables(spark, args.tables)
        out = run_update_user_status(t.users, read_upload(spark, args.rg_limit), read_upload(spark, args.opt_out),
                                     read_upload(spark, args.user_status), args.on_conflict)
        out.write.mode("overwrite").parquet(args.out)
        print(f"user snapshot written to {args.out}")
    elif args.cmd == "derive-tables":
        from campaignlab.sources.fixtures import TestData
        save_tables(TestData(spark, args.sf_dir).campaign, args.out)
        print(f"tables written to {args.out}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
