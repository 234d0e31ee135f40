"""Command line: run the reports or refresh the bills of stored clinic tables.

  python -m wardbook reports --tables DIR --out DIR [--ci]
      R1-R6 and the KPI row, each written as JSON lines to OUT/<report>.
  python -m wardbook refresh-billing --tables DIR --changes PATH --out DIR
      Re-derive the bills of the appointments named in PATH (parquet with an
      AppointmentID column; Treatment in DIR already holds the change) and
      write the new BillingRecord to OUT/BillingRecord.
"""

from __future__ import annotations

import argparse

from wardbook.operators import billing, reports
from wardbook.session import get_spark
from wardbook.sources.json_io import write_json
from wardbook.sources.tables import load_tables, save_tables


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="python -m wardbook")
    sub = ap.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("reports")
    r.add_argument("--tables", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--ci", action="store_true", help="compare statuses ignoring case and accents")
    b = sub.add_parser("refresh-billing")
    b.add_argument("--tables", required=True)
    b.add_argument("--changes", required=True)
    b.add_argument("--out", required=True)
    args = ap.parse_args(argv)

    spark = get_spark()
    T = load_tables(spark, args.tables)
    if args.cmd == "reports":
        out = reports.all_reports(T)
        if args.ci:
            out["billing_by_status"] = reports.billing_by_status(T, ci=True)
            out["appointments_by_dept"] = reports.appointments_by_dept(T, ci=True)
        out["kpis"] = reports.kpis(T)
        for name, df in out.items():
            write_json(df, f"{args.out.rstrip('/')}/{name}")
    else:
        changed = spark.read.parquet(args.changes)
        save_tables({"BillingRecord": billing.refresh_billing(T, changed)}, args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
