"""Command line: build the warehouse and show reports.

    python -m tierline --testdata /root/testdata/sf0.01 --report kpi_cost_by_state
    python -m tierline --raw inpatient_charges:2015=/data/inp15 \\
        --raw inpatient_charges:2014=/data/inp14 --raw outpatient_charges:2015=/data/out15 \\
        --raw physicians_and_other_supplier:2014=/data/phys14 --out /shared/wh --report all

Without ``--out`` nothing is stored and each report is computed from the raw
tables; with it the 12 models are written first (full refresh) and the
reports read the stored tables.
"""

from __future__ import annotations

import argparse
from collections import defaultdict

from tierline.plans.build import materialise
from tierline.plans.warehouse import Params, Warehouse
from tierline.queries import MODEL_QUERIES, testdata_warehouse
from tierline.session import build_session, partitions_for
from tierline.sources.readers import read_raw_sources


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="python -m tierline")
    src = ap.add_mutually_exclusive_group()
    src.add_argument("--testdata", help="folder of the driver's parquet tables (adapter mapping)")
    src.add_argument("--raw", action="append", metavar="SOURCE:YEAR=PATH", help="raw table location")
    ap.add_argument("--out", help="folder to store the models in (full refresh)")
    ap.add_argument("--report", action="append", default=[], help="report name, or 'all', or 'list'")
    ap.add_argument("--rows", type=int, default=50, help="rows to print per report")
    ap.add_argument("--input-bytes", type=int, help="size of the raw input; sizes the shuffle partitions")
    ap.add_argument("--current-year", type=int, default=2015)
    ap.add_argument("--previous-year", type=int, default=2014)
    args = ap.parse_args(argv)

    if "list" in args.report:
        print("\n".join(MODEL_QUERIES))
        return
    if not (args.testdata or args.raw):
        ap.error("one of --testdata or --raw is required")
    parts = partitions_for(args.input_bytes) if args.input_bytes else None
    spark = build_session(app_name="tierline-cli", shuffle_partitions=parts)
    if args.testdata:
        wh = testdata_warehouse(spark, args.testdata)
    else:
        locations: dict[str, dict[int, str]] = defaultdict(dict)
        for item in args.raw:
            key, path = item.split("=", 1)
            source, year = key.split(":")
            locations[source][int(year)] = path
        wh = Warehouse(spark, read_raw_sources(spark, locations), Params(args.current_year, args.previous_year))
    if args.out:
        wh = materialise(wh, args.out)
    names = list(MODEL_QUERIES) if "all" in args.report else args.report
    for name in names:
        print(f"== {name}")
        MODEL_QUERIES[name](wh).show(args.rows, truncate=False)


if __name__ == "__main__":
    main()
