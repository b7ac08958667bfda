"""python -m orbisplit {batch FILE | run FOLDER --output DIR | report DIR --type KIND | stats DIR}"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from orbisplit.config import Batch, batch_from_yaml
from orbisplit.plans import summary
from orbisplit.plans.engine import log_to, run_batch
from orbisplit.sources.state import State
from orbisplit.sources.tables import drop_work


def parsed(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="orbisplit")
    kinds = parser.add_subparsers(dest="what", required=True)
    batch = kinds.add_parser("batch", help="ingest the folders of a file, then write its reports")
    batch.add_argument("path")
    batch.add_argument("--skip-ingest", action="store_true")
    batch.add_argument("--skip-reports", action="store_true")
    run = kinds.add_parser("run", help="ingest folders")
    run.add_argument("path", nargs="+")
    run.add_argument("--output", required=True)
    run.add_argument("--config")
    report = kinds.add_parser("report", help="write a report of a state folder")
    report.add_argument("path")
    report.add_argument("--type", default="stats", choices=sorted(summary.REPORTS))
    report.add_argument("--save")
    stats = kinds.add_parser("stats", help="print the figures of a state folder")
    stats.add_argument("path")
    for p in (batch, run):
        p.add_argument("--log", help="a log file of the driver")
    return parser.parse_args(argv)


def main(argv: list[str]) -> int:
    given = parsed(argv)
    spark = SparkSession.builder.appName("orbisplit").getOrCreate()
    if given.what in ("batch", "run"):
        batch = batch_from_yaml(given.path) if given.what == "batch" else Batch(tuple(given.path), given.output, given.config)
        if given.what == "batch" and (given.skip_ingest or given.skip_reports):
            batch = Batch(() if given.skip_ingest else batch.folders, batch.output_dir, batch.config, () if given.skip_reports else batch.reports)
        if given.log:
            log_to(given.log, batch.settings())
        failed = run_batch(spark, batch)
        drop_work(spark)
        return int(bool(failed))
    state = State(spark, given.path)
    state.require_dataset()
    if given.what == "stats":
        for row in summary.stats_text(state).collect():  # a line a figure
            print(row.value)
    else:
        print(summary.write(state, {"type": given.type, "save": given.save or given.type}))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
