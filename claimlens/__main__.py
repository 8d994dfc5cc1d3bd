"""python -m claimlens: scan files for package names that a registry snapshot does not hold.

The exit status is 0 for a finished scan, whatever it found, and 1 for bad
options or inputs. No connection is opened: the registry and remote bodies are
tables that Spark reads.
"""

from __future__ import annotations

import argparse
import logging
import sys
import time

from pyspark import SparkConf
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens import scan
from claimlens.config import Settings
from claimlens.functions.measures import duration, settings_line
from claimlens.session import session, stage
from claimlens.sources.datasource import save_report
from claimlens.sources.sinks import print_summary

log = logging.getLogger("claimlens")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="claimlens", description=__doc__)
    p.add_argument("-u", dest="target", help="one URL or path")
    p.add_argument("-f", dest="target_file", help="a file with a target on each line")
    p.add_argument("-d", dest="directory", help="a folder to walk for .js and .ts files")
    p.add_argument("-c", dest="workers", type=int, default=25, help="local threads, where no cluster is set")
    p.add_argument("-t", dest="timeout", type=int, default=10, help="seconds for a request (kept in the settings line)")
    p.add_argument("-l", dest="max_rate", type=float, default=30.0, help="most requests a second and host, for replays")
    p.add_argument("-max-file-size", "--max-file-size", dest="max_file_kb", type=int, default=10_240, help="KB")
    p.add_argument("-no-limit", "--no-limit", dest="no_limit", action="store_true")
    p.add_argument("-proxy", "--proxy", dest="proxy")
    p.add_argument("-p", dest="proxy_file")
    p.add_argument("-o", dest="output", help="report file")
    p.add_argument("-H", dest="headers", action="append", default=[], metavar="'Key: Value'")
    p.add_argument("-v", dest="verbose", action="store_true")
    p.add_argument("-json", "--json", dest="json", action="store_true", help="write the report as JSON")
    p.add_argument("-deep-scan", "--deep-scan", dest="deep", nargs="?", const="deep_strict", choices=["deep_strict", "deep_full"])
    p.add_argument("-silent", "--silent", dest="silent", action="store_true")
    p.add_argument("--registry", required=True, help="table (Parquet) of package and status")
    p.add_argument("--fetched", help="table (Parquet) of url, status, error and body for remote targets")
    p.add_argument("--master", help="Spark master; otherwise the cluster's own setting")
    return p


#: What a scan says of itself.
LOADED, DOMAINS, WORKERS, FINISHED = "Loaded %d targets to scan.", "Scanning across %d unique domains.", "Starting scan with %d workers.", "Scan finished in %s."


def announce(spark: SparkSession, settings: Settings, targets: DataFrame) -> None:
    """The numbers of targets and of their hosts, if the first is remote, and the settings."""
    n, hosts = scan.host_count(targets).first()
    first = targets.orderBy("target_ord").limit(1).select(F.col("target").startswith("http").alias("remote")).collect()
    log.info(LOADED, n)
    if first and first[0]["remote"]:
        log.info(DOMAINS, hosts)
    on = settings.proxy is not None or settings.proxy_file is not None
    values = (int(settings.max_rate), settings.max_file_kb, settings.no_limit, settings.mode != "regex", False, len(settings.headers), 0, on)
    log.info("%s", spark.range(1).select(settings_line(*map(F.lit, values))).first()[0])
    log.info(WORKERS, settings.workers)


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    logging.basicConfig(stream=sys.stderr, level=logging.DEBUG if a.verbose else logging.INFO, format="%(asctime)s %(levelname)s %(message)s", datefmt="%H:%M:%S")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    settings = Settings(tuple([a.target] if a.target else []), a.target_file, a.directory, a.workers, a.timeout, a.max_rate, a.max_file_kb, a.no_limit, a.proxy, a.proxy_file, a.output, "json" if a.json else "text", tuple(a.headers), a.deep or "regex", a.verbose, a.silent, a.registry)
    try:
        settings.checked()
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    # spark-submit and spark-defaults.conf name the cluster's master; only without one is it this machine.
    spark = session(a.master or (None if SparkConf().contains("spark.master") else f"local[{a.workers}]"))
    try:
        began = time.monotonic()
        targets = stage(scan.all_targets(spark, settings), "targets")
        announce(spark, settings, targets)
        found = scan.findings(spark, settings, spark.read.parquet(a.registry), spark.read.parquet(a.fetched) if a.fetched else None, targets)
        found = stage(found, "findings")
        if a.output:
            try:
                save_report(found, a.output, settings.format, a.verbose, a.silent)
            except PySparkException as e:
                log.error("output file: %s", e)
        print_summary(found, a.silent, a.verbose)
        log.info(FINISHED, duration(time.monotonic() - began))
    except OSError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
