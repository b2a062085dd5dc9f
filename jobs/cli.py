"""What the command lines share: arguments over a config file, logging, and the session."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession


def config(path: str) -> dict:
    """The settings of a config file beside the jobs, or anywhere."""
    with open(path if os.path.exists(path) else os.path.join(os.path.dirname(os.path.abspath(__file__)), path)) as f:
        return json.load(f)


def main(name: str, run: Callable[[SparkSession, dict], dict], args: list[str] | None = None) -> None:
    """``run`` with a session of its own and the settings of the config file, over which arguments go."""
    parser = argparse.ArgumentParser(name, description=(run.__doc__ or "").split("\n")[0])
    parser.add_argument("--config", default=f"{name}.json", help="a JSON file of settings")
    parser.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="a setting of the config file to put another value for")
    for option in ("input", "output"):
        parser.add_argument(f"--{option}", help=f"the {option} folder, in any file system that Spark reads")
    given = parser.parse_args(args)
    settings = config(given.config)
    settings |= {k: json.loads(v) if v[:1] in '[{"0123456789' or v in ("true", "false", "null") else v for k, _, v in (x.partition("=") for x in given.set)}
    settings |= {k: getattr(given, k) for k in ("input", "output") if getattr(given, k)}
    if missing := [k for k in ("input", "output") if not settings.get(k)]:
        parser.error(f"no {' and no '.join(missing)}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        logging.getLogger(name).info("done: %s", json.dumps(run(spark, settings)))
    finally:
        spark.stop()
