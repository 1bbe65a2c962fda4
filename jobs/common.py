"""What the jobs share: configuration, logging, the command line's session, settings that are put back."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Settings of a session that library calls change.
CHANGED = ("spark.sql.unionOutputPartitioning",)


def read_config(spark: SparkSession, path: str | None, known: dict) -> dict:
    """``known`` with what a JSON file says instead; a key that isn't known is refused."""
    if path is None:
        return dict(known)
    given = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    odd = set(given) - set(known)
    if odd:
        raise ValueError(f"{path} has unknown keys: {', '.join(sorted(odd))}")
    return known | given


@contextmanager
def settings_kept(spark: SparkSession, names: Sequence[str] = CHANGED) -> Iterator[None]:
    """Whatever is set inside, the session's settings are afterwards what they were."""
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def command_line(about: str, paths: dict[str, str], run, argv: Sequence[str] | None = None) -> None:
    """Parse the paths, make a session, run the job in it and stop it."""
    parser = argparse.ArgumentParser(description=about)
    for name, text in paths.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", help="JSON file with the job's settings; the defaults are beside the job")
    given = parser.parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(about).getOrCreate()
    try:
        run(spark, *(getattr(given, name) for name in paths), config=given.config)
    finally:
        spark.stop()
