"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import logging
import tomllib
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def settings(kind: type, path: str | None, name: str) -> Any:
    """kind's fields from a TOML file on the driver's machine (the one beside the jobs, if none is named). Unknown keys and wrong types raise."""
    values = tomllib.loads(Path(path or Path(__file__).with_name(f"{name}.toml")).read_text())
    fields = kind.__dataclass_fields__
    if unknown := set(values) - set(fields):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    for key, value in values.items():
        wanted = type(fields[key].default)
        if wanted is float and isinstance(value, int):
            values[key] = float(value)
        elif not isinstance(value, wanted):
            raise ValueError(f"{key} must be {wanted.__name__}")
    return kind(**values)


def counted(df: DataFrame, **sums: str) -> tuple[DataFrame, Observation]:
    """df, and what an action over it will have seen: its rows, and sums by name of SQL expressions."""
    seen = Observation()
    return df.observe(seen, F.count("*").alias("rows"), *(F.coalesce(F.sum(F.expr(e)), F.lit(0)).alias(n) for n, e in sums.items())), seen


def command(description: str, paths: dict[str, str], options: Callable[[argparse.ArgumentParser], None], work: Callable[[SparkSession, argparse.Namespace], None]) -> None:
    """Reads the arguments, makes a session, does the work, stops the session. Spark's settings come from spark-submit or the environment."""
    parser = argparse.ArgumentParser(description=description)
    for name, text in paths.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", help="a TOML file; the one beside the job, if none is named")
    options(parser)
    chosen = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(description).getOrCreate()
    try:
        work(spark, chosen)
    finally:
        spark.stop()
