"""Where named entries lie: a base folder from the session's settings, and nothing outside it."""

from __future__ import annotations

import posixpath

from pyspark.sql import SparkSession

SETTING = "spark.meshlake.workspace"


def entry(spark: SparkSession, name: str, parent: str = "") -> str:
    """The path of an entry below the workspace. Raises ValueError for names that lead out of it or if none is set, and
    FileNotFoundError for what isn't there."""
    base = spark.conf.get(SETTING, None)
    if not base:
        raise ValueError(f"{SETTING} isn't set")
    inside = posixpath.normpath(posixpath.join("/", parent, name))
    if name.startswith("/") or ".." in posixpath.join(parent, name).split("/"):
        raise ValueError(f"{name}: outside the workspace")
    path = f"{base.rstrip('/')}{inside}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        raise FileNotFoundError(path)
    return path
