"""A folder for catalogs that a query makes for itself, on storage that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def workspace(spark: SparkSession) -> str:
    """A new folder under the one that spark.checkpoint.dir names; where that is unset, a temporary one on a single machine and an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared.rstrip('/')}/tidemark-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="tidemark-")
