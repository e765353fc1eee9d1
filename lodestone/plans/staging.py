"""Tables in the folder that driver and executors share: they cut a plan and outlive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; unset is allowed for a local master only, which gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path and the place there: plain paths, URIs that Arrow knows, and Hadoop's names for S3 (``s3a``, ``s3n``)."""
    uri = re.sub(r"^s3[an]:", "s3:", path)
    uri = uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else f"file://{uri}"
    return pafs.FileSystem.from_uri(uri)


def open_file(path: str):
    store, at = located(path)
    return store.open_input_file(at)


def create_file(path: str):
    store, at = located(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(at, compression=None)
