"""Small files that tasks leave for other tasks, and tables that cut lineage, in the folder that all machines share."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from sgspark.session import checkpointed


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path; nothing is made yet."""
    return f"{checkpointed(spark).rstrip('/')}/work/{name}-{uuid.uuid4().hex}"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


def save(path: str, data: bytes) -> None:
    """A whole file or none, whichever attempt of a task comes last."""
    system, at = _opened(path)
    system.create_dir(at.rpartition("/")[0])
    part = f"{at}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, at)


def load(path: str) -> bytes:
    system, at = _opened(path)
    with system.open_input_stream(at) as source:
        return source.read()


def kept(df: DataFrame, path: str) -> DataFrame:
    """df as a Parquet table at path."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
