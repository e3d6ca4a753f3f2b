"""Helpers that the corpus operators share: durable cuts of lineage, row keys, word columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FALLBACK: dict[str, str] = {}

#: Up to so many bytes of a counted table are broadcast; beyond it tables are joined by shuffling.
BROADCAST_BYTES = 32 << 20

#: A to Z and a to z, for lower-casing that leaves every other letter alone.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application in the one that spark.checkpoint.dir names. Where that is unset: a temporary one in local
    mode, where all tasks see it, and an error on a cluster."""
    conf, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if conf:
        return f"{conf.rstrip('/')}/llm-{app}"
    if not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
    return _FALLBACK[app]


def clear(spark: SparkSession) -> None:
    """Delete all that this application's operators have written between their steps. Their results read these tables: call it
    when they have been written elsewhere."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(shared_dir(spark))
    if store.get_file_info(path).type == fs.FileType.Directory:
        store.delete_dir_contents(path)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs a re-read."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _has_map(kind.elementType))


def row_key(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes over all columns (those with maps in them as JSON): equal for repeated rows, apart for all others. As the
    hash passes over nulls, which columns are null is hashed as well."""
    named = [(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    cols = [F.to_json(F.struct(c.alias("c"))) if _has_map(kind) else c for c, kind in named]
    nulls = F.concat(F.lit(""), *(c.isNull().cast("string") for c, _ in named))
    return [F.xxhash64(F.lit(1), nulls, *cols).alias("__k1"), F.xxhash64(F.lit(2), nulls, *cols, F.lit(3)).alias("__k2")]


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns c0, c1, ..., and these by the names they had: other columns can then be added under any name."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names
