"""Files: tables with their versions, exports, tolerant lines of JSON, and an inventory of what lies in folders."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """The folder of this application below spark.checkpoint.dir; in local mode, where that is unset, a temporary one."""
    base, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not base:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return _FALLBACK.setdefault(app, "file://" + tempfile.mkdtemp(prefix="pitwright-"))
    return f"{base.rstrip('/')}/pitwright-{app}"


def scratch(spark: SparkSession) -> str:
    """A new folder in that of this application."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written between its steps. Results read them: call it when these lie elsewhere."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(_folder(spark))
    if store.get_file_info(path).type == fs.FileType.Directory:
        store.delete_dir_contents(path)


def written(df: DataFrame) -> DataFrame:
    """df from a table in the shared folder: numbers of partitions in it stay what they are when a task is run again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: About so many rows of a large table lie in a part of it.
PART_ROWS = 300_000


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df by the hash of its keys in parts of about PART_ROWS rows, where n counts its rows (or those it meets): a part doesn't grow with the
    table, as it does with a number of parts that is set for a session, or with bytes that are counted when they are compressed. What
    fills three parts at most stays as it lies."""
    if n <= 3 * PART_ROWS:
        return df
    return df.repartition(max(-(-n // PART_ROWS), df.sparkSession.sparkContext.defaultParallelism), *keys)


def put_version(df: DataFrame, path: str, version: int) -> None:
    """Write a version of a table beside those before it; what is there is never overwritten."""
    df.write.mode("error").parquet(f"{path}/version={version}")


def versions(spark: SparkSession, path: str) -> DataFrame:
    """All versions of a table, with their number in column version; a version may lack columns that others have."""
    return spark.read.option("mergeSchema", True).parquet(path)


def newest_version(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table. Which one that is stands in the folders' names; no rows are read to find it."""
    parts = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", r"/version=(\d+)/", 1).cast("int").alias("version"))
    newest = parts.agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{path}/version={newest}")


def put_csv(df: DataFrame, path: str) -> None:
    df.write.mode("error").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines that are whole objects of the schema; others are passed over."""
    return spark.read.option("mode", "DROPMALFORMED").schema(schema).json(path)


def _first_day(text: Column) -> Column:
    """The first day of this century in a text: eight digits, with or without other signs between year, month and day."""

    def tried(groups: Column) -> Column:
        at = lambda k: F.coalesce(F.get(groups, k), F.lit(""))
        digits = F.transform(groups, lambda g, k: F.when(F.length(g) >= 4, F.substring(F.concat(g, at(k + 1), at(k + 2)), 1, 8)))
        days = F.transform(digits, lambda d: F.when(d.rlike(r"^20\d{6}$"), F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)).try_cast("date")))
        return F.get(F.filter(days, lambda d: d.isNotNull()), F.lit(0))

    return F.get(F.transform(F.array(F.split(text, r"\D+")), tried), F.lit(0))


def day_in_path(path: Column) -> Column:
    """The first day in the file's name, else the first in its folder's; NULL where there is none. Digits of UUIDs are no day."""
    parts = F.split(F.regexp_replace(path, r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "-"), "/")
    return F.coalesce(_first_day(F.element_at(parts, -1)), _first_day(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")))


def inventory(spark: SparkSession, path: str, kinds: dict[str, str]) -> DataFrame:
    """(path, bytes, kind, day) of all files below a folder; kinds: name to a pattern of the file's name, the first that fits counts. The
    files' contents aren't read. A day below the folder goes before one in the folder's own path, which may hold an application's start."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lit("other")
    for k, pattern in reversed(kinds.items()):
        kind = F.when(name.rlike(pattern), k).otherwise(kind)
    store = r"^[A-Za-z][\w+.-]*:(//[^/]*)?(?=/)"
    root, bare = re.sub(store, "", path).rstrip("/") + "/", F.regexp_replace("path", store, "")
    below = F.when(bare.startswith(root), F.substring(bare, F.lit(len(root)), F.length(bare)))
    day = F.coalesce(day_in_path(below), day_in_path(F.col("path")))
    return files.select("path", F.col("length").alias("bytes"), kind.alias("kind"), day.alias("day"))
