"""Tables that change as a whole: versioned folders behind pointers that are written last.

A version is written to folders of its own.  Then one small file, the pointer, is added, which
names them; a file appears whole or not at all.  Readers follow the newest pointer, so they see all
tables of a version or none of them, whenever a writer stops.  A replayed batch writes a new version
under its number, which takes the place of the one before.  Folders that no pointer names, or only
an older one, are what ``forget`` removes.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER_SCHEMA = "generation long, number long, made long, name string, folder string"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _entries(spark: SparkSession, path: str) -> list:
    if not _exists(spark, f"{path}/pointers"):
        return []
    return spark.read.schema(POINTER_SCHEMA).json(f"{path}/pointers").select("*", "_metadata.file_path").collect()


def pointers(spark: SparkSession, path: str) -> list:
    """The newest entry of each number and table of the latest generation, by number.

    There is one for each batch since the last ``forget``, and a few tables in each.
    """
    rows = _entries(spark, path)
    latest = max((r.generation for r in rows), default=0)
    newest: dict[tuple, tuple] = {}
    for r in rows:
        key = (r.number, r.name)
        if r.generation == latest and (key not in newest or newest[key].made < r.made):
            newest[key] = r
    return [newest[key] for key in sorted(newest)]


def _point(spark: SparkSession, path: str, entries: list[tuple]) -> None:
    """Adds one pointer file; this is the step that makes a version the current one."""
    spark.createDataFrame(entries, POINTER_SCHEMA).coalesce(1).write.mode("append").json(f"{path}/pointers")


def commit(spark: SparkSession, path: str, number: int, tables: Mapping[str, object], fresh: bool = False) -> None:
    """Writes a version of some tables, each a DataFrame or a function of the paths written so far.

    With ``fresh`` it begins a new generation: nothing written before is read any more.
    """
    known = pointers(spark, path)
    generation = max((r.generation for r in known), default=0) + fresh
    stamp, folders = time.time_ns(), {}
    for name, made in tables.items():
        df = made if isinstance(made, DataFrame) else made(folders)
        folders[name] = f"{path}/{name}/{generation}-{number}-{uuid.uuid4().hex}"
        df.write.parquet(folders[name])
    _point(spark, path, [(generation, number, stamp, name, folder) for name, folder in folders.items()])


def folders_of(spark: SparkSession, path: str, name: str, below: int | None = None) -> list[str]:
    """Folders of a table's versions, one for each number, the newest last."""
    return [r.folder for r in pointers(spark, path) if r.name == name and (below is None or r.number < below)]


def read_current(spark: SparkSession, path: str, name: str, schema: str, below: int | None = None) -> DataFrame:
    """The table's newest version; empty where there is none."""
    found = folders_of(spark, path, name, below)
    return spark.read.schema(schema).parquet(found[-1]) if found else spark.createDataFrame([], schema)


def read_all(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The rows of all numbers, each in its newest version; for tables that batches add to."""
    found = folders_of(spark, path, name)
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def forget(spark: SparkSession, path: str, name: str, keep: int = 2) -> None:
    """Removes what is not among a table's ``keep`` newest versions, folders and pointers, once no reader needs it.

    For tables that are replaced as a whole; those that batches add to keep all their versions.
    """
    kept = set(folders_of(spark, path, name)[-keep:])
    files: dict[str, list] = {}
    for r in _entries(spark, path):
        files.setdefault(r.file_path, []).append(r)
    gone = [file for file, rows in files.items() if all(r.name == name and r.folder not in kept for r in rows)]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    system = top.getFileSystem(conf)
    # Pointers first: a pointer never names a folder that is not there.
    for file in gone:
        system.delete(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)), False)
    names = {folder.rsplit("/", 1)[1] for folder in kept}
    for found in system.listStatus(top) if system.exists(top) else []:
        if found.getPath().getName() not in names:
            system.delete(found.getPath(), True)
