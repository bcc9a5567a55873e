"""Parsing only what is new: a store of parsed rows by file, hash of its content and version of the parser.

A run hashes the files of a folder, parses those whose path, hash and version the store doesn't hold, appends their rows and then
a note of each file, and returns the rows of the files that are there now. Files that were changed are parsed anew; those that
are gone, or come back, cost nothing. A run that broke off before its notes were written is repeated: the rows without a
note are not read, as each run's rows carry its own mark. A damaged file gives one row of error, and is not parsed again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import write_shared
from quillspark.sources.readers import SCHEMA, parsed

KEYS = ("path", "sha256", "version")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def refresh(spark: SparkSession, folder: str, store: str, version: str = "1") -> tuple[DataFrame, int]:
    """The rows of all files of a folder, and how many files were parsed for them. store: a folder that only this function writes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    now = write_shared(files.select("path", F.sha2("content", 256).alias("sha256"), F.lit(version).alias("version")), "file-hashes")
    notes, rows = f"{store}/files", f"{store}/rows"
    known = spark.read.parquet(notes).select(*KEYS) if _exists(spark, notes) else now.limit(0)
    fresh = now.join(known, list(KEYS), "left_anti")
    run = uuid.uuid4().hex
    count = fresh.count()
    if count:
        own = files.join(fresh.select("path"), "path", "left_semi")
        hashes = fresh.select("path", "sha256", "version")
        parsed(own).join(hashes, "path").withColumn("run", F.lit(run)).write.mode("append").parquet(rows)
        hashes.withColumn("run", F.lit(run)).write.mode("append").parquet(notes)
    if not _exists(spark, notes):
        return spark.createDataFrame([], SCHEMA), 0
    current = spark.read.parquet(notes).join(now, list(KEYS), "left_semi").select("path", "sha256", "run")
    return spark.read.parquet(rows).join(current, ["path", "sha256", "run"], "left_semi").select(*[c.split()[0] for c in SCHEMA.split(", ")]), count
