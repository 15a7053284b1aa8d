"""Files that land in dated folders: reading with lineage, writing drops."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.contracts import Contract, parse_lines
from tidemark.sources.files import names_in

TIMESTAMPS = "yyyy-MM-dd'T'HH:mm:ss"


def batch_date_of(path: Column) -> Column:
    """The date in a path's ``batch_date=`` folder; null where there is none or it isn't a date."""
    return F.try_to_date(F.regexp_extract(path, r"batch_date=(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")


def feed_of(path: Column) -> Column:
    """The delivering feed in a file name (``feed0001-0.json`` is feed0001); null where there is none."""
    name = F.regexp_extract(path, r"(feed\d+)", 1)
    return F.when(name != "", name)


def with_lineage(df: DataFrame, at: Column | None = None) -> DataFrame:
    """Adds file, delivery date and ingestion time to rows of a file scan. The delivery date comes from the path, never
    from the clock."""
    path = F.col("_metadata.file_path")
    return df.select("*", path.alias("_source_file"), batch_date_of(path).alias("_batch_date"), (F.current_timestamp() if at is None else at).alias("_ingested_at"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, all columns text; quoted line breaks are kept, a byte order mark is cut off the first name."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return raw.toDF(*[c.lstrip("﻿") for c in raw.columns])


def scan(spark: SparkSession, folder: str, contract: Contract, streaming: bool = False) -> DataFrame:
    """A feed's landing folder as rows with lineage, as a batch or as a file stream that takes each file once."""
    reader = spark.readStream if streaming else spark.read
    if contract.fmt == "parquet":
        return with_lineage(reader.schema(contract.schema).option("recursiveFileLookup", "true").parquet(folder))
    return parse_lines(with_lineage(reader.option("recursiveFileLookup", "true").text(folder)), contract.schema)


def next_snapshot(spark: SparkSession, folder: str, after: dt.date | None) -> dt.date | None:
    """The earliest ``batch_date`` folder later than ``after``, from the listing alone."""
    days = [dt.date.fromisoformat(n.split("=", 1)[1]) for n in names_in(spark, folder) if n.startswith("batch_date=")]
    return min((d for d in days if after is None or d > after), default=None)


def drop(df: DataFrame, folder: str, day: dt.date, fmt: str = "json", files: int = 1, seed: int | None = None, mode: str = "append") -> None:
    """Writes one delivery of a feed: ``files`` files in the day's folder, rows shuffled by ``seed`` if given; ``mode`` overwrite
    replaces what lies there."""
    rows = df.orderBy(F.rand(seed)) if seed is not None else df
    writer = rows.coalesce(files).write.mode(mode)
    path = f"{folder}/batch_date={day.isoformat()}"
    writer.parquet(path) if fmt == "parquet" else writer.option("timestampFormat", TIMESTAMPS).option("timestampNTZFormat", TIMESTAMPS).json(path)


def calendar(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """One row a day, both ends included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("INTERVAL 1 DAY"))).alias("date"))
