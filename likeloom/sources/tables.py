"""Sources and sinks of tables, behind two small protocols."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates
from ..operators.interactions import tab_separated
from ..params import CandidateParams
from ..schema import EXPORT, SPECIAL, SPECIAL_LISTS


class CandidateSource(Protocol):
    def candidates(self, now: int) -> DataFrame:
        """(algo_id, uri, …) of all feeds."""


class InteractionWriter(Protocol):
    def write(self, rows: DataFrame, actions: DataFrame) -> None: ...


class TableSource:
    """Candidates from the source table and the moderation table, in any format that Spark reads (parquet, JDBC…)."""

    def __init__(self, source: DataFrame, hidden: DataFrame, params: CandidateParams = CandidateParams()):
        self.source, self.hidden, self.params = source, hidden, params

    def candidates(self, now: int) -> DataFrame:
        return candidates.candidates_widened(self.source, self.hidden, now, self.params)


class ExportSource:
    """Candidates from exported responses {algo_id, uris: [...]} as JSON lines."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def candidates(self, now: int) -> DataFrame:
        return self.spark.read.schema(EXPORT).json(self.path).select("algo_id", F.explode("uris").alias("uri")).distinct()


class NoSource:
    """A feed that only administrators fill."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def candidates(self, now: int) -> DataFrame:
        return self.spark.createDataFrame([], "algo_id int, uri string")


class ParquetWriter:
    """Interactions and actions appended as Parquet. Restarted micro-batches may append twice: at least once."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows: DataFrame, actions: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/interactions")
        actions.write.mode("append").parquet(f"{self.folder}/actions")


class TextWriter:
    """The same as tab-separated text."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows: DataFrame, actions: DataFrame) -> None:
        tab_separated(rows, *rows.columns).write.mode("append").text(f"{self.folder}/interactions")
        tab_separated(actions, *actions.columns).write.mode("append").text(f"{self.folder}/actions")


class NoWriter:
    def write(self, rows: DataFrame, actions: DataFrame) -> None:
        rows.write.format("noop").mode("overwrite").save()
        actions.write.format("noop").mode("overwrite").save()


def swap(df: DataFrame, path: str, key: str = "algo_id", as_of: int | None = None) -> None:
    """Puts df in place of what a table has for df's keys; other keys stay. With as_of, rows say when they were made."""
    stamped = df if as_of is None else df.withColumn("as_of", F.lit(as_of))
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def special_posts(spark: SparkSession, path: str) -> DataFrame:
    """Special posts' configs as JSON lines; the saturation is 20 where it isn't given, lists empty."""
    rows = spark.read.schema(SPECIAL).json(path)
    lists = {n: F.coalesce(n, F.array().cast(kind)) for n, kind in SPECIAL_LISTS.items()}
    return rows.withColumns({"sponsorship_saturation_rate": F.coalesce("sponsorship_saturation_rate", F.lit(20)), **lists})


def log(df: DataFrame, path: str) -> None:
    """Rows appended as JSON lines: requests and renders."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)
