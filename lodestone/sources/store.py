"""What the engine keeps: a vector index, a graph with its communities, a report. Paths may be in any store Spark knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths

INDEX = "id string, path string, start_line int, end_line int, chunk_type string, name string, language string, content string, embedding array<float>"


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _place(spark, path)
    return fs.exists(p)


def save_index(chunks: DataFrame, path: str, append: bool = False) -> None:
    chunks.write.mode("append" if append else "overwrite").parquet(path)


def staged(rows: DataFrame, path: str) -> DataFrame:
    """Rows written beside an index while it is built, so that its steps read them once made."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}.building")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path.rstrip('/')}.building")


def unstage(spark: SparkSession, path: str) -> None:
    fs, p = _place(spark, f"{path.rstrip('/')}.building")
    fs.delete(p, True)


def load_index(spark: SparkSession, path: str, schema: str = INDEX) -> DataFrame:
    """An index that isn't there is an empty one."""
    return spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def clear_index(spark: SparkSession, path: str, confirm: bool = False) -> bool:
    """Deletes an index; without ``confirm`` nothing happens and an error is raised."""
    if not confirm:
        raise ValueError("clearing an index needs confirm=True")
    fs, p = _place(spark, path)
    return fs.delete(p, True)


def save_graph(path: str, **tables: DataFrame) -> None:
    """nodes, edges, communities and what else is named, each a Parquet table under the path."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in ("nodes", "edges", "communities") if exists(spark, f"{path}/{n}")}


def save_versions(files: DataFrame, path: str) -> DataFrame:
    """Writes files (path, content) that the policy shows as a new version each; returns (path, n_lines, n_bytes, error),
    with an error for those that were not written."""
    files.where(paths.allowed(F.col("path"))).select("path", "content", F.current_timestamp().alias("written")).write.mode("append").parquet(path)
    error = F.when(~paths.allowed(F.col("path")), "the policy doesn't show this file")
    return files.select("path", F.size(F.split("content", "\n", -1)).alias("n_lines"), F.octet_length("content").alias("n_bytes"), error.alias("error"))


def write_report(report: DataFrame, diagram: DataFrame, path: str) -> None:
    """A report's rows as JSON lines under result.json, the diagram's one column of text under graph.puml."""
    report.write.mode("overwrite").json(f"{path}/result.json")
    diagram.write.mode("overwrite").text(f"{path}/graph.puml")
