"""Index tables on disk: parquet folders beside a row of metadata that must match on loading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all machines share; where that is unset, the warehouse, or a temporary one on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        local = spark.sparkContext.master.startswith("local")
        where = "file://" + tempfile.mkdtemp(prefix="spark-") if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{where.rstrip('/')}/index-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows, written under a new folder and read back from there."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Collects the driver's garbage, by which Spark learns that the shuffles of a table that is written are needed no more; their files stay until then."""
    import gc
    import time

    for _ in range(2):
        gc.collect()
        time.sleep(0.25)  # a thread tells the JVM which of its objects Python holds no more
        spark.sparkContext._jvm.System.gc()


def save(path: str, meta: Mapping[str, str], tables: Mapping[str, DataFrame]) -> None:
    """Write all tables, then the metadata, so that an unfinished index never loads."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    rows = [(k, str(v)) for k, v in meta.items()] + [("tables", ",".join(tables))]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_or_build(spark: SparkSession, path: str, meta: Mapping[str, str], build: Callable[[], Mapping[str, DataFrame]], force: bool = False) -> dict[str, DataFrame]:
    """The tables at `path` where their metadata matches and every chunk_id of a table `chunks` names its row's page; else
    build() is written there, by way of a new folder that `path`/current names, and read back."""
    from corpusloom.operators.chunking import audit_ids
    from corpusloom.sources.files import exists

    if not force and exists(spark, f"{path}/current"):
        where = spark.read.text(f"{path}/current").first()[0]
        try:
            tables = load(spark, f"{path}/{where}", meta)
        except ValueError:
            tables = None
        if tables is not None and ("chunks" not in tables or audit_ids(tables["chunks"]).where("not consistent").isEmpty()):
            return tables
    where = uuid.uuid4().hex
    save(f"{path}/{where}", meta, build())
    spark.createDataFrame([(where,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/current")
    return load(spark, f"{path}/{where}", meta)


def load(spark: SparkSession, path: str, meta: Mapping[str, str]) -> dict[str, DataFrame]:
    """The tables, or an error where the metadata differs."""
    have = {r["key"]: r["value"] for r in spark.read.schema("key string, value string").parquet(f"{path}/meta").collect()}
    wrong = {k: (v, have.get(k)) for k, v in meta.items() if have.get(k) != str(v)}
    if wrong:
        raise ValueError(f"index at {path} was built otherwise: {wrong}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in have["tables"].split(",")}
