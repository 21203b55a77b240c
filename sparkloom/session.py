"""Sessions with the settings that the engine's answers depend on, and the tables of a data directory."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that fix answers (ANSI arithmetic, zoneless timestamps in UTC) or let Spark re-plan at run time.
PINNED = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(app: str = "sparkloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (PINNED | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def pin(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a session that someone else made."""
    for k, v in PINNED.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def shared_top(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Where it is unset, a local session
    gets one of its own; a cluster must name one, as its executors don't see the driver's folders."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if top:
        return top.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """The path of a new folder there."""
    return f"{shared_top(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: lineage is cut and its size is known to the planner."""
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Tables of a directory of Parquet tables, by attribute; each is also a temporary view for SQL."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = pin(spark), directory.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def views(self, *names: str) -> Tables:
        for name in names:
            getattr(self, name).createOrReplaceTempView(name)
        return self

    def sql(self, text: str, **args) -> DataFrame:
        return self.spark.sql(text, args=args or None)
