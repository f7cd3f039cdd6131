"""Session helpers: where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(cores: int | str = "*", app: str = "attestry", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, where
    driver and executors share one disk, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            context.setCheckpointDir(configured)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="attestry-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path nobody has used yet, in the shared folder; it goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialize(df: DataFrame, label: str = "table", by: Sequence[str] = ()) -> DataFrame:
    """Compute once into Parquet in the shared folder, so that later passes see the same rows.

    Lineage is cut, and later filters and column choices reach the files; filters
    on the columns ``by`` choose folders. A frame that comes from here is returned
    as it is.
    """
    if getattr(df, "_materialized", False):
        return df
    spark, empty = df.sparkSession, [f.name for f in df.schema if f.dataType.typeName() == "void"]
    path = fresh_path(spark, label)
    kept = df.drop(*empty)
    kept.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(kept.schema).parquet(path).select(*[F.col(f"`{c}`") for c in kept.columns])
    if empty:
        out = out.withColumns({c: F.lit(None) for c in empty}).select(*[F.col(f"`{c}`") for c in df.columns])
    out._materialized = True
    return out


# A broadcast table may hold at most this much; beyond it Spark shuffles both
# sides and splits skewed keys itself.
BROADCAST_BYTES = 32 << 20


def small_enough(held: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a materialized table may be broadcast, by the bytes its rows hold."""
    width = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.lit(16)
             for f in held.schema]
    size = held.agg(F.sum(sum(width, F.lit(16)))).first()[0]
    return (size or 0) <= limit
