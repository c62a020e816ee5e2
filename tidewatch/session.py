"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the job brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidewatch")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def executor_cores(spark: SparkSession) -> int:
    """Cores of one executor, as the session names them."""
    kind, _, rest = spark.sparkContext.master.partition("[")
    if kind == "local-cluster":
        return max(1, int(rest.rstrip("]").split(",")[1]))
    if kind == "local":
        return max(1, spark.sparkContext.defaultParallelism)
    return max(1, int(spark.sparkContext.getConf().get("spark.executor.cores", "1")))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: executors on other
    machines could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    fallback = tempfile.mkdtemp(prefix="tidewatch-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/tidewatch/{name}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Materialise ``df`` as a table in the shared folder and read it back.

    The rows outlive lost executors, and whatever builds on them no longer
    recomputes the steps before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str):
    """A few driver-side values as an inline table, without a job of their own."""
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    if not rows:
        return spark.createDataFrame([], schema)

    def literal(value, kind: str) -> str:
        if value is None:
            return f"CAST(NULL AS {kind})"
        text = "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
        return text if kind == "string" else f"CAST({text} AS {kind})"

    values = ", ".join("(" + ", ".join(literal(v, k) for v, (_, k) in zip(row, fields)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(n for n, _ in fields)})")
