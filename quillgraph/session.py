"""Session construction and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "quillgraph", **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes (UTC, AQE, Arrow)."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or (only where unset, as in tests) a temporary one."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        ctx = spark.sparkContext._jsc.sc().getCheckpointDir()
        given = ctx.get() if ctx.isDefined() else None
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


#: What ``materialize`` and ``materialize_by`` have written in this process: (session, path, table name or "").
_WRITTEN: list[tuple[SparkSession, str, str]] = []
#: How often ``release`` has run: what was built on written tables before is gone.
epoch = 0
#: The schema of the bucketed tables; it lies in the shared folder.
SCHEMA = "quillgraph"


def _schema(spark: SparkSession) -> str:
    """The prefix of bucketed tables: a schema of their own, cleared of tables whose folder is gone, or none if the catalog gives none."""
    key = (spark.sparkContext.applicationId, SCHEMA)
    if key not in _SCHEMAS:
        try:
            spark.sql(f"CREATE SCHEMA IF NOT EXISTS {SCHEMA} LOCATION '{shared_dir(spark)}/{SCHEMA}.db'")
            for t in spark.catalog.listTables(SCHEMA):
                where = [r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {SCHEMA}.{t.name}").collect() if r["col_name"] == "Location"]
                if where and not _exists(spark, where[0]):
                    spark.sql(f"DROP TABLE IF EXISTS {SCHEMA}.{t.name}")
            _SCHEMAS[key] = f"{SCHEMA}."
        except Exception:  # noqa: BLE001 - a catalog without the right to make schemas
            _SCHEMAS[key] = ""
    return _SCHEMAS[key]


_SCHEMAS: dict[tuple[str, str], str] = {}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def release() -> None:
    """Remove all tables that were materialized so far; DataFrames built on them can no longer be read.

    Runs by itself when the process ends; a long session may call it between jobs.
    """
    global epoch
    epoch += 1
    while _WRITTEN:
        spark, path, name = _WRITTEN.pop()
        steps = (lambda: spark.sql(f"DROP TABLE IF EXISTS {name}") if name else None, lambda: _delete(spark, path))  # noqa: B023
        for step in steps:
            try:
                step()
            except Exception:  # noqa: BLE001, S112 - the session may have ended; nothing depends on it
                continue


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    live = spark.sparkContext._jsc
    p.getFileSystem(live.hadoopConfiguration() if live is not None else jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


atexit.register(release)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors, is columnar and compressed, and gives the
    optimizer exact sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path, ""))
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, key: str, name: str = "stage") -> DataFrame:
    """As ``materialize``, bucketed by ``key``: later joins on it read the table without shuffling it again."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"quillgraph_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path, made = f"{shared_dir(spark)}/{table}", _schema(spark) + table
    try:
        df.write.option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(made)
    except AnalysisException:  # a catalog that takes no such table: the join shuffles instead
        return materialize(df, name)
    _WRITTEN.append((spark, path, made))
    return spark.table(made)
