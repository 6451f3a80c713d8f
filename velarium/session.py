"""Session settings that suit the engine, and a read-only SQL facade over registered tables."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings for large inputs; sizes are targets that Spark re-plans at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
_READS = re.compile(r"^\s*(?:--[^\n]*\n\s*)*(?:select|with|values|describe|show|explain|table)\b", re.I)


def session(master: str | None = None, **extra: str) -> SparkSession:
    """A session with the engine's settings."""
    b = SparkSession.builder.config(map=SETTINGS | extra)
    return (b.master(master) if master else b).getOrCreate()


def kept(df: DataFrame) -> DataFrame:
    """The rows written to the session's checkpoint folder and read from there; runs a job at once.

    For results that are used more than once and to end long lineages; lost executors then cost no
    earlier stage. Only a local session that names no ``spark.checkpoint.dir`` gets a temporary folder; others must name one.
    """
    sc, folder = df.sparkSession.sparkContext, df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in a folder of any file system Spark reads; none if it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []


def register(spark: SparkSession, folder: str) -> list[str]:
    """Each Parquet file or folder of ``folder`` as a temporary view; the names in order."""
    names = sorted(n.removesuffix(".parquet") for n in names_in(spark, folder) if n.endswith(".parquet"))
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)
    return names


def tables(spark: SparkSession) -> list[str]:
    """Names of the session's tables and views."""
    return sorted(t.name for t in spark.catalog.listTables())


def schema_text(spark: SparkSession, name: str) -> str:
    """Columns and types of a table, one a line."""
    return "\n".join(f"{c} {t}" for c, t in spark.table(name).dtypes)


def query(spark: SparkSession, sql: str, most: int | None = None) -> DataFrame:
    """Rows of a reading statement; anything that writes is refused. ``most`` is the tool's display limit."""
    if not _READS.match(sql) or ";" in sql.rstrip().rstrip(";"):
        raise ValueError("only one reading statement is allowed")
    rows = spark.sql(sql.rstrip().rstrip(";"))
    return rows.limit(most) if most else rows


def reads_no_table(spark: SparkSession, sql: str) -> bool:
    """Whether a statement names no table; told from the parsed plan."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toString()
    return "UnresolvedRelation" not in plan
