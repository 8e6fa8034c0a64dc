"""Session helpers: a local session for tests, and tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its written size and its rows stay within these bounds.
BROADCAST_BYTES = 8 << 20
BROADCAST_ROWS = 400_000
_OWNED: dict[str, str] = {}


def local_session(app: str = "millrace", cpus: int | str = 4, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MILLRACE_DRIVER_MEMORY", "6g"))
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def tables_folder(spark: SparkSession) -> str:
    """The folder of this application's own tables; it is removed when the application ends."""
    sc = spark.sparkContext
    folder = f"{shared_folder(spark)}/millrace/{sc.applicationId}"
    if _OWNED.get(sc.applicationId) != folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _OWNED[sc.applicationId] = folder
    return folder


def release(spark: SparkSession) -> None:
    """Removes the tables written so far; frames that read them can no longer be used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(tables_folder(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path, True)
    fs.mkdirs(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{tables_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bytes_of(df: DataFrame) -> int:
    """Size of the files behind a table that written() returned."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    total = 0
    for f in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(f)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def is_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table of written() is within the broadcast bounds."""
    return bytes_of(df) <= max_bytes and df.count() <= max_rows


def small_side(df: DataFrame, max_bytes: int = BROADCAST_BYTES, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a table of written() for broadcast if it is within the bounds; else Spark shuffles it."""
    return F.broadcast(df) if is_small(df, max_bytes, max_rows) else df


def one_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    name, i = f"__{stem}", 0
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        i += 1
        name = f"__{stem}{i}"
    return name
