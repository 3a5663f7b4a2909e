"""Session settings, table access, and tables staged in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root not in os.environ.get("PYTHONPATH", "").split(":"):
        os.environ["PYTHONPATH"] = f"{root}:{os.environ.get('PYTHONPATH', '')}"
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName("kinolith")
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Partitions of an explicit exchange: the cluster's own setting, at least its cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where it is unset and all runs on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="kinolith-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where


_left: set[str] = set()


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver ends. What is to stay needs a folder of its own."""
    app = spark.sparkContext.applicationId
    if app not in _left:
        _left.add(app)
        atexit.register(_leave, spark)
    return f"{shared_dir(spark).rstrip('/')}/kinolith-{app}"


def _leave(spark: SparkSession) -> None:
    try:
        release_stages(spark)
    except Exception:  # the session has ended before the driver
        pass


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_stages(spark: SparkSession) -> None:
    """Delete all staged tables of this application; only once no frame that reads them is used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean_id(c: str | Column) -> Column:
    """A video id in its one spelling: trimmed of any blanks, upper case."""
    c = F.col(c) if isinstance(c, str) else c
    blank = r"[\s\x{A0}\x{3000}]+"
    return F.upper(F.regexp_replace(c, f"^{blank}|{blank}$", ""))


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row of each key with the latest `by`; rows equal in `by` fall to the largest remaining values, so the result is fixed.

    One partial aggregate per map task, so a key repeated many times shrinks before the exchange. Null keys form one key.
    Columns that hold maps are carried along; as maps have no order, rows that differ only there are ranked by their JSON."""
    rest = [c for c in df.columns if c not in keys and c != by]
    maps = {c for c, t in df.dtypes if "map<" in t}
    held = F.struct(F.col(f"`{by}`").alias("by_"), *[F.col(f"`{c}`") for c in rest])
    if maps:
        rank = F.struct(F.col(f"`{by}`"), *[F.col(f"`{c}`") for c in rest if c not in maps], *[F.to_json(F.struct(F.col(f"`{c}`"))).alias(c) for c in rest if c in maps])
        row = F.max_by(held, rank)
    else:
        row = F.max(held)
    agg = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(row.alias("row_"))
    cols = [F.col(f"`{k}`") for k in keys] + [F.col("row_.by_").alias(by)] + [F.col(f"row_.`{c}`").alias(c) for c in rest]
    return agg.select(*cols)
