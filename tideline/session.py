"""Session factory, table access and lineage cutting."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def make_session(app: str = "tideline", cores: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every operator assumes: UTC, AQE, Arrow.

    Cluster settings (executors, memory, shuffle partitions) are left to the
    submitter; only a local run gets a master and a small partition number.
    """
    b = SparkSession.builder.appName(app)
    if "SPARK_MASTER" not in os.environ and cores:
        b = b.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", cores)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A scan with at least one partition a core, for steps that cost much more than a shuffle.

    A table of few row groups would leave cores idle; one that already has
    enough partitions, as every large one, is left alone. The number of
    partitions is estimated from the files, so nothing is planned twice.
    """
    spark = scan.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = [unquote(f) for f in scan.inputFiles()]
    if len(files) >= cores or not files:
        return scan
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0]
    most = re.match(r"\d+", spark.sparkContext.getConf().get("spark.sql.files.maxPartitionBytes", "134217728b"))
    return scan if size >= cores * max(int(most[0]), 1 << 20) else scan.repartition(cores, key)


#: Rows of one key above which it is salted, and how many keys may be salted.
HOT, HOT_KEYS = 20_000, 10_000


def hot_keys(df: DataFrame, keys: list[str], name: str = "salts", hot: int = HOT) -> DataFrame:
    """(keys, salts): keys with more than ``hot`` rows and more than one in HOT_KEYS of all rows.

    So there are fewer than HOT_KEYS of them at any size, and what is left to one
    task is no more than an average one of HOT_KEYS tasks gets.
    """
    n = df.groupBy(*keys).count()
    most = n.agg(F.greatest(F.lit(hot), F.ceil(F.sum("count") / HOT_KEYS)).alias("most"))
    return n.crossJoin(F.broadcast(most)).where("count > most").select(*keys, F.ceil(F.col("count") / F.col("most")).cast("int").alias(name))


def hot_rows(left: DataFrame, keys: list[str], right: DataFrame | None = None, hot: int = HOT) -> DataFrame | None:
    """(keys, __a, __b): salts of the keys that are hot on either side, counted at once; None where there is none."""
    h = hot_keys(left, keys, "__a", hot)
    h = h.withColumn("__b", F.lit(1)) if right is None else h.join(hot_keys(right, keys, "__b", hot), keys, "full")
    rows = h.collect()  # fewer than HOT_KEYS of either side
    return left.sparkSession.createDataFrame(rows, h.schema) if rows else None


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], by_left: Column, by_right: Column | None = None, hot: int = HOT, rows: DataFrame | None | bool = False,
) -> DataFrame:
    """Inner equi-join on keys that may be hot on either side; ``by_left``, ``by_right``: what rows are spread by.

    Which keys are hot is counted first (or given as ``rows``), so inputs should be
    cheap to read twice; where none is, which is usual, the join is a plain one.
    Rows of a key hot on the left are spread over salts and their partners
    repeated; with ``by_right`` the same holds the other way round, so a task has
    at most ``hot`` rows of either side. Without it each key is once on the right.
    """
    h = hot_rows(left, keys, None if by_right is None else right, hot) if rows is False else rows
    if h is None:
        return left.join(right, keys)
    h = F.broadcast(h)
    a, b = F.coalesce("__a", F.lit(1)), F.coalesce("__b", F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    lf = left.join(h, keys, "left").withColumns({"__i": F.pmod(by_left, a).cast("int"), "__j": every(b)}).drop("__a", "__b")
    rt = right.join(h, keys, "left").withColumn("__i", every(a))
    rt = rt.withColumn("__j", F.pmod(F.lit(0) if by_right is None else by_right, b).cast("int")).drop("__a", "__b")
    return lf.join(rt, [*keys, "__i", "__j"]).drop("__i", "__j")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the lineage ends in files all executors share.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Where
    that is unset a local folder is made, but only if all tasks run in this
    machine's local master; on a cluster it is an error, as one machine's folder
    would be lost with it. Files go when their DataFrame does, where the session
    has ``spark.cleaner.referenceTracking.cleanCheckpoints``, as `make_session` sets.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="tideline-ckpt-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)
