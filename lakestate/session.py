"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: MB of a shuffle, and of a file, that one task takes at most. Rows with long ids unpack to many times that, and a task
#: may sort or gather several inputs.
TASK_MB = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": 16, "spark.sql.files.maxPartitionBytes": 32}


def local_session(cpus: str = "8", app: str = "lakestate", **conf: str) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on: UTC clocks and runtime re-planning."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Memory of a task then follows these sizes and not the input; smaller ones are left as set.
    for setting, most in TASK_MB.items():
        if _mb(spark.conf.get(setting)) > most:
            spark.conf.set(setting, f"{most}m")
    # Checkpoints that no plan refers to any more are removed with the driver's garbage. The context reads this at each checkpoint.
    spark.sparkContext._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return spark


def _mb(size: str) -> float:
    """A size as Spark's settings spell it, in MB."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)(?:i?b)?", size.strip().lower()).groups()
    return int(number) * 1024.0 ** (" kmgtp".index(unit or " ") - 2)


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once per application, as a file that Spark distributes."""
    context = spark.sparkContext
    if getattr(context, "_lakestate_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    above = os.path.dirname(package)
    archive = os.path.join(tempfile.mkdtemp(), "lakestate_package.zip")
    with zipfile.ZipFile(archive, "w") as file:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    file.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), above))
    context.addPyFile(archive)
    context._lakestate_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a temporary folder.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = os.path.join(tempfile.gettempdir(), f"lakestate-{uuid.uuid4().hex}")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared one, for one written table."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """Write ``df`` once so that every later use reads the same rows.

    Needed where a plan is used twice and a recomputation could place rows in
    other partitions (range partitioning samples its input).
    """
    spark = df.sparkSession
    shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    kept = df.checkpoint(eager=True)
    del df
    let_go(spark)
    return kept


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The planner then knows its exact size, and broadcasts it only if it is
    below the session's threshold.
    """
    spark, schema = df.sparkSession, df.schema
    path = run_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    if folders := getattr(_passing, "folders", None):
        folders[-1].append(path)
    del df
    let_go(spark)
    return spark.read.schema(schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Have the shuffle files removed that no plan refers to any more.

    Spark does that only when the driver happens to collect its garbage, which one with a large heap hardly ever does.
    Python's garbage goes first, as it may refer to plans. What the very last query made may stay until the next call.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: ``folders``: what ``written`` made within the thread's ``passing`` blocks, a list each, innermost last.
_passing = threading.local()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What ``written`` writes within the block is removed at its end. Nothing lazy may leave the block: what does has to be pinned."""
    _passing.folders = [*getattr(_passing, "folders", []), []]
    try:
        yield
    finally:
        *_passing.folders, made = _passing.folders
    for folder in made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    let_go(spark)
