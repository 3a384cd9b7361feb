"""Session factory and the shared-folder table helper."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Where written intermediate tables go when the cluster names no shared folder (tests, local runs).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"

_shipped: set[str] = set()


def get_session(app: str = "loomwright", cpus: int | str = "*", **conf) -> SparkSession:
    """A local session with the settings the tests and the benchmark use; on a cluster use your own session."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local run has one of its own; on a
    cluster that is an error, as no folder of one machine would do."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{LOCAL_CHECKPOINTS}"
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at interpreter exit
        if path.startswith("file://"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


#: Scratch paths of this program that have not been removed, with their serial numbers, and the next one.
_scratch: dict[str, tuple[int, SparkSession]] = {}
_serial = 0


def scratch_path(spark: SparkSession, name: str = "t") -> str:
    """A fresh path in the shared folder, removed by release(), or when the program ends."""
    global _serial
    path = f"{shared_dir(spark)}/loomwright/{name}-{uuid.uuid4().hex}"
    _scratch[path] = (_serial, spark)
    _serial += 1
    return path


def scratch_mark() -> int:
    """A mark for release(): scratch tables made from now on."""
    return _serial


@atexit.register
def release(since: int = 0) -> None:
    """Remove the scratch tables made since a mark, once the results that read them are written or shown. Long sessions
    call this; a program's end does it anyway."""
    for path, (serial, spark) in list(_scratch.items()):
        if serial >= since:
            _remove(spark, path)
            _scratch.pop(path, None)


def durable(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by durable() that nothing will read again."""
    _scratch.pop(df._durable_path, None)
    _remove(df.sparkSession, df._durable_path)


#: Rows and bytes of one Arrow batch that a Python worker gets: with whole documents in the rows, the default of 10,000 rows
#: is hundreds of megabytes, and several times that as Python objects.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches, unless the session has bounds of its own."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    if spark.conf.get(_BYTES, None) is None:
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches bounded: for operators whose Python sees whole texts."""
    bound_batches(df.sparkSession)
    return df


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / "loomwright_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    atexit.register(shutil.rmtree, target.parent, True)
