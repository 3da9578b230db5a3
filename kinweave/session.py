"""Session helpers: sessions for tests, lineage cuts in the shared folder, size checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A side is broadcast only if its exact, counted size stays below this many bytes.
BROADCAST_BYTES = 16 << 20

_own_dir: str | None = None
_written: set[str] = set()


def local_session(cores: int = 8, name: str = "kinweave", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench share."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a session that names none (as in tests) gets a folder of its own, and only on a
    local master: on a cluster a machine-local folder would lose data with its machine.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="kinweave-")
    return f"file://{_own_dir}"


def cut(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This ends the lineage (plans of loops stay one line, a lost executor costs no recomputation
    of earlier rounds), runs the plan once, and keeps the rows columnar.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinweave/{uuid.uuid4().hex}"
    w = df.write.mode("error")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    _written.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinweave_path = path
    return out


def mounted(df: DataFrame) -> str | None:
    """The path of a table written by ``cut``, if the shared folder is one of the machines' file systems; None for an object store or the like."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kinweave_path)
    uri = p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).makeQualified(p).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def drop_cut(*dfs: DataFrame | None) -> None:
    """Delete tables written by ``cut`` that no later plan reads."""
    for df in dfs:
        path = getattr(df, "_kinweave_path", None)
        if path in _written:
            _delete(df.sparkSession, path)
            _written.discard(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_written):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder is scratch
            if path.startswith("file://"):
                shutil.rmtree(path[7:], ignore_errors=True)
    if _own_dir is not None:
        shutil.rmtree(_own_dir, ignore_errors=True)


def cores(spark: SparkSession) -> int:
    """Tasks that can run at once, for sizing the number of salts and tiles."""
    return max(1, spark.sparkContext.defaultParallelism)
