"""Sessions, table access and durable cut points.

Nothing here is tied to a machine: intermediate tables go to the folder named by
``spark.checkpoint.dir``. Only a local master without that setting (tests, a laptop) gets a
temporary folder; on a cluster the setting is required.
"""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidemark", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (ANSI, UTC, AQE)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


class NoSharedFolder(RuntimeError):
    """A cluster session names no folder that its executors share."""


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Read from the session; made only on a local master that names none.

    A folder of one machine on a cluster would lose data without an error, so there NoSharedFolder is raised.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise NoSharedFolder(f"set spark.checkpoint.dir to a folder that all executors of {sc.master} share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemark-shared-"))
    return sc._jsc.sc().getCheckpointDir().get()


_STAGED: list[str] = []


def drop_staged(spark: SparkSession) -> None:
    """Remove the intermediate tables of this process, once no DataFrame made from them is needed any more."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    while _STAGED:
        p = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        p.getFileSystem(conf).delete(p, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed like the staged tables."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    _STAGED.append(path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files every executor can reach, so a lost executor costs
    only the tasks it was running, and gives later joins a measured size. The files
    go away with drop_staged(), else when the JVM ends.
    """
    path = scratch(df.sparkSession, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per context.

    Spark's own way for Python dependencies: an archive in the shared folder, added to the job. Where the
    package is installed on the executors anyway it does no harm.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    path = f"{shared_dir(spark).rstrip('/')}/{root.name}-{uuid.uuid4().hex}.zip"
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(p)
    try:
        out.write(bytearray(held.getvalue()))
    finally:
        out.close()
    fs.deleteOnExit(p)
    sc.addPyFile(path)
    sc._tidemark_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. A missing table fails at once, by Spark's own path check."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
