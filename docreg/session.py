"""Session settings the operators are designed for."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "docreg", **conf: str) -> SparkSession:
    """A session with the settings docreg relies on.

    Adaptive execution does three jobs here: it turns a join into a broadcast only
    after measuring the smaller side, splits skewed join partitions, and coalesces
    small shuffle partitions. The library therefore carries no broadcast hints.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application.

    Needless where the package is installed on the executors or passed with --py-files;
    Spark itself copies the archive from the driver to them.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="docreg-"), "docreg.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


def cut_lineage(df: DataFrame, eager: bool = False) -> DataFrame:
    """Reliable checkpoint in the shared folder the cluster names.

    Only a session without that setting (a local test) gets a folder of its own.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get(CHECKPOINT_CONF, None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
            shared = tempfile.mkdtemp(prefix="docreg-ckpt-", dir=os.environ.get("TMPDIR"))
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=eager)
