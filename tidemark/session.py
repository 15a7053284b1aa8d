"""Session settings that belong to the engine rather than to one query."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(app: str = "tidemark", cores: int = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the session comes from spark-submit."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Only where that setting is absent and the master is local (tests, a single machine) a temporary folder is made and set as
    the session's checkpoint folder. On a cluster without it this raises: each executor would write to its own disk, and what
    is read back would lack the rest.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = jdir.get() if jdir.isDefined() else None
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def parallelism(spark: SparkSession) -> int:
    """The number of shuffle partitions of the session, the unit in which hot keys and buckets are sized."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession, repository: str) -> None:
    """Sends the package to the executors' Python workers, once a session, unless their path holds it already."""
    app = spark.sparkContext.applicationId
    there = {os.path.abspath(p) for p in [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]}
    if app in _SHIPPED or repository in there:
        return
    at = os.path.join(tempfile.mkdtemp(prefix="tidemark-code-"), "tidemark")
    spark.sparkContext.addPyFile(shutil.make_archive(at, "zip", repository, "tidemark"))
    _SHIPPED.add(app)
