"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

# What the innermost ``scratch`` block has written so far.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def build_session(master: str | None = None, app_name: str = "guichet", **conf) -> SparkSession:
    """A session with adaptive execution on and a fixed time zone.

    On a cluster leave ``master`` unset and let spark-submit decide.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Longer generated methods are not compiled by the JVM.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def on_workers(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package when it is not installed.

    On a cluster the package is installed or sent with ``--py-files``; this adds nothing there.
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *paths])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a machine-local folder would be lost with its executor, so a missing
    setting is an error there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="guichet-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def shared_folder(spark: SparkSession) -> str:
    """A new folder next to the checkpoints, reachable from every executor."""
    ensure_checkpoint_dir(spark)
    return owned(f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}")


def owned(path: str) -> str:
    """Note that the surrounding ``scratch`` block, if there is one, is to delete ``path``."""
    paths = _written.get()
    if paths is not None:
        paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what operators write down for themselves when the block ends, also by an error.

    Results that read such tables have to be written inside the block. Blocks may be nested: each
    deletes its own. Without a block the tables stay, for the cluster's own cleaning.
    """
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(token)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
