"""Spark session construction and shared-storage helpers.

Cluster settings (shuffle partitions, checkpoint folder) come from the session that the
cluster hands us; the helpers here only fill in values that are unset, which is the case
in local tests.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every plan in this package relies on. They are defaults: a value the cluster
# already set wins.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # broadcast only what is explicitly hinted after a size check; never by statistics guess
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "spindle") -> SparkSession:
    """Session for tests and the local bench: local[cores], UI off, UTC."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SPINDLE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(32 * 1024 * 1024))
        # reliable checkpoints of finished batches are removed once unreferenced
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Fill in the package defaults on an existing session without overriding cluster values.

    The time zone is the one exception: it is always UTC, on which results depend."""
    for k, v in SESSION_DEFAULTS.items():
        if k == "spark.ui.enabled":
            continue  # static conf, cannot change at runtime
        try:
            if spark.conf.get(k, None) is None:
                spark.conf.set(k, v)
        except Exception:  # static or immutable conf on this deployment
            pass
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


# For a batch of a few hundred rows compiling most plans takes longer than running them (Spark keeps
# 100 compiled classes, a batch has more), and its first stages have nothing to tell the later ones.
INTERPRETED = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
FEW_ROWS = {**INTERPRETED, "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "1"}


@contextmanager
def few_rows(spark: SparkSession | None) -> Iterator[None]:
    """Plan for a few rows in a session of its own (that of a stream's batches); None changes nothing."""
    before = {k: spark.conf.get(k, None) for k in FEW_ROWS} if spark is not None else {}
    try:
        for k in before:
            spark.conf.set(k, FEW_ROWS[k])
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Within ``few_rows``: the one plan whose compiled classes are worth it and are met again."""
    keys = [k for k, v in INTERPRETED.items() if spark.conf.get(k, None) == v]
    keys = keys if len(keys) == len(INTERPRETED) else []
    try:
        for k in keys:
            spark.conf.unset(k)
        yield
    finally:
        for k in keys:
            spark.conf.set(k, INTERPRETED[k])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is a shared file system folder configured by the operator. Only when it
    is unset (local tests) do we create one under the system temp folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spindle-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared checkpoint folder, for tables that cut lineage."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([root, *parts])


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once a session.

    Python functions in tasks are pickled by module name, so the workers, of a local session
    too, need the package on their path whatever folder the driver was started in.
    """
    sc = spark.sparkContext
    if getattr(sc, "_spindle_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spindle-pkg-")), "spindle_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(Path(root.name) / f.relative_to(root)))
    sc.addPyFile(archive)
    sc._spindle_shipped = True
