"""Session helpers: building a session, loading tables, the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import shutil

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def get_spark(app: str = "axiomill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (AQE, UTC, Arrow).

    ``conf`` uses ``__`` for the dot of a setting's name. An existing session is reused.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder stands in, but only for a local master: on a cluster a
    machine-local folder would lose its files with the machine, so there the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="axiomill-")
        atexit.register(shutil.rmtree, _OWN[sc.applicationId], True)
    return "file://" + _OWN[sc.applicationId]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
