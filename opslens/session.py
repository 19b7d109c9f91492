"""Session settings the library relies on."""
from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # building a plan is thousands of calls to the JVM; recording a Python call site for each doubles it
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


#: stand-in folders of sessions on one machine
_LOCAL: WeakKeyDictionary[SparkSession, str] = WeakKeyDictionary()


def build_session(app_name: str = "opslens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; ``conf`` keys use '__' for '.'."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Event times are epoch milliseconds in UTC: pin the session zone of a session made elsewhere.

    Only this runtime setting is touched; static ones belong to ``build_session``.
    """
    zone = "spark.sql.session.timeZone"
    if spark.conf.get(zone, None) != SETTINGS[zone]:
        spark.conf.set(zone, SETTINGS[zone])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for written intermediate tables and checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests on one machine) a
    temporary folder stands in, kept for the life of the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if spark not in _LOCAL:
        _LOCAL[spark] = tempfile.mkdtemp(prefix="opslens-")
    return _LOCAL[spark]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read back, for steps that would compute it again and again."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/opslens-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
