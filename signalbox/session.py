"""Session settings the operators rely on, and where jobs keep written state."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "signalbox", master: str | None = None, **conf) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; `conf` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.variant.allowDuplicateKeys": "true",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the message stages rely on, for sessions built elsewhere.

    Repeated keys in one JSON object are legal in captures: the last one counts.
    The JVM never compiles methods over 8000 bytes, so a stage whose generated
    code exceeds that runs faster as one projection per operator.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for state and staged tables, under the cluster's shared folder.

    `spark.checkpoint.dir` names that folder. Where it is unset, a temporary folder of this
    machine is used if the master is local; on a cluster that is an error, as executors and
    the driver would each see files of their own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/signalbox/{name}-{uuid.uuid4()}"
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return os.path.join(tempfile.mkdtemp(prefix="signalbox-"), name)
