"""Session defaults: UTC, ANSI, adaptive plans; everything else is left to the cluster."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(master: str | None = None, conf: dict[str, str] | None = None, app: str = "cadenza") -> SparkSession:
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        root = os.path.join(os.environ.get("TMPDIR", "/tmp"), "cadenza")
        settings |= {
            "spark.sql.warehouse.dir": f"file://{root}/warehouse",
            "spark.checkpoint.dir": f"file://{root}/checkpoints",
            "spark.driver.host": "127.0.0.1",
        }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (settings | (conf or {})).items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
