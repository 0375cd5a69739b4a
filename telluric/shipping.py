"""The package for Python workers."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import SparkSession

from telluric.sources.scratch import folder

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: from the place the driver has it, or, on a cluster, from an archive in the shared folder."""
    context = spark.sparkContext
    env = context.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)
    if context.applicationId in _SHIPPED or context.master.startswith("local[") or context.master == "local":
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for place, _, names in os.walk(os.path.join(ROOT, "telluric")):
            for name in names:
                if name.endswith(".py"):
                    archive.write(os.path.join(place, name), os.path.relpath(os.path.join(place, name), ROOT))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/telluric.zip")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(held.getvalue())
    out.close()
    context.addPyFile(path.toString())
    _SHIPPED.add(context.applicationId)
