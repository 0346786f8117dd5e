"""Ships the package to executors, once for each SparkContext."""

from __future__ import annotations

import io
import os
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import SparkSession

_shipped: weakref.WeakSet[SparkContext] = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Python workers can import the package afterwards, wherever they run."""
    context = spark.sparkContext
    if context in _shipped:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    folder = tempfile.mkdtemp(prefix="textloom-")  # the driver serves it to executors from here
    path = os.path.join(folder, "textloom.zip")
    Path(path).write_bytes(packed.getvalue())
    context.addPyFile(path)
    _shipped.add(context)
