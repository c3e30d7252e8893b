"""Continuous graph-pattern analytics on Spark."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

_shipped: set[str] = set()


def ship(spark) -> None:
    """Give this package to the executors of a session, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(here)))
    target = os.path.join(tempfile.mkdtemp(prefix="tuplewave-"), "tuplewave.zip")
    with open(target, "wb") as f:
        f.write(data.getvalue())
    context.addPyFile(target)
