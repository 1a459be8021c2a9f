"""Make the package usable in the Python workers of any cluster, however the driver found it."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import cuelake

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers as a zip, once per application.

    Stateful streaming starts a worker on the driver that does not see shipped files, so functions and folds of the
    package are also pickled by value.
    """
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        cloudpickle.register_pickle_by_value(cuelake)
        root = Path(__file__).resolve().parents[2]
        name = str(Path(tempfile.mkdtemp(prefix="cuelake-zip-")) / "cuelake")
        spark.sparkContext.addPyFile(shutil.make_archive(name, "zip", root, "cuelake"))
        _SHIPPED.add(app)
