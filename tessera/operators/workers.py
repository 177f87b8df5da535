"""What workers need: the package's code, and models that each of them loads once."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch that goes to a worker, where the session has Spark's default (10,000 rows of long texts, matrices or shards of an index would take gigabytes).
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)

_shipped: dict[str, str] = {}
_loaded: dict[str, Any] = {}


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application (they may not see the driver's folders), and bound Arrow batches by bytes."""
    if not spark.sparkContext.getConf().contains(BATCH[0]):
        spark.conf.set(*BATCH)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(out))
    _shipped[app] = str(out)


@dataclass(frozen=True)
class Lazy:
    """A model by name and how to load it: only this goes to the workers, and each loads the model when it first needs it and keeps it."""

    name: str
    load: Callable[[], Any]


def model(m):
    """The model itself, on a worker."""
    if not isinstance(m, Lazy):
        return m
    if m.name not in _loaded:
        _loaded[m.name] = m.load()
    return _loaded[m.name]
