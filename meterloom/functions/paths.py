"""Parts of paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def folders_above(path: Column) -> Column:
    """The folders that hold a path, each as its text without a slash at the end."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
