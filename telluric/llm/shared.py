"""What the modules of this subpackage share: the library's intermediate tables, and rows with a number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telluric.shipping import ship
from telluric.sources.scratch import folder, remove, saved, temporary

__all__ = ["folder", "numbered", "remove", "saved", "ship", "temporary"]


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """(docs with one more column, its name): a number of its own for each row, in a table, so that it is the same however often it is read."""
    name = "__row"
    while name in docs.columns:
        name += "_"
    return saved(docs.withColumn(name, F.monotonically_increasing_id()), f"{folder(docs.sparkSession)}/numbered"), name
