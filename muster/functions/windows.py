"""Windows used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql.window import Window, WindowSpec


def by_person(*order: Column | str) -> WindowSpec:
    """A person's rows in the given order."""
    return Window.partitionBy("person").orderBy(*order)
