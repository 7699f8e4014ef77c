"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playbill.session import remove, work_folder


class Workspace:
    """A folder of one run: ``keep`` writes a table there, so that a lost executor costs no recomputation.

    It is removed when the application ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.path = work_folder(spark, "playbill")
        self.count = 0
        self.kept: list[tuple[DataFrame, str]] = []

    def folder(self, name: str) -> str:
        self.count += 1
        return f"{self.path}/{self.count}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.folder(name)
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((back, path))
        return back

    def free(self, *needed: DataFrame) -> None:
        """Removes all tables but the ``needed`` ones, once nothing that is still to run reads the others."""
        for table, path in self.kept:
            if not any(table is n for n in needed):
                remove(self.spark, path)
        self.kept = [(t, p) for t, p in self.kept if any(t is n for n in needed)]


#: A list of at most so many 8-byte keys, 16 MB, is sent to every task; a longer one is shuffled.
BROADCAST_KEYS = 2_000_000


def among(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``df`` that join with ``keys`` (its one column, 64-bit), by ``left_semi`` or ``left_anti``.

    The number of keys is measured first. A short list meets the rows where they are read, so that wide
    rows which are not wanted are never shuffled.
    """
    small = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if small else keys, keys.columns[0], how)


def clean_columns(df: DataFrame, taken: list[str]) -> list[str]:
    """Columns of the input that do not clash with the names an operator adds (case is ignored)."""
    names = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in names]
