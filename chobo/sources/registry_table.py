"""The registry as a stored table that is laid out for joins by number and takes new snapshots in place.

Numbers are hashed as a shuffle hashes them, into a fixed number of buckets. Each bucket is a folder (a partition of the
table) and one file in it, so a join with rows by number moves the rows alone, and a snapshot rewrites those folders
alone that it has numbers of.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chobo.operators.registry import FIELDS, last_wins
from chobo.sources.folders import make

BUCKETS = 64


class RegistryTable:
    """A registry below ``path``, in ``buckets`` buckets; a folder that holds one already is opened.

    The session's catalog gets a name for it, which close() takes away; the files stay. Two writers at once are not
    foreseen. Readers of a bucket see its old files or its new ones.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets, self.name = spark, path, buckets, f"registry_{uuid.uuid4().hex}"
        make(spark, path)
        spark.sql(
            f"CREATE TABLE {self.name} ({', '.join(f'{c} STRING' for c in FIELDS)}, bucket INT) USING parquet OPTIONS (partitionOverwriteMode 'dynamic') "
            f"PARTITIONED BY (bucket) CLUSTERED BY (reg_no) SORTED BY (reg_no) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def bucket(self) -> Column:
        """The bucket of reg_no, by the hash that shuffles and bucketed tables go by."""
        return F.pmod(F.hash("reg_no"), F.lit(self.buckets))

    def read(self) -> DataFrame:
        """All rows, distributed and sorted by reg_no."""
        return self.spark.table(self.name).select(*FIELDS)

    def _write(self, rows: DataFrame) -> None:
        by = rows.select(*FIELDS, self.bucket().alias("bucket")).repartition(self.buckets, "reg_no").sortWithinPartitions("bucket", "reg_no")
        by.write.insertInto(self.name, overwrite=True)

    def upsert(self, rows: DataFrame, order: list[str]) -> int:
        """Take new rows (FIELDS and the columns of ``order``): of a number's new rows the last counts, and it replaces
        what the table has. Returns how many buckets were rewritten; numbers that the snapshot lacks stay as they are."""
        new = last_wins(rows.select(*FIELDS, *[c for c in order if c not in FIELDS]), "reg_no", order).select(*FIELDS)
        # numbers, not rows, come to the driver: at most one for each bucket
        touched = [r.b for r in new.select(self.bucket().alias("b")).distinct().collect()]
        if touched:
            old = self.spark.table(self.name).filter(F.col("bucket").isin(touched)).select(*FIELDS)
            self._write(old.join(new.select("reg_no"), "reg_no", "left_anti").select(*FIELDS).unionByName(new))
        return len(touched)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
