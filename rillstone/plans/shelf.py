"""Tables in parts that tasks read for themselves, as often as they need them.

Where every part meets many others, a shuffle writes each part once for every other. A shelf holds each part once, as files
in the shared folder, and a task opens the parts it is about: what is read grows, and not what is written.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillstone.plans.cut import freeing, new_path

PART = "__part_of_shelf"
MOST_TASKS = 20_000


def part_of(key: str, parts: int) -> Column:
    """The part that a key is in, the same for every table with as many parts."""
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


@dataclass(frozen=True)
class Shelf:
    path: str
    parts: int
    schema: StructType

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)

    def read(self, part: int, *columns: str, words: tuple[str, ...] = ()) -> pa.Table | None:
        """One part's rows, None if it has none. `words` are the columns whose strings come as numbers of a dictionary."""
        files, root = pafs.FileSystem.from_uri(self.path)
        found = files.get_file_info(pafs.FileSelector(f"{root}/{PART}={part}", allow_not_found=True))
        named = sorted(f.path for f in found if f.path.endswith(".parquet"))
        each = [pq.ParquetFile(files.open_input_file(p), read_dictionary=[*words]).read([*columns] or None) for p in named]
        return pa.concat_tables(each).unify_dictionaries() if each else None


def shelved(df: DataFrame, key: str, parts: int, label: str) -> Shelf:
    """`df` written in parts by the hash of `key`."""
    path = new_path(df.sparkSession, label)
    with freeing(df.sparkSession):
        df.withColumn(PART, part_of(key, parts)).repartitionById(parts, F.col(PART)).write.partitionBy(PART).parquet(path)
    return Shelf(path, parts, df.schema)


def numbers(spark: SparkSession, n: int) -> DataFrame:
    """(task) from 0 to `n` - 1, each number in a task of its own, or neighbours in different ones of `MOST_TASKS`."""
    most = max(1, min(n, MOST_TASKS))
    return spark.range(n).select(F.col("id").alias("task")).repartitionById(most, F.pmod("task", F.lit(most)).cast("int"))
