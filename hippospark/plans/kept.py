"""What a store keeps beside its texts, for queries over the driver's tables: built once for a state of the tables, found again by it.

The state is the names, sizes and times of the tables' files, so changed tables never meet an old index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from hippospark.functions.commits import Folder
from hippospark.functions.storage import forget, saved, shared_dir
from hippospark.operators.keyword_index import SegmentIndex
from hippospark.operators.vector_index import VectorIndex


def state(spark: SparkSession, d: str, tables: Sequence[str]) -> str:
    found = []
    for name in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files = fs.listStatus(path)
        found += [f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files]
    return hashlib.sha1("\n".join(sorted(found)).encode()).hexdigest()[:16]


def kept_table(spark: SparkSession, d: str, name: str, tables: Sequence[str], build: Callable[[], DataFrame], order: str | None = None) -> DataFrame:
    """The table of this name for this state of the tables, in the order of a column if one is given."""
    path = f"{shared_dir(spark)}/kept/{name}-{state(spark, d, tables)}"
    if "_SUCCESS" not in Folder(spark, path).names():
        rows = build()
        # ranges are found from a sample, for which all that leads to the rows would run once more
        held = None if order is None else saved(rows, name)
        (rows if held is None else held.repartitionByRange(order).sortWithinPartitions(order)).write.mode("overwrite").parquet(path)
        if held is not None:
            forget(held)
    return spark.read.parquet(path)


def kept_index(spark: SparkSession, d: str, name: str, tables: Sequence[str], rows: Callable[[], DataFrame], id_col: str, text_col: str, id_type: str) -> SegmentIndex:
    index = SegmentIndex(spark, f"{shared_dir(spark)}/kept/{name}-{state(spark, d, tables)}", id_type)
    if index.note() is None:
        index.update(rows(), id_col=id_col, text_col=text_col, note="built")
    return index


def kept_vectors(spark: SparkSession, d: str, name: str, tables: Sequence[str], rows: Callable[[], DataFrame], id_col: str, vec_col: str, id_type: str) -> VectorIndex:
    index = VectorIndex(spark, f"{shared_dir(spark)}/kept/{name}-{state(spark, d, tables)}", id_type)
    if not index.state()[0]:
        index.insert(rows(), id_col, vec_col)
    return index
