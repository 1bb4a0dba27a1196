"""A store of rows by key whose prefix scans read the files and row groups of the prefix alone.

Rows are dealt to files by ranges of their key and sorted within. Readers get a range
of keys, [prefix, next prefix), as plain comparisons, which parquet's statistics answer;
a function of the key, such as a lower-cased one, would read everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a row group, about: what a scan reads at least.
GROUP_ROWS = 20_000


def store(rows: DataFrame, key: str, path: str, files: int | None = None) -> None:
    """Writes rows in the order of their key; a key that holds many rows gets several files.

    Within equal keys a hash of the row decides, so ranges can split them.
    """
    order = [F.col(key), F.xxhash64(*rows.columns)]
    dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.mode("overwrite").option("parquet.block.row.count.limit", GROUP_ROWS).parquet(path)


def after(prefix: str) -> str | None:
    """The least string above all that begin with prefix, in the order of code points; none if there is no such."""
    for k in range(len(prefix) - 1, -1, -1):
        c = ord(prefix[k])
        if c < 0x10FFFF:
            c = 0xE000 if c == 0xD7FF else c + 1  # surrogates are no characters
            return prefix[:k] + chr(c)
    return None


def begins(key: Column, prefix: str) -> Column:
    """That a key begins with prefix, as a range."""
    stop = after(prefix)
    return (key >= prefix) if stop is None else (key >= prefix) & (key < stop)


def scan(spark: SparkSession, path: str, key: str, prefix: str) -> DataFrame:
    """The rows whose key begins with prefix, an empty one being any, in the store at path."""
    df = spark.read.parquet(path)
    return df.where(begins(F.col(key), prefix)) if prefix else df
