"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "__salt"


def spread(count: Column, rows_per_salt: int, max_salts: int) -> Column:
    """Number of salts for a key with ``count`` rows: 1 for ordinary keys, more for hot ones."""
    return F.least(F.lit(max_salts), F.greatest(F.lit(1), F.ceil(count / rows_per_salt))).cast("int")


def join_hot(
    rows: DataFrame, table: DataFrame, keys: list[str], count: str, row_salt: Column, *, rows_per_salt: int = 200_000, max_salts: int = 256
) -> DataFrame:
    """Inner join of many ``rows`` with a ``table`` that is unique by ``keys`` and knows each key's ``count``.

    Rows of a key with more than ``rows_per_salt`` rows are spread over several tasks: the table's row is
    repeated once per salt (its number of copies follows the count), and each row picks a salt by hash.
    Only the table is repeated, never the rows, so the result is that of the plain join.
    ``row_salt`` is any well-spread integer of a row, such as a hash of its id.
    """
    # a row need not know whether its key is hot: it carries max_salts candidates folded to the key's width
    width = spread(F.col(count), rows_per_salt, max_salts)
    hot = table.filter(F.col(count) > rows_per_salt).withColumn("__width", width)
    # the number of hot keys is at most rows / rows_per_salt, so this side is small by construction
    hot_keys = hot.select(*keys, "__width")
    marked = rows.join(F.broadcast(hot_keys), keys, "left").withColumn(
        SALT, F.when(F.col("__width").isNull(), F.lit(0)).otherwise(F.pmod(row_salt, F.col("__width"))).cast("int")
    ).drop("__width")
    salted = table.withColumn(SALT, F.explode(F.sequence(F.lit(0), width - 1)))
    return marked.join(salted, [*keys, SALT]).drop(SALT)
