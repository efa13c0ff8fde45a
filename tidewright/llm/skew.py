"""Handing what a group has in common back to its rows, when a group may be a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Over how many tasks the rows of one group are dealt.
SALTS = 16


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their group in ``groups`` (one row a key).

    Groups come ``SALTS`` times, rows with a salt from their ``spread`` columns. So a group's rows go to many
    tasks, and as both sides are dealt anew, adaptive execution can split what is still uneven. Groups should
    be those of several rows only.
    """
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"], how).drop("_salt")
