"""Equality joins with hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.scratch import free_prefix


def salted_join(large: DataFrame, small: DataFrame, on: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """An equality join whose hot keys are spread: large rows get salts in turn, small rows are repeated for each salt.  Rows of the
    small side that nothing matches are added once, where the mode keeps them.

    A salt is a row's position in its partition, so that equal rows get different ones.  The repeated side is joined by merge:
    its size is known only after it is repeated.
    """
    if how in ("right", "right_outer", "full", "full_outer", "outer"):
        matched = salted_join(large, small, on, salts, "inner" if how.startswith("right") else "left")
        return matched.unionByName(small.join(large.select(*on).distinct(), on, "left_anti"), allowMissingColumns=True)
    salt = f"{free_prefix(large, small)}salt"
    return salted(large, salts, salt).join(small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge"), [*on, salt], how).drop(salt)


def salted(large: DataFrame, salts: int, name: str) -> DataFrame:
    """large with a salt from 0 to salts - 1 for each row, in turn within a partition."""
    return large.withColumn(name, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
