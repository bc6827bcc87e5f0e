"""User functions in Python, for what built-in functions can't say; Arrow batches rather than rows where possible."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.udf(T.StringType())
def initials(name: str) -> str:
    """A plain Python function, row by row."""
    return "".join(w[0] for w in (name or "").split("#")[0].split())


@F.pandas_udf(T.DoubleType())
def discounted(price: pd.Series, discount: pd.Series) -> pd.Series:
    return price * (1 - discount)


@F.pandas_udf(T.DoubleType())
def highest(x: pd.Series) -> float:
    """An aggregate, of a part of a group."""
    return float(x.max())


@F.pandas_udf(T.DoubleType())
def lowest(x: pd.Series) -> float:
    return float(x.min())


@F.udtf(returnType=T.StructType([T.StructField("word", T.StringType()), T.StructField("at", T.IntegerType())]))
class Words:
    """A table function: the words of a text with their places."""

    def eval(self, text: str):
        for i, w in enumerate((text or "").split()):
            yield w, i


def centered(pdf: pd.DataFrame) -> pd.DataFrame:
    """For applyInPandas, of a part of a group: values less the mean of all of it."""
    return pdf.assign(centered=pdf["value"] - pdf["mean"])[["event_id", "event_type", "centered"]]


def positive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas: rows with a positive balance."""
    for pdf in batches:
        yield pdf[pdf["c_acctbal"] > 0][["c_custkey", "c_acctbal"]]
