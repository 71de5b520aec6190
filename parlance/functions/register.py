"""Functions for SQL text: registered by name on a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from parlance.functions import diff, numerals
from parlance.session import ship


def register(spark: SparkSession) -> list[str]:
    """normalise_numerals(text), fuse_texts(a, b), cut_near(text, target): Arrow UDFs; and their names."""
    ship(spark)

    @F.pandas_udf("string")
    def normalise_numerals(s: pd.Series) -> pd.Series:
        return s.map(numerals.normalise)

    @F.pandas_udf("string")
    def fuse_texts(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([diff.fuse_pair(x or "", y or "", frozenset()) for x, y in zip(a, b)])

    @F.pandas_udf("int")
    def cut_near(t: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([diff.cut_near(x or "", int(y)) for x, y in zip(t, at)])

    for f in (normalise_numerals, fuse_texts, cut_near):
        spark.udf.register(f.func.__name__, f)
    return ["normalise_numerals", "fuse_texts", "cut_near"]
