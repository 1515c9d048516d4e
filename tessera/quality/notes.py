"""Notes: an ordered classifier and labels for identifying data."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(text: Column, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first pattern that occurs, whatever the case."""
    out = F.lit(otherwise)
    for label, pattern in reversed(rules):
        out = F.when(text.rlike(f"(?i){pattern}"), F.lit(label)).otherwise(out)
    return out


def label_identifiers(df: DataFrame, text: str, patterns: Mapping[str, str], exceptions: Mapping[str, str] | None = None, out: str = "labelled") -> DataFrame:
    """df with the text in which, line by line, every match of a named pattern stands as <name>: of the patterns that match at a place the first named one.

    A match that its name's exception matches whole stays as it is. Null texts stay null. One alternation is run over each line; what stands for a match depends on the group,
    which no built-in replacement tells, hence a vectorised function.
    """
    joined = re.compile("|".join(f"(?P<{n}>{p})" for n, p in patterns.items()))
    allowed = {n: re.compile(p) for n, p in (exceptions or {}).items()}

    def swap(m: re.Match) -> str:
        name = m.lastgroup or ""
        return m[0] if name in allowed and allowed[name].fullmatch(m[0]) else f"<{name}>"

    @F.pandas_udf("string")
    def label(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else "\n".join(joined.sub(swap, line) for line in t.split("\n")))

    return df.withColumn(out, label(F.col(text)))
