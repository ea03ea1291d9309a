"""Accent folding: NFKD without combining marks, in Arrow batches (Spark has no built-in for it)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_text(text: str | None) -> str | None:
    return None if text is None else " ".join("".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c)).split())


def fold(text: Column | str) -> Column:
    """Lower case, accents off, white space collapsed."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(fold_text)

    return F.pandas_udf(run, "string")(text)
