"""JSON objects inside prose."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F

_DECODER = json.JSONDecoder()


def find_object(text: str | None) -> str | None:
    """The first JSON object in a text that is not empty, as it stands; candidates that don't parse are skipped."""
    at = (text or "").find("{")
    while at >= 0:
        try:
            value, end = _DECODER.raw_decode(text, at)
        except ValueError:
            end = at + 1
        else:
            if value:
                return text[at:end]
        at = text.find("{", end)
    return None


def first_object(response: Column) -> Column:
    """``find_object`` over a column of responses."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(find_object, na_action="ignore").astype(object).where(lambda s: s.notna(), None)

    return run(response)
