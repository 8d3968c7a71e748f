"""Canonical JSON and digests."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def canonical_json(lines: pd.Series) -> pd.Series:
    """Object with sorted keys, tight separators and ASCII escapes; null when the text is not a JSON object."""

    def one(line):
        try:
            value = json.loads(line)
        except (TypeError, ValueError):
            return None
        if not isinstance(value, dict):
            return None
        return json.dumps(value, sort_keys=True, separators=(",", ":"))

    return lines.map(one)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def node_hash(left: Column, right: Column) -> Column:
    """Parent digest of two hex digests, over their bytes."""
    return F.sha2(F.unhex(F.concat(left, right)), 256)
