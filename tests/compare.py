"""Rows of two results in one form: columns by name, rows sorted, fractions to nine digits and whole numbers exactly."""

import numbers
from decimal import Decimal

import pandas as pd


def value(v):
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return "NULL"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, numbers.Integral):
        return str(int(v))
    if isinstance(v, (numbers.Real, Decimal)):
        return str(int(v)) if v == v // 1 and abs(v) < 2**53 else f"{float(v):.9g}"
    return str(list(v) if hasattr(v, "tolist") else v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(value(v) for v in r) for r in df[cols].itertuples(index=False))
