"""Comparison of a Spark result and a pandas one, in any order."""

import numpy as np
import pandas as pd


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: str(list(v)) if isinstance(v, (list, np.ndarray)) else v)
        if str(df[c].dtype).startswith("datetime"):
            df[c] = pd.to_datetime(df[c]).astype("datetime64[us]")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)
    a, b = tidy(a), tidy(b)
    for c in a.columns:
        differs = (a[c] != b[c]) & ~(a[c].isna() & b[c].isna())
        assert not differs.any(), (c, a[differs].head(3).to_dict("records"), b[differs].head(3).to_dict("records"))
