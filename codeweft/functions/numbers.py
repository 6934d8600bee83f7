"""Numbers as text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def to_fixed(c: Column | str, digits: int = 2) -> Column:
    """The number with so many decimals, rounded on its exact binary value; Spark's own formatting rounds its shortest decimal form."""

    @F.pandas_udf("string")
    def fixed(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else f"{v:.{digits}f}")

    return fixed(F.col(c) if isinstance(c, str) else c)
