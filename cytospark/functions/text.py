"""Numbers as text, rounded half to even on their exact value. Spark's own formatting rounds half up on the shortest decimal,
so that doubles go through Python in Arrow batches; this is used in the sinks only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int, width: int = 0) -> Column:
    """A double with so many decimals, padded on the left."""

    @F.pandas_udf("string")
    def told(x: pd.Series) -> pd.Series:
        return x.map(lambda v: format(v, f"{width}.{digits}f"))

    return told(value)


def exact_percentage(m: Column, n: Column, digits: int = 6) -> Column:
    """100 m / n with so many decimals, half to even, by integers: no float takes part."""
    scaled = m.cast("decimal(20,0)") * 100 * 10**digits
    n = n.cast("decimal(20,0)")
    whole, rest = F.floor(scaled / n), scaled % n
    whole = ((scaled - rest) / n).cast("decimal(38,0)")
    up = (rest * 2 > n) | ((rest * 2 == n) & (whole % 2 == 1))
    rounded = F.when(up, whole + 1).otherwise(whole).cast("decimal(38,0)")
    part = (rounded % 10**digits).cast("decimal(20,0)")
    return F.concat(((rounded - part) / 10**digits).cast("decimal(38,0)").cast("string"), F.lit("."), F.lpad(part.cast("string"), digits, "0"))
