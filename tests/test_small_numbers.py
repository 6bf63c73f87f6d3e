import pandas as pd
import pytest
from pyspark.sql import functions as F

from washline.operators.statistics import column_facts, moments


@pytest.mark.parametrize("peak", [1.0, 1e-13, 9.1e-29, 9.1e-31, 1.7e-35, 1e-120, 1e-300])
def test_skewness_does_not_depend_on_the_unit(spark, peak):
    shares = [0.01, 0.02, -0.03, 0.02, 0.5, 1.0, None, 0.1]
    rows = [(None if x is None else x * peak, None if x is None else x * 4, peak) for x in shares]
    df = spark.createDataFrame(rows, "tiny double, plain double, same double")
    numbers = {c: F.col(c) for c in df.columns}
    wanted = pd.Series(shares).skew()
    for found in (moments(df, df.columns), column_facts(df, {c: F.xxhash64(c) for c in df.columns}, numbers)[3]):
        assert found["tiny"].skew == pytest.approx(wanted, abs=1e-9)
        assert found["plain"].skew == pytest.approx(wanted, abs=1e-9) and found["same"].skew == 0
        assert found["tiny"].n == 7 and found["tiny"].high == peak
