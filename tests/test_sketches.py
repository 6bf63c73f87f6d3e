import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from washline.operators import history

START = datetime.datetime(2024, 3, 1)


def runs(spark, n, seed):
    rng = np.random.default_rng(seed)
    at = [START + datetime.timedelta(seconds=int(s)) for s in rng.integers(0, 2 * 86_400, n)]
    return spark.createDataFrame(list(zip(at, rng.lognormal(1, 2, n).tolist())), "ts timestamp_ntz, took double")


@pytest.mark.parametrize("p", [0.0, 0.5, 0.95, 1.0])
def test_appended_sketches_give_the_percentiles_of_all_runs(spark, tmp_path, p):
    parts = [runs(spark, n, i) for i, n in enumerate((4_000, 9_000, 100))]
    path = str(tmp_path / "sketches")
    for part in parts:
        history.latency_sketches(part, "ts", "took").write.mode("append").parquet(path)
    found = history.sketched_latency(history.merged_sketches(spark.read.parquet(path), "1 day"), p=p).collect()
    rows = [r for part in parts for r in part.collect()]
    assert sum(r.runs for r in found) == len(rows) and len(found) == 2
    for r in found:
        day = np.sort([x.took for x in rows if x.ts.date() == r.window_start.date()])
        assert r.runs == len(day) and np.isclose(r.avg_duration, day.mean())
        value = r[f"p{round(p * 100)}_duration"]
        assert (day < value).mean() - 0.006 <= p <= (day <= value).mean() + 0.006


def test_small_windows_are_exact_and_empty_ones_have_no_percentile(spark):
    at = [START, START, START, START + datetime.timedelta(hours=1), START + datetime.timedelta(hours=2), None]
    took = [3.0, 1.0, None, None, float("nan"), 5.0]
    df = spark.createDataFrame(list(zip(at, took)), "ts timestamp_ntz, took double")
    sketches = history.latency_sketches(df.where("ts is not null"), "ts", "took")
    hours = {r.window_start.hour: (r.runs, r.avg_duration, r.p50_duration) for r in history.sketched_latency(sketches, p=0.5).collect()}
    assert hours == {0: (2, 2.0, 1.0), 1: (0, None, None), 2: (0, None, None)}
    (day,) = history.sketched_latency(history.merged_sketches(sketches, "1 day"), p=1.0).collect()
    assert (day.runs, day.avg_duration, day.p100_duration) == (2, 2.0, 3.0)


def test_no_runs(spark):
    df = spark.createDataFrame([], "ts timestamp_ntz, took double")
    merged = history.merged_sketches(history.latency_sketches(df, "ts", "took"), "1 day")
    assert history.sketched_latency(merged).select(F.count("*")).first()[0] == 0
