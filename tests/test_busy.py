"""Devices of few and of many flows take different ways to the same features."""

import pytest
from pyspark.sql import functions as F

from lanlore.operators import features, windows


@pytest.fixture(scope="module")
def flows(spark):
    number = F.col("id")
    return spark.range(3000).select(
        F.when(number % 3 > 0, F.lit("hub")).otherwise(F.concat(F.lit("d"), number % 40)).alias("src_ip"),
        F.when(number % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("d"), number % 57)).alias("dst_ip"),
        F.timestamp_seconds(1_600_000_200 + F.pmod(F.xxhash64("id"), F.lit(1500))).alias("timestamp"),
        F.when(number % 13 > 0, number).alias("bytes_sent"), (number % 7).alias("bytes_received"), F.when(number % 2 == 0, "ARP").otherwise("ICMP").alias("protocol"),
    )


@pytest.mark.parametrize("rows, times", [(0, 0), (100, 1)])
def test_both_ways_give_the_same(flows, monkeypatch, rows, times):
    keys = ["device_id", "time_window", "side"]
    plain = {tuple(r[k] for k in keys): r for r in features.flow_side_features(flows).collect()}
    monkeypatch.setattr(windows, "BUSY_ROWS", rows)
    monkeypatch.setattr(windows, "BUSY_TIMES", times)
    sliced = {tuple(r[k] for k in keys): r for r in features.flow_side_features(flows).collect()}
    assert sliced.keys() == plain.keys() and any(k[0] == "hub" for k in plain)
    for k, r in plain.items():
        assert all(sliced[k][c] == (pytest.approx(r[c]) if isinstance(r[c], float) else r[c]) for c in r.asDict())


def test_only_large_keys_are_busy(spark, monkeypatch):
    monkeypatch.setattr(windows, "BUSY_ROWS", 500)
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"))
    assert df.where(windows.busy(df, ["k"])).select("k").distinct().count() == 1
    assert df.where("k > 0").where(windows.busy(df.where("k > 0"), ["k"])).isEmpty()
