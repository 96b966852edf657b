"""Bundles of models, and models over streams."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from lanlore.config import Settings
from lanlore.learn import classify, fusion
from lanlore.plans import scoring, training
from lanlore.session import cut_lineage
from lanlore.sources import bundle

NAMES = ["dhcp_discover_count", "dhcp_ack_count", "dns_query_count", "dns_failure_count"]
START = 1_600_000_200
SHORT = Settings(sequence_length=3, n_clusters=2)


@pytest.fixture(scope="module")
def windows(spark):
    rows = spark.range(360).select(
        F.concat(F.lit("d"), F.col("id") % 9).alias("device_id"), F.timestamp_seconds(START + F.floor(F.col("id") / 9) * 300).alias("time_window"),
        *[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(30))).alias(c) for c in NAMES],
    )
    return cut_lineage(rows.withColumn("label", F.when(F.col("dns_failure_count") > 20, 1).when(F.col("dhcp_discover_count") > 24, 2).otherwise(0)))


@pytest.fixture(scope="module")
def models(windows):
    return training.train(windows, SHORT, trees=8)


def unlike(a, b):
    """Counts and the columns in which two tables differ, by device and window; empty if they are equal."""
    key = ["device_id", "time_window"]
    if sorted(a.columns) != sorted(b.columns) or a.count() != b.count():
        return [sorted(a.columns), sorted(b.columns), a.count(), b.count()]
    pairs = list(zip(a.orderBy(*key).collect(), b.select(a.columns).orderBy(*key).collect()))
    return [(c, [(x[c], y[c]) for x, y in pairs if x[c] != y[c]][:2]) for c in a.columns if any(x[c] != y[c] for x, y in pairs)]


def test_all_that_was_trained_comes_back(spark, windows, models, tmp_path):
    path = str(tmp_path / "b")
    assert bundle.versions(spark, path) == [] and bundle.save_bundle(spark, models, path) == 1
    fresh = spark.newSession()
    loaded = bundle.load_bundle(fresh, path)
    assert loaded.features == models.features and loaded.limits == models.limits and loaded.centres == models.centres
    assert unlike(training.predict(models, windows, SHORT), training.predict(loaded, windows, SHORT)) == []


@pytest.mark.parametrize(
    "fit",
    [
        lambda d: classify.random_forest(d, NAMES, trees=4),
        lambda d: classify.boosted(d, NAMES, rounds=2),
        lambda d: classify.Ensemble([classify.random_forest(d, NAMES, trees=4), classify.boosted(d, NAMES, rounds=2)]),
        lambda d: fusion.fit_multi_view(d, {"dhcp": NAMES[:2], "dns": NAMES[2:], "flow": []}, weighted=True, iterations=5),
    ],
)
def test_every_kind_of_classifier(spark, windows, fit, tmp_path):
    model, path = fit(windows), str(tmp_path / "b")
    bundle.save_bundle(spark, model, path)
    loaded = bundle.load_bundle(spark, path)
    assert type(loaded) is type(model) and loaded.classes == model.classes and unlike(model.score(windows), loaded.score(windows)) == []


def test_versions_and_damage(spark, windows, models, tmp_path):
    path = str(tmp_path / "b")
    one, two = classify.random_forest(windows, NAMES, trees=2), models
    assert [bundle.save_bundle(spark, m, path) for m in (one, two)] == [1, 2]
    assert isinstance(bundle.load_bundle(spark, path), training.Models) and isinstance(bundle.load_bundle(spark, path, 1), classify.Classifier)
    shutil.rmtree(f"{path}/version=2/manifest")  # as if the writer had died
    assert bundle.versions(spark, path) == [1] and isinstance(bundle.load_bundle(spark, path), classify.Classifier)
    with pytest.raises(bundle.BundleError):
        bundle.load_bundle(spark, path, 2)
    assert bundle.save_bundle(spark, models, path, version=3) == 3
    trees = f"{path}/version=3/model/anomaly/trees"
    spark.read.parquet(trees).limit(5).write.parquet(f"{path}/less")
    shutil.rmtree(trees)
    shutil.copytree(f"{path}/less", trees)
    with pytest.raises(bundle.BundleError, match="5 rows"):
        bundle.load_bundle(spark, path, 3)
    with pytest.raises(TypeError):
        bundle.save_bundle(spark, object(), str(tmp_path / "c"))


def test_a_stream_is_judged_as_its_table_also_after_a_replay(spark, windows, models, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "offsets"))
    rows = windows.drop("label")
    for k in range(4):
        low = F.timestamp_seconds(F.lit(START + k * 3000))
        rows.where((F.col("time_window") >= low) & (F.col("time_window") < F.timestamp_seconds(F.lit(START + k * 3000 + 3000)))).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    scoring.score_stream(stream(), models, out, SHORT, checkpoint, as_report=False)
    want = training.predict(models, rows, SHORT).where(F.col("time_window") <= F.timestamp_seconds(F.lit(START + 39 * 300 - 600)))
    assert len([f for f in os.listdir(out) if f.startswith("batch=")]) >= 4
    assert unlike(want, spark.read.parquet(out).drop("batch")) == []
    last = max(int(f) for f in os.listdir(f"{checkpoint}/commits") if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{f}"):
            os.remove(f"{checkpoint}/commits/{f}")
    scoring.score_stream(stream(), models, out, SHORT, checkpoint, as_report=False)
    assert unlike(want, spark.read.parquet(out).drop("batch")) == []


def test_reports_of_a_stream(spark, windows, models, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    windows.drop("label").write.parquet(folder)
    scoring.score_stream(spark.readStream.schema(windows.drop("label").schema).parquet(folder), models, out, SHORT)
    report = spark.read.parquet(out)
    assert {"device_id", "time_window", "misconfig_label", "explanation"} <= set(report.columns) and report.count() > 0


def test_halves_of_a_stream_are_many_files_and_two_batches(spark, windows, tmp_path):
    from lanlore.queries.whole import write_halves

    rows, folder = windows.drop("label"), str(tmp_path / "in")
    assert write_halves(rows, str(tmp_path / "one")) == 1
    files = write_halves(rows, folder, rows_per_task=50)
    assert files == 3 and len([f for f in os.listdir(folder) if f.endswith(".parquet")]) == 2 * files
    seen = []
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)
    note = lambda batch, _: seen.append(tuple(batch.agg(F.count("*"), F.min("time_window"), F.max("time_window")).first()))
    stream.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start().awaitTermination()
    assert [n for n, *_ in seen] == [180, 180] and seen[0][2] < seen[1][1]
