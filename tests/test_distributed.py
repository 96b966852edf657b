"""The sliced, blocked and iterated algorithms against plain loops, with hot keys in the data."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanlore.learn import clusters, isolation
from lanlore.operators import balance, summary
from lanlore.operators.evaluate import average_precision, best_threshold, pr_curve, roc_auc, tune_class
from lanlore.operators.intervals import event_intervals, label_by_intervals, merge_intervals, pair_markers
from lanlore.operators.knn import nearest
from lanlore.operators.running import percentiles, quantile_slice, ranked, running
from lanlore.operators.windows import gap_statistics

from .conftest import rows


def test_running_sum_and_max(spark):
    rng = random.Random(1)
    data = [(rng.choice(["hot", "hot", "cold"]), rng.random(), rng.randint(-5, 5)) for _ in range(3000)]
    df = quantile_slice(spark.createDataFrame(data, "k string, x double, v long"), "x")
    got = running(df, {"s": "v"}, order=["x"], by=["k"])
    top = running(df, {"m": "v"}, order=["x"], by=["k"], func=F.max, inclusive=False)
    down = running(df, {"d": "v"}, order=[F.desc("x")], by=["k"], slice_descending=True)
    want_s, want_m, want_d = {}, {}, {}
    for key in ("hot", "cold"):
        mine = sorted((x, v) for k, x, v in data if k == key)
        total, best = 0, None
        for x, v in mine:
            want_m[(key, x)] = best
            total += v
            want_s[(key, x)] = total
            best = v if best is None else max(best, v)
        for x, v in mine:
            want_d[(key, x)] = total - want_s[(key, x)] + v
    assert {(r["k"], r["x"]): r["s"] for r in got.collect()} == want_s
    assert {(r["k"], r["x"]): r["m"] for r in top.collect()} == want_m
    assert {(r["k"], r["x"]): r["d"] for r in down.collect()} == want_d


def test_ranks_are_a_permutation_and_repeatable(spark):
    df = spark.range(5000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    a = {r["id"]: (r["label"], r["r"]) for r in ranked(df, "r", by=["label"], keys=["id"]).collect()}
    b = {r["id"]: (r["label"], r["r"]) for r in ranked(df.repartition(13), "r", by=["label"], keys=["id"]).collect()}
    assert a == b
    for label, n in ((0, 4500), (1, 500)):
        assert sorted(r for l, r in a.values() if l == label) == list(range(n))
    by_value = {r["id"]: r["r"] for r in ranked(df, "r", order="id").collect()}
    assert by_value == {i: i for i in range(5000)}


def test_percentiles_match_numpy_with_a_hot_value(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.full(700, 0.25), rng.random(1301)])
    df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(values)], "x double, g int")
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    assert percentiles(df, "x", probs).first()[0] == pytest.approx(np.percentile(values, [100 * p for p in probs]))
    for r in percentiles(df, "x", probs, by=["g"]).collect():
        assert r["percentiles"] == pytest.approx(np.percentile(values[r["g"] :: 2], [100 * p for p in probs]))


def test_gaps_over_slices(spark):
    rng = random.Random(5)
    times = sorted({rng.randrange(0, 3_000) for _ in range(400)})
    data = [("a", t) for t in times for _ in range(3)] + [("b", 7), ("b", 7)]
    df = spark.createDataFrame(data, "k string, t long").select("k", F.timestamp_seconds("t").alias("ts"))
    gaps = np.diff(times).astype(float)
    for width in (10.0, 100.0, 100_000.0):
        got = {r["k"]: r for r in gap_statistics(df, ["k"], "ts", width).collect()}
        assert got["a"]["mean_inter_arrival_time"] == pytest.approx(gaps.mean())
        assert got["a"]["var_inter_arrival_time"] == pytest.approx(gaps.var(ddof=1))
        assert (got["b"]["mean_inter_arrival_time"], got["b"]["var_inter_arrival_time"]) == (0.0, 0.0)


def plain_pairs(marks):
    """START opens an interval, END closes the latest one; open ones are left out."""
    open_list = []
    for _, kind, t in marks:
        if kind == "S":
            open_list.append([t, None])
        elif kind == "E" and open_list:
            open_list[-1][1] = t
    return sorted((a, b) for a, b in open_list if b is not None)


@pytest.mark.parametrize("seed", range(5))
def test_marker_pairing(spark, seed):
    rng = random.Random(seed)
    marks = [(i, rng.choice("SEEX"), 10.0 * i) for i in range(60)]
    df = spark.createDataFrame(marks, "line_no int, kind string, t double")
    got = pair_markers(df, F.col("kind") == "S", F.col("kind") == "E", "t", "line_no", slice_by=F.floor(F.col("line_no") / 7))
    assert sorted((r["start"], r["end"]) for r in got.collect()) == plain_pairs(marks)


LOG = """[5.0 -- x] [BAD-MISCONF-END] end without start
[10.0 -- x] [BAD-MISCONF-START] left: 10.0.0.1 --> 10.0.0.9

[20.0 -- x] [BAD-MISCONF-END] done
[25.0 -- x] [BAD-MISCONF-END] done again
[30.0 -- x] INFO BAD-MISCONF-START left: 1.1.1.1 --> 2.2.2.2
[40.0 -- x] [BAD-MISCONF-START] details missing
[50.0 -- x] [BAD-MISCONF-END] moves the earlier end
no stamp [BAD-MISCONF-START] left: 1.1.1.1 --> 2.2.2.2
[60.0 -- x] [BAD-MISCONF-DUPLICATION-START] hub|centre(phy) will be given ip 198.18.134.6 (same as bottom)
[70.0 -- x] [BAD-MISCONF-DUPLICATION-END] done
[80.0 -- x] [BAD-MISCONF-START] right: 10.0.0.2 --> 10.0.0.8"""


def test_event_file(spark):
    lines = spark.createDataFrame(list(enumerate(LOG.split("\n"))), "line_no int, line string")
    got = {r["type"]: r for r in event_intervals(lines).collect()}
    assert (got["invalid_ip"]["device"], got["invalid_ip"]["start"], got["invalid_ip"]["end"]) == ("left", 10.0, 50.0)
    assert (got["invalid_ip"]["old_ip"], got["invalid_ip"]["new_ip"]) == ("10.0.0.1", "10.0.0.9")
    duplicate = got["duplicate_ip"]
    assert (duplicate["device"], duplicate["ip"], duplicate["start"], duplicate["end"]) == ("unknown", "198.18.134.6", 60.0, 70.0)
    assert event_intervals(lines, strict=True).where("type = 'invalid_ip'").first()["end"] == 25.0


def test_merge_and_label(spark):
    rng = random.Random(9)
    spans = [(float(a), float(a + rng.randint(0, 40))) for a in (rng.randint(0, 2000) for _ in range(80))] + [(100.0, 900.0)] * 40
    iv = spark.createDataFrame(spans, "start double, end double")
    merged = sorted((r["start"], r["end"]) for r in merge_intervals(iv).collect())
    assert all(a[1] < b[0] for a, b in zip(merged, merged[1:]))
    flows = spark.createDataFrame([(i, i / 2) for i in range(4200)] + [(9999, None)], "id int, ts double")
    got = {r["id"]: r["label"] for r in label_by_intervals(flows, iv, "ts", bucket_seconds=50).collect()}
    want = {i: 2 if any(a <= i / 2 <= b for a, b in spans) else 0 for i in range(4200)}
    assert got == {**want, 9999: 0}


def scored(spark, n=400, seed=2):
    rng = random.Random(seed)
    return [(i, int(rng.random() < 0.3), rng.choice([0.5, round(rng.random(), 2)])) for i in range(n)]


def plain_curve(data):
    positives = sum(y for _, y, _ in data)
    out = []
    for t in sorted({s for *_, s in data}):
        tp, n = sum(y for _, y, s in data if s >= t), sum(1 for *_, s in data if s >= t)
        out.append((t, tp / n, tp / positives))
    return out


def test_curve_and_its_areas(spark):
    data = scored(spark)
    df = spark.createDataFrame(data, "id int, y int, s double")
    want = plain_curve(data)
    got = sorted((r["threshold"], r["precision"], r["recall"]) for r in pr_curve(df, "y", "s").collect())
    assert np.allclose(np.array(got), np.array(want))
    pos, neg = [s for _, y, s in data if y], [s for _, y, s in data if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert roc_auc(df, "y", "s").first()[0] == pytest.approx(auc)
    down = sorted(want, reverse=True)
    ap = sum((r - (down[i - 1][2] if i else 0)) * p for i, (_, p, r) in enumerate(down))
    assert average_precision(df, "y", "s").first()[0] == pytest.approx(ap)


@pytest.mark.parametrize("metric", ["f1", "precision", "recall", "balanced_f1"])
def test_threshold_choice(spark, metric):
    data = scored(spark)
    points = plain_curve(data) + [(None, 1.0, 0.0)]
    value = {
        "f1": lambda p, r: 2 * p * r / (p + r + 1e-10),
        "precision": lambda p, r: p if r > 0.1 else -1,
        "recall": lambda p, r: r if p > 0.1 else -1,
        "balanced_f1": lambda p, r: 0.5 * p + 0.5 * r,
    }[metric]
    best = max(range(len(points)), key=lambda i: (value(points[i][1], points[i][2]), -i))
    want = points[min(best, len(points) - 2)][0]
    df = spark.createDataFrame(data, "id int, y int, s double")
    assert best_threshold(df, "y", "s", metric=metric).first()["threshold"] == want


def test_threshold_end_point_is_clipped_to_the_last(spark):
    df = spark.createDataFrame([(0, 0.9), (1, 0.1)] + [(0, 0.5)] * 20, "y int, s double")
    assert best_threshold(df, "y", "s", metric="balanced_f1").first()["threshold"] == 0.1
    none = spark.createDataFrame([(0, 0.9), (0, 0.1)], "y int, s double")
    assert best_threshold(none, "y", "s", metric="recall").first()["threshold"] == 0.9
    assert tuple(tune_class(df, "y", "s", 0).first())[1:3] == pytest.approx((21 / 22, 1.0))


def cloud(n=300, dims=3, copies=120, seed=4):
    rng = np.random.default_rng(seed)
    points = np.concatenate([rng.normal(size=(n, dims)), np.repeat([[0.1] * dims], copies, axis=0)])
    return [(int(i), [float(x) for x in p], int(rng.integers(0, 2))) for i, p in enumerate(points)]


@pytest.mark.parametrize("block", [16_384, 40])
def test_neighbours_match_brute_force_with_many_copies(spark, block):
    data = cloud()
    df = spark.createDataFrame(data, "id long, features array<double>, label int")
    x = np.array([v for _, v, _ in data])
    got = {r["id"]: [(n["id"], n["payload"]) for n in r["neighbors"]] for r in nearest(df, df, 4, payload="label", block_points=block).collect()}
    for i in range(len(data)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((np.arange(len(d)), d)) if j != i][:4]
        assert got[i] == [(int(j), data[j][2]) for j in order]


@pytest.mark.parametrize("block", [16_384, 40])
def test_density_clusters_match_brute_force(spark, block):
    data = cloud(n=250, dims=2, copies=60)
    df = spark.createDataFrame(data, "id long, scaled array<double>, label int")
    x = np.array([v for _, v, _ in data])
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= 0.25
    core = near.sum(axis=1) >= 5
    label = np.where(core, np.arange(len(x)), len(x))
    while True:
        spread = np.array([min([label[i]] + [label[j] for j in np.flatnonzero(near[i] & core)]) if core[i] else label[i] for i in range(len(x))])
        if (spread == label).all():
            break
        label = spread
    want = {}
    for i in range(len(x)):
        reach = [label[j] for j in np.flatnonzero(near[i] & core)]
        want[i] = (int(min(reach)) if reach else -1, bool(core[i]))
    got = {r["id"]: (r["cluster"], r["core"]) for r in clusters.dbscan(df, eps=0.25, min_points=5, block_points=block).collect()}
    assert got == want and len({c for c, _ in want.values()}) > 2


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(100)] + [(500, 501), (502, 501)]
    random.Random(1).shuffle(links)
    got = dict(rows(clusters.connected_components(spark.createDataFrame(links, "a long, b long"))))
    assert all(got[i] == 0 for i in range(1, 101)) and got[501] == 500 and got[502] == 500


def unbalanced(spark, minority=30, majority=140):
    rng = np.random.default_rng(8)
    data = [(i, f"dev{i}", *map(float, rng.normal(size=2)), 0) for i in range(majority)]
    data += [(1000 + i, f"dev{1000 + i}", *map(float, rng.normal(size=2) + 1.0), 2) for i in range(minority)]
    return spark.createDataFrame(data, "key long, device_id string, a double, b double, label int")


def test_smote_rows_lie_between_their_parents(spark):
    df = unbalanced(spark)
    out = balance.smote(df, ["a", "b"], "key").collect()
    made = [r for r in out if r["synthetic"]]
    assert len(made) == 110 and all(r["label"] == 2 and r["device_id"].endswith("_synthetic") for r in made)
    parents = {r["key"]: np.array([r["a"], r["b"]]) for r in out if not r["synthetic"] and r["label"] == 2}
    for r in made:
        seed, x = parents[r["key"]], np.array([r["a"], r["b"]])
        others = sorted((np.linalg.norm(p - seed), k) for k, p in parents.items() if k != r["key"])[:3]
        steps = [np.linalg.norm(x - seed) + np.linalg.norm(parents[k] - x) - d for d, k in others]
        assert min(steps) < 1e-9
    again = balance.smote(df.repartition(5), ["a", "b"], "key").collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, out), key=str)


def test_strategies_and_methods(spark):
    assert balance.needed({0: 100, 1: 40, 2: 10}) == {1: 60, 2: 90}
    assert balance.needed({0: 100, 1: 40, 2: 10}, "minority") == {2: 90}
    assert balance.needed({0: 100, 1: 40, 2: 10}, 0.3) == {2: 20}
    assert balance.needed({0: 100, 1: 40}, {1: 50}) == {1: 10}
    df = unbalanced(spark)
    counts = lambda d: {r[0]: r[1] for r in d.groupBy("label").count().collect()}
    assert counts(balance.undersample(df, "key")) == {0: 30, 2: 30}
    assert balance.choose_method(df) == "smote"
    few = unbalanced(spark, minority=15)
    assert counts(balance.balance(few, ["a", "b"], "key")) == {0: 140, 2: 140}
    with pytest.raises(ValueError):
        balance.balance(few, ["a", "b"], "key", "unheard of")
    repeated = balance.balance(few, ["a", "b"], "key", "repeated_undersample")
    assert counts(repeated) == {0: 9 * 15, 2: 9 * 15}
    assert repeated.where("label = 0").select("key").distinct().count() == 9 * 15
    grown = counts(balance.adasyn(df, ["a", "b"], "key"))
    assert grown[0] == 140 and 100 < grown[2] < 180
    split = balance.stratified_split(df, "key")
    assert {r[0]: r[1] for r in split.where("is_test").groupBy("label").count().collect()} == {0: 28, 2: 6}


def test_isolation_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(0)
    data = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(400)] + [(1000, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(data, "id long, features array<double>")
    forest = isolation.fit_isolation_forest(df.where("id < 1000"), "id", trees=50)
    got = {r["id"]: r for r in forest.score(df).collect()}
    assert got[1000]["anomaly"] == -1 and got[1000]["anomaly_score"] == min(r["anomaly_score"] for r in got.values())
    flagged = sum(r["anomaly"] == -1 for k, r in got.items() if k < 1000)
    assert 10 <= flagged <= 20


def test_null_keys_are_keys(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2, i % 3) for i in range(20)], "key long, label int, x int")
    assert ranked(df, "r", by=["label"], keys=["key"]).groupBy("label").count().count() == 3
    assert ranked(df, "r", by=["label"], order="x", keys=["key"]).count() == 20
    split = balance.stratified_split(df, "key")
    assert split.count() == 20 and split.where("label IS NULL AND is_test").count() == 0
    assert percentiles(df, "x", [0.5], by=["label"]).count() == 3
    weighted = summary.with_class_weight(df)
    assert weighted.count() == 20 and weighted.where("label IS NULL AND weight IS NOT NULL").count() == 0
    assert balance.repeated_undersample(df, "key").where("label IS NULL").count() == 0
    assert balance.undersample(df, "key").groupBy("label").count().select("count").distinct().count() == 1


def test_sweep_labels_as_plain_loops(spark):
    from lanlore.operators.intervals import label_by_sweep

    rng = random.Random(8)
    spans = [(rng.choice(["a", "b", None]), s, s + rng.choice([0, 3, 40])) for s in (rng.randint(0, 1000) for _ in range(400))] + [("a", 5, 2), ("b", 900, 10**9)]
    flows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *[rng.randint(0, 1200)] * 20]), -1) for i in range(1500)]
    f = spark.createDataFrame(flows, "id int, dev string, ts long, label int").repartition(5)
    iv = spark.createDataFrame(spans, "dev string, start long, end long")
    for by in (["dev"], []):
        got = {r["id"]: (r["dev"], r["ts"], r["label"]) for r in label_by_sweep(f, iv, "ts", by).collect()}
        want = {i: (d, t, 2 if t is not None and any(s <= t <= e and (not by or (d is not None and d == k)) for k, s, e in spans) else 0) for i, d, t, _ in flows}
        assert got == want


def test_each_tree_sees_the_rows_of_its_smallest_hashes(spark):
    import numpy as np

    from lanlore.learn import isolation

    rows = spark.range(3000).select(F.col("id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("features"))
    hashes = np.array([r[0] for r in rows.orderBy("id").select(F.xxhash64("id", F.lit(7))).collect()], np.int64).view(np.uint64)
    for parts in (1, 6):
        got = {}
        for r in isolation.draw_samples(rows.repartition(parts), "id", "features", 5, 40, 7).collect():
            got.setdefault(r["tree"], set()).add(int(r["x"][0]))
        assert got == {t: set(np.argsort(isolation._mixed(hashes, t))[:40].tolist()) for t in range(5)}
