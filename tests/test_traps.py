"""Where pandas and Spark disagree, and where the semantics have sharp edges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lanlore.functions.columns import add_aliases, fill_numeric, nan_to_null, to_instant, to_number, to_whole
from lanlore.functions.times import floor_to
from lanlore.operators import features, fuse, rules, summary
from lanlore.operators.explain import long_explanation, report, short_explanation
from lanlore.operators.project import align_features, connections_to_flows, packets_to_flows, raw_as_aggregates

from .conftest import rows

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_nan_never_fires_a_rule(spark):
    df = spark.createDataFrame([(float("nan"), 20)], "dns_failure_ratio double, dns_query_count int")
    assert rules.detect(df).first()["predicted_label"] == 1  # NaN sorts above everything in Spark
    assert rules.detect(nan_to_null(df)).first()["predicted_label"] == 0


def test_dns_null_code_is_failure_and_null_domain_is_a_category(spark):
    log = spark.createDataFrame(
        [(at(0), "d", "a", "NOERROR"), (at(1), "d", None, None), (at(2), "d", None, "NXDOMAIN"), (at(3), None, "x", "NOERROR"), (None, "d", "x", "NOERROR")],
        "timestamp timestamp, device_id string, query_domain string, response_code string",
    )
    got = features.dns_features(log).first()
    assert (got["dns_query_count"], got["dns_success_count"], got["dns_failure_count"], got["dns_nxdomain_count"]) == (3, 1, 1, 1)
    assert got["num_unique_domains"] == 2
    assert got["entropy_of_domains"] == pytest.approx(0.9182958)
    assert got["mean_response_time"] == 0.0


def test_dhcp_ratio_can_exceed_one_and_is_zero_without_requests(spark):
    log = spark.createDataFrame(
        [(at(0), "a", "DISCOVER"), (at(1), "a", "DISCOVER"), (at(2), "a", "REQUEST"), (at(3), "b", "ACK"), (at(4), "b", "OTHER")],
        "timestamp timestamp, device_id string, message_type string",
    )
    got = {r["device_id"]: r for r in features.dhcp_features(log).collect()}
    assert got["a"]["failed_lease_ratio"] == 3.0
    assert got["b"]["failed_lease_ratio"] == 0.0 and got["b"]["dhcp_total_count"] == 2


def flow_log(spark):
    return spark.createDataFrame(
        [
            (at(0), "a", "x", 50, 5, "TCP"),
            (at(10), "a", "10.0.0.255", 50, 5, "ARP"),
            (at(10), "a", "y", 500, 5, "ICMP"),
            (at(40), "a", None, 500, 5, "TCP"),
            (at(400), "b", "a", 7, 1, "TCP"),
            (at(50), "b", "a", 9, 1, "TCP"),
        ],
        "timestamp timestamp, src_ip string, dst_ip string, bytes_sent long, bytes_received long, protocol string",
    )


def test_flow_features_by_hand(spark):
    got = {(r["device_id"], r["time_window"]): r for r in features.flow_features(flow_log(spark)).collect()}
    a = got[("a", T0)]
    assert (a["bytes_out"], a["flows_out"], a["bytes_dst"], a["flows_in"]) == (1100, 4, 9, 1)
    # gaps of the source side: 10 and 30 seconds; the destination side has none and counts as 0
    assert a["mean_inter_arrival_time"] == pytest.approx((20 + 0) / 2)
    assert a["var_inter_arrival_time"] == pytest.approx((200 + 0) / 2)
    assert a["arp_request_count"] == 2 and a["icmp_unreachable_count"] == 1
    assert a["broadcast_packet_ratio"] == pytest.approx((0.25 + 0) / 2)
    assert a["num_distinct_gateways"] == pytest.approx((3 + 1) / 2)
    wide = {(r["device_id"], r["time_window"]): r for r in features.flow_features(flow_log(spark), gateway_agg="max").collect()}
    assert wide[("a", T0)]["num_distinct_gateways"] == 3
    assert got[("a", at(300))]["flows_in"] == 1 and got[("a", at(300))]["bytes_out"] == 0


def test_single_gap_has_no_variance(spark):
    log = spark.createDataFrame([(at(0), "a", "x", 1, 1, "T"), (at(9), "a", "x", 1, 1, "T")], flow_log(spark).schema)
    side = {r["side"]: r for r in features.flow_side_features(log).collect()}
    assert side["src"]["mean_inter_arrival_time"] == 9.0 and side["src"]["var_inter_arrival_time"] is None


def test_dataset_features_keep_null_keys_and_take_the_earliest_label(spark):
    flows = spark.createDataFrame(
        [("a", at(5), 10, 1), ("a", at(1), 20, 2), (None, at(2), 5, 0), ("b", None, 7, 1)],
        "device_id string, timestamp timestamp, orig_bytes long, label int",
    )
    got = {(r["device_id"], r["time_window"]): r for r in features.window_aggregates(flows).collect()}
    assert len(got) == 3
    assert got[("a", T0)]["label"] == 2 and got[("a", T0)]["orig_bytes_sum"] == 30
    assert got[(None, T0)]["orig_bytes_sum"] == 5 and got[("b", None)]["orig_bytes_count"] == 1


def test_sum_of_nulls_is_zero(spark):
    flows = spark.createDataFrame([("a", T0, None)], "device_id string, timestamp timestamp, orig_bytes long")
    got = features.window_aggregates(flows).first()
    assert got["orig_bytes_sum"] == 0 and got["orig_bytes_mean"] == 0.0 and got["orig_bytes_count"] == 0


def test_mode_tie_takes_the_smallest(spark):
    flows = spark.createDataFrame([("a", T0, 17), ("a", T0, 6), ("a", T0, 17), ("a", T0, 6)], "device_id string, timestamp timestamp, proto int")
    assert features.window_aggregates(flows, proto="proto").first()["proto_mode"] == 6


def test_label_mode_prefers_nonzero(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("a", 3), ("a", 2), ("b", 0)], "device_id string, label int")
    assert rows(summary.label_mode(df, ["device_id"]), "device_id") == [("a", 2), ("b", 0)]


def test_coercion(spark):
    df = spark.createDataFrame([("12.7",), ("-",), (None,), ("nan",)], "x string")
    assert [r[0] for r in df.select(to_number(F.col("x"))).collect()] == [12.7, 0.0, 0.0, 0.0]
    assert [r[0] for r in df.select(to_whole(F.col("x"))).collect()] == [12, 0, 0, 0]
    times = spark.createDataFrame([("2024-01-01 10:00:00", 1704103200.25), ("bad", None)], "t string, u double")
    got = times.select(to_instant(times, "t"), to_instant(times, "u")).collect()
    assert got[0][0] == T0 and got[0][1] == T0 + dt.timedelta(microseconds=250000) and got[1][0] is None and got[1][1] is None


def test_floor_before_the_epoch(spark):
    df = spark.sql("SELECT timestamp'1969-12-31 23:58:00' AS t")
    assert df.select(floor_to(F.col("t"), 300).alias("w")).first()["w"] == dt.datetime(1969, 12, 31, 23, 55)


def test_aliases_do_not_overwrite(spark):
    df = spark.createDataFrame([(1, 2, 3)], "sIPs int, orig_ip int, start int")
    out = add_aliases(df, {"sIPs": "orig_ip", "start": "timestamp"})
    assert out.columns == ["sIPs", "orig_ip", "start", "timestamp"] and out.first()["orig_ip"] == 2


def test_fill_leaves_text_alone(spark):
    df = spark.createDataFrame([(None, float("nan"), None)], "a int, b double, c string")
    assert tuple(fill_numeric(df).first()) == (0, 0.0, None)


def test_fusion_matches_null_keys_and_keeps_labels(spark):
    a = spark.createDataFrame([("d", T0, 3), (None, T0, 1)], "device_id string, time_window timestamp, dhcp_n int")
    b = spark.createDataFrame([("d", T0, 0.5, 2), (None, T0, 0.1, 1), ("e", T0, 0.2, None)], "device_id string, time_window timestamp, dns_r double, label int")
    got = rows(fuse.fuse(a, b).select("device_id", "dhcp_n", "dns_r", "label"), "dns_r")
    assert got == [(None, 1, 0.1, 1), ("e", 0, 0.2, None), ("d", 3, 0.5, 2)]


def test_missing_devices_counts_null_as_a_device(spark):
    before = spark.createDataFrame([("a",), (None,), ("b",)], "device_id string")
    assert rows(fuse.missing_keys(before, before.where("device_id = 'a'")), "device_id") == [(None,), ("b",)]
    assert fuse.missing_keys(before, before).count() == 0


def test_feature_groups():
    groups = fuse.feature_groups(["dhcp_ack_count", "lease_renew_count", "dns_query_count", "entropy_of_domains", "bytes_out", "orig_bytes_sum", "x"])
    assert groups == {"dhcp": ["dhcp_ack_count", "lease_renew_count"], "dns": ["dns_query_count", "entropy_of_domains"], "flow": ["bytes_out", "orig_bytes_sum"]}


COUNTS = "dhcp_discover_count int, dhcp_ack_count int, dns_query_count int, dns_failure_count int, dns_failure_ratio double, arp_request_count int, broadcast_packet_ratio double, num_distinct_gateways int"


@pytest.mark.parametrize(
    "values, first, pseudo, grade, sure",
    [
        ((11, 5, 10, 6, 0.6, 60, 0.0, 4), 2, 1, 2, 0.75 + 0.15 * 0.55),
        ((11, 5, 10, 8, 0.8, 0, 0.0, 0), 2, 1, 1, 0.86),
        ((10, 0, 5, 5, 1.0, 50, 0.3, 3), 0, 0, 0, 0.85),
        ((0, 0, 6, 4, 2 / 3, 0, 0.0, 0), 1, 1, 1, 0.7 + 0.2 * 2 / 3),
        ((0, 0, 0, 0, 0.0, 21, 0.31, 4), 4, 3, 3, 0.80),
        ((0, 0, 0, 0, 0.0, 200, 0.0, 0), 4, 4, 4, 0.90),
    ],
)
def test_rule_sets(spark, values, first, pseudo, grade, sure):
    df = spark.createDataFrame([values], COUNTS)
    assert rules.detect(df).first()["predicted_label"] == first
    assert rules.pseudo_labels(df).first()["label"] == pseudo
    got = rules.graded(df).first()
    assert got["rule_prediction"] == grade and got["rule_confidence"] == pytest.approx(sure)


@pytest.mark.parametrize(
    "r, rc, m, mc, label, confidence, method",
    [
        (2, 0.82, 0, 0.5, 2, 0.82, "rule_based_override"),
        (4, 0.83, 0, 0.5, 0, 0.83 * 0.4 + 0.5 * 0.6, "weighted_average"),
        (0, 0.85, 0, 0.9, 0, 0.95, "combined_agreement"),
        (1, 0.8, 0, 0.9, 1, 0.72, "rule_based_preferred"),
        (3, 0.6, 0, 0.9, 0, 0.9, "ml_preferred"),
        (1, 0.75, 0, 0.65, 1, 0.75, "weighted_rule_based"),
        (3, 0.8, 0, 0.65, 0, 0.65, "weighted_ml"),
    ],
)
def test_hybrid_table(spark, r, rc, m, mc, label, confidence, method):
    df = spark.createDataFrame([(r, rc, m, mc)], "rule_prediction int, rule_confidence double, ml_prediction int, ml_confidence double")
    got = rules.hybrid(df).first()
    assert (got["prediction"], got["method"]) == (label, method) and got["confidence"] == pytest.approx(confidence)


def test_explanations(spark):
    df = spark.createDataFrame([("d", 2, 0.9, 12, 1, 0.0, 500)], "device_id string, prediction int, confidence double, dhcp_discover_count int, dhcp_ack_count int, failed_lease_ratio double, flow_bytes_out_sum int")
    text = df.select(long_explanation(df).alias("t")).first()["t"]
    assert text == (
        "Detected: DHCP Misconfiguration (confidence: 0.90) | Excessive DHCP DISCOVER messages: 12 | "
        "Device not receiving DHCP ACK responses | Likely cause: Device not getting valid IP lease from DHCP server"
    )
    short = df.select(short_explanation(df).alias("t")).first()["t"]
    assert short.startswith("DHCP Misconfiguration detected (confidence: 90.0%).") and short.endswith("Very low outbound traffic detected.")
    assert report(df).first()["misconfig_type"] == "DHCP Misconfiguration"
    odd = spark.createDataFrame([(-1, 0.3, 1.5, None), (0, 0.5, None, None)], "prediction int, confidence double, e double, c double")
    got = [r[0] for r in odd.select(long_explanation(odd, reconstruction_error="e", cluster_distance="c")).collect()]
    assert "High reconstruction error: 1.5000 (unusual pattern)" in got[0] and "Far from" not in got[0]
    assert got[1] == "Detected: Normal Configuration (confidence: 0.50) | Device shows normal network behavior patterns"


def test_alignment_and_pseudo_aggregates(spark):
    raw = spark.createDataFrame([("d", "1500", 3)], "device_id string, orig_bytes string, orig_pkts int")
    out = align_features(raw_as_aggregates(raw), ["orig_bytes_count", "orig_bytes_sum", "resp_bytes_sum", "orig_pkts_sum"], keep=["device_id"])
    assert tuple(out.first()) == ("d", 1.0, 1500.0, 0.0, 3.0)
    mapped = spark.createDataFrame([(7, "x")], "flow_bytes_out_sum int, flow_count string")
    assert tuple(align_features(mapped, ["orig_bytes_sum", "orig_bytes_count"]).first()) == (7.0, 0.0)


def test_packet_and_connection_rows(spark):
    packets = spark.createDataFrame([("1.1.1.1", "bad", "60", "6"), (" ", "2024-01-01 10:00:00", "60", "6")], "`ip.src` string, `frame.time` string, `frame.len` string, `ip.proto` string")
    got = packets_to_flows(packets, default_ts="2024-01-01 10:00:00").collect()
    assert len(got) == 1 and got[0]["timestamp"] == T0 and got[0]["proto"] == 6 and got[0]["orig_bytes"] == 60
    log = spark.createDataFrame([("1.1.1.1", 1704103200.0, None, "tcp")], "`id.orig_h` string, ts double, orig_bytes long, proto string")
    flow = connections_to_flows(log).first()
    assert (flow["timestamp"], flow["orig_bytes"], flow["orig_pkts"], flow["resp_pkts"]) == (T0, 0, 1, 0)
    with pytest.raises(ValueError):
        connections_to_flows(spark.createDataFrame([(1,)], "other int"))


def test_batch_summary_and_result_table(spark):
    df = spark.createDataFrame(
        [("a", "w", 0, 0.9, "ml_only", None), ("b", "w", 2, 0.8, "weighted_ml", None), ("c", "w", None, None, None, "boom" * 100)],
        "device_id string, time_window string, prediction int, confidence double, method string, error string",
    )
    assert tuple(summary.batch_summary(df).first()) == (3, 1, 1, 0.5, 1)
    shown = {r["device_id"]: r for r in rules.result_table(df).collect()}
    assert shown["a"]["confidence"] == "90.0%" and shown["b"]["method"] == "Hybrid" and shown["c"]["prediction"] == "Error" and len(shown["c"]["error"]) == 200
