"""File formats, streams and the dataset plan on small files."""

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from lanlore.config import Settings
from lanlore.learn import classify, clusters
from lanlore.operators.intervals import event_intervals
from lanlore.operators.project import connections_to_flows, packets_to_flows
from lanlore.plans import ingest, scoring
from lanlore.sources import logs, sinks
from lanlore.streaming import features as st
from lanlore.streaming.sequences import rolling_sequences

from .conftest import rows

HEADER = "start,sIPs,rIPs,sBytesSum,rBytesSum,sPackets,rPackets,duration,protocol\n"


def test_logs_with_gaps_and_bad_cells(spark, tmp_path):
    path = tmp_path / "dns.csv"
    path.write_text("timestamp, device_id, query_domain, response_code\n2024-01-01 10:00:00, 10.0.0.1, a.com, NOERROR\nbroken, 10.0.0.1, , \n")
    got = logs.read_dns(spark, str(path))
    assert "response_time" not in got.columns
    assert rows(got, F.desc("timestamp"))[0] == (dt.datetime(2024, 1, 1, 10), "10.0.0.1", "a.com", "NOERROR")
    assert got.where("timestamp IS NULL AND query_domain IS NULL").count() == 1
    missing = logs.read_dhcp(spark, str(tmp_path / "none.csv"))
    assert missing.count() == 0 and missing.columns == ["timestamp", "device_id", "message_type", "result"]
    odd = tmp_path / "odd.csv"
    odd.write_text("x,y\n1,2\n")
    assert logs.read_flows(spark, str(odd)).columns[:3] == ["timestamp", "src_ip", "dst_ip"]


def test_flow_folder_with_archives(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "1000,d1,r,10,1,1,1,0.5,tcp\n1010,d1,r,20,1,1,1,0.5,tcp\n")
    (tmp_path / "b.csv").write_text("start,sIPs,extra\n1020,d2,x\n")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("in/one.csv", HEADER + '1030,d3,r,30,1,1,1,"0.5",tcp\n\n1040,d3,r,40,1,1,1,0.5,udp\n')
        z.writestr("in/readme.txt", "no")
        z.writestr("two.csv", "sIPs,start\nd4,1050\n")
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    with pytest.raises(Exception, match="not a readable archive"):
        logs.read_flow_folder(spark, str(tmp_path)).count()
    got = logs.read_flow_folder(spark, str(tmp_path), skip_unreadable=True)
    assert [r[0] for r in rows(got.select("sIPs"), "start")] == ["d1", "d1", "d2", "d3", "d3", "d4"]
    assert got.where("sIPs = 'd3'").agg(F.sum("sBytesSum")).first()[0] == 70
    assert got.where("extra = 'x'").count() == 1
    assert logs.read_flow_folder(spark, str(tmp_path), max_files=1).count() == 2
    assert logs.read_flow_folder(spark, str(tmp_path), max_files=2).count() == 3


def test_dataset_plan(spark, tmp_path):
    (tmp_path / "f.csv").write_text(HEADER + "1000,d1,r,10,1,1,1,0.5,tcp\n1010,d1,r,20,1,1,1,1.5,tcp\n2000,d1,r,5,1,1,1,0.5,tcp\n1010,d2,r,7,1,1,1,0.5,tcp\n")
    (tmp_path / "events.txt").write_text("[1010.0 -- x] [BAD-MISCONF-START] left: 1.1.1.1 --> 2.2.2.2\n[1500.0 -- x] [BAD-MISCONF-END] ok\n")
    got = ingest.features_from_dataset(spark, str(tmp_path), str(tmp_path / "events.txt"), Settings())
    table = {(r["device_id"], r["time_window"].minute): r for r in got.collect()}
    assert table[("d1", 15)]["orig_bytes_sum"] == 30 and table[("d1", 15)]["label"] == 0
    assert table[("d2", 15)]["label"] == 2 and table[("d1", 30)]["label"] == 0


def test_marker_lines_keep_their_order(spark, tmp_path):
    path = tmp_path / "events.txt"
    path.write_text("".join(f"[{i}.0 -- x] [BAD-MISCONF-{'START] d: 1.1.1.1 --> 2.2.2.2' if i % 3 == 0 else 'END] x'}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = logs.read_marker_lines(spark, str(path))
        assert lines.select("line_no.block").distinct().count() > 10
        got = sorted((r["start"], r["end"]) for r in event_intervals(lines).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(float(i), float(i + 2)) for i in range(0, 3000, 3)]


def test_connection_log_and_packet_export(spark, tmp_path):
    (tmp_path / "conn.log").write_text("#separator \\x09\n#fields\tts\tid.orig_h\tproto\torig_bytes\n1000.5\t10.0.0.1\ttcp\t-\n1001.5\t10.0.0.2\tudp\t7\n#close\n")
    raw = logs.read_connection_log(spark, str(tmp_path / "conn.log"))
    assert raw.columns == ["ts", "id.orig_h", "proto", "orig_bytes"] and raw.count() == 2
    assert [r["orig_bytes"] for r in connections_to_flows(raw).orderBy("device_id").collect()] == [0, 7]
    (tmp_path / "p.csv").write_text(" frame.time , ip.src,frame.len\n2024-01-01 10:00:00,10.0.0.1,60\n,,\n")
    got = packets_to_flows(logs.read_packet_export(spark, str(tmp_path / "p.csv")))
    assert got.count() == 1 and got.first()["orig_bytes"] == 60


def test_scoring_with_a_saved_forest(spark, tmp_path):
    data = spark.range(200).select(
        F.concat(F.lit("d"), "id").alias("device_id"), F.lit(dt.datetime(2024, 1, 1)).alias("time_window"),
        (F.col("id") % 20).cast("double").alias("dhcp_discover_count"), F.lit(0.0).alias("dhcp_ack_count"),
        ((F.col("id") % 20) > 10).cast("int").alias("l"),
    ).select("*", (F.col("l") * 2).alias("label")).drop("l")
    names = ["dhcp_discover_count", "dhcp_ack_count"]
    model = classify.random_forest(data, names, trees=10)
    sinks.save_model(model.model, str(tmp_path / "m"))
    loaded = classify.Classifier(sinks.load_model(str(tmp_path / "m")), model.classes)
    got = scoring.score_batch(data, loaded).collect()
    assert {r["method"] for r in got} == {"combined_agreement"}
    assert all((r["prediction"] == 2) == (r["dhcp_discover_count"] > 10) for r in got)
    assert all(r["method"] == "ml_only" for r in scoring.score_batch(data, loaded, hybrid=False).collect())
    assert classify.pick_model({"ensemble": 1, "xgb": 2}) == ("ensemble", 1)
    three = data.withColumn("label", F.when(F.col("dhcp_discover_count") < 3, 4).otherwise(F.col("label")))
    boosted = classify.boosted(three, names, rounds=3)
    scored = boosted.score(three)
    assert scored.where("abs(aggregate(probabilities, 0D, (s, x) -> s + x) - 1) > 1e-9").count() == 0
    assert scored.where("prediction = label").count() == 200
    ensemble = classify.Ensemble([model, classify.second_booster(data, names, rounds=3)]).score(data)
    assert ensemble.where("prediction = label").count() == 200


def test_late_rows_are_counted_and_left_out(spark, tmp_path):
    schema = "device_id string, timestamp timestamp"
    base = dt.datetime(2024, 1, 1)
    for i, minutes in enumerate(([0, 1, 60], [61, 120], [2, 180])):
        frame = spark.createDataFrame([("a", base + dt.timedelta(minutes=m)) for m in minutes], schema)
        frame.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    listener = st.LateRows()
    spark.streams.addListener(listener)
    table, run = st.to_table(st.windowed(stream, {"n": F.count(F.lit(1))}), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert listener.of(run) == 1
    spark.streams.removeListener(listener)
    assert [r["n"] for r in table.orderBy("time_window").collect()] == [2, 2, 1]


def test_rolling_state_spans_batches(spark, tmp_path):
    schema = "device_id string, time_window timestamp, x int"
    base = dt.datetime(2024, 1, 1)
    for i in range(2):
        part = [("a", base + dt.timedelta(minutes=5 * (3 * i + j)), 3 * i + j) for j in range(3)]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    table, _ = st.to_table(rolling_sequences(stream, ["x"], 4, delay="0 seconds"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = [[int(v[0]) for v in r["sequence"]] for r in table.orderBy("time_window").collect()]
    assert got == [[0, 1, 2, 3], [1, 2, 3, 4], [2, 3, 4, 5]]


def test_silhouette_needs_two_clusters(spark):
    df = spark.createDataFrame([([0.0], 5), ([0.1], 5), ([9.0], 7), ([9.1], 7), ([4.0], -1)], "scaled array<double>, cluster int")
    assert clusters.silhouette(df) > 0.9
    assert clusters.silhouette(df.where("cluster <> 7")) is None


def test_files_with_headers_of_their_own(spark, tmp_path):
    files = {
        "a": "timestamp,device_id,message_type,result\n2024-01-01 00:00:00,d1,ACK,ok\n",
        "b": "device_id,timestamp,result,message_type\nd2,2024-01-01 00:01:00,,NAK\n",
        "c": "message_type , device_id,timestamp\nDISCOVER, d3,2024-01-01 00:02:00\n",
        "d": "",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    got = {r["device_id"]: (r["message_type"], r["timestamp"].minute, r["result"]) for r in logs.read_dhcp(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {"d1": ("ACK", 0, "ok"), "d2": ("NAK", 1, None), "d3": ("DISCOVER", 2, None)}


def test_connection_logs_with_fields_of_their_own(spark, tmp_path):
    (tmp_path / "a.log").write_text('#fields\tts\tid.orig_h\torig_bytes\n1.5\t"x\t10\n')
    (tmp_path / "b.log").write_text("#separator\n#fields\torig_bytes\tts\tid.orig_h\n-\t2.5\ty\n#close\n")
    got = {(r["ts"], r["id.orig_h"], r["orig_bytes"]) for r in logs.read_connection_log(spark, str(tmp_path / "*.log")).collect()}
    assert got == {(1.5, '"x', 10), (2.5, "y", None)}


def test_unreadable_archives_are_errors_unless_asked_for(spark, tmp_path):
    (tmp_path / "broken.zip").write_text("no archive")
    with pytest.raises(Exception, match="not a readable archive"):
        logs.read_zip_members(spark, [str(tmp_path / "broken.zip")]).collect()
    [row] = logs.read_zip_members(spark, [str(tmp_path / "broken.zip")], skip_unreadable=True).collect()
    assert row["archive"].endswith("broken.zip") and row["member"] is None


def test_rolling_sequences_follow_event_time(spark, tmp_path):
    schema = "device_id string, time_window timestamp, x int"
    base = dt.datetime(2024, 1, 1)
    for i, minutes in enumerate(([0, 10], [5, 30], [15, 20], [90])):
        part = [("a", base + dt.timedelta(minutes=m), m) for m in minutes]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    table, _ = st.to_table(rolling_sequences(stream, ["x"], 3, delay="30 minutes"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = [(r["time_window"].minute, [int(v[0]) for v in r["sequence"]]) for r in table.orderBy("time_window").collect()]
    assert got == [(10, [0, 5, 10]), (15, [5, 10, 15]), (20, [10, 15, 20]), (30, [15, 20, 30])]
