import json
import os
import random

import pytest
from pyspark.sql import functions as F

from helpers import T0, client_hello, dns_query
from wiretide.config import DetectionConfig, FloodConfig, FlowConfig, WindowConfig
from wiretide.operators.alerts import suppress_repeats
from wiretide.operators.flows import flows
from wiretide.operators.windows import pane_counts, probe_pairs, source_totals, target_facets, target_totals, top_sources, window_rows, with_probed_ports
from wiretide.plans import detection
from wiretide.schema import ALERT_COLUMNS, PACKET_SCHEMA
from wiretide.sources.alert_store import read_alerts
from wiretide.sources.packets import read_packets, stream_packets
from wiretide.streaming.job import end_stream, run_available, start_flows, with_end
from wiretide.streaming.state import cooldown_stream, flow_stream
from wiretide.streaming.windows import facet_stream, pair_rows, target_rows, until_last_window

S = 1_000_000
EPOCH = WindowConfig(origin_us=0)


@pytest.fixture(scope="module", autouse=True)
def few_state_stores(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def write(packets, path, files=4, parts=None):
    """Packet files in order of arrival (pkt_id), written one after the other, or those of them numbered in ``parts``."""
    if "raw_payload" not in packets.columns:
        packets = packets.withColumn("raw_payload", F.lit(None).cast("binary"))
    rows = packets.withColumn("ts", F.timestamp_micros("ts_us")).select(*PACKET_SCHEMA.names)
    bounds = rows.selectExpr("percentile(pkt_id, array(%s)) q" % ", ".join(str(i / files) for i in range(files + 1))).first().q
    for i in parts or range(files):
        last = i == files - 1
        rows.filter((F.col("pkt_id") >= bounds[i]) & ((F.col("pkt_id") < bounds[i + 1]) | F.lit(last))).coalesce(1).write.mode("append").parquet(path)


def run(stream, name, tmp_path, end=None):
    """What a stream gives, with ``end`` after it was closed in that folder."""
    for again in (False, True):
        if again and end:
            end_stream(stream.sparkSession, end)
            end_stream(stream.sparkSession, end)  # the second call adds nothing
        if not again or end:
            query = (stream.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / name))
                     .option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start())
            query.awaitTermination(240)
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / name))


def plain(frame, columns):
    """Rows as sortable text; doubles to 9 digits, since sums of logarithms depend on the order."""
    def text(v):
        if isinstance(v, list):
            return str([text(x) for x in v])
        return f"{v:.9f}" if isinstance(v, float) else bytes(v).hex() if isinstance(v, bytes | bytearray) else str(v)
    return sorted(tuple(map(text, r)) for r in frame.select(*columns).collect())


def jittered(rows, rng, delay=1.5):
    """Arrival up to ``delay`` seconds after the fact: pkt_id counts arrivals."""
    rows = sorted(rows, key=lambda r: r["t"] + rng.random() * delay)
    return [r | {"pkt_id": i} for i, r in enumerate(rows)]


def traffic(count=400):
    rng = random.Random(11)
    rows, t = [], 0.0
    for _ in range(count):
        t += rng.choice([0.0, 0.05, 0.3, 1.0])
        rows.append({"t": round(t, 6), "src_ip": f"10.0.1.{rng.randint(1, 4)}", "src_port": 1000 + rng.randint(0, 3), "dst_ip": f"10.0.0.{rng.randint(1, 3)}",
                     "dst_port": rng.randint(1, 4), "protocol": rng.choice(["TCP", "TCP", "UDP", "ICMP", "GRE"]), "syn": rng.random() < 0.5, "ack": rng.random() < 0.3,
                     "psh": rng.random() < 0.2, "packet_length": rng.randint(40, 1500), "payload_length": rng.choice([0, 20, 400]),
                     "raw_payload": rng.choice([None, b"", bytes(rng.randbytes(600)), client_hello([0x1301, rng.randint(1, 99)], "x.org")])})
    return jittered(rows, rng)


def test_flow_stream_equals_batch_in_every_column(spark, make_packets, tmp_path):
    packets, folder = make_packets(traffic(), raw=True), str(tmp_path)
    write(packets, f"{folder}/p", 4)
    assert read_packets(spark, f"{folder}/p").count() == packets.count()
    cfg = FlowConfig(idle_us=3 * S, active_us=20 * S, splt_length=5, max_samples=3)
    got = run(flow_stream(with_end(stream_packets(spark, f"{folder}/p", 1), folder), cfg), "flow_rows", tmp_path, folder).filter("src_ip <> '-'")
    want = flows(packets, cfg)
    assert set(got.columns) == {*want.columns, "watermark_us"} and dict(got.drop("watermark_us").dtypes) == dict(want.dtypes)
    for a, b in zip(plain(got, want.columns), plain(want, want.columns)):
        assert dict(zip(want.columns, a)) == dict(zip(want.columns, b))
    assert got.count() == want.count() > 50


def test_open_flows_wait_and_late_packets_are_left_out(spark, make_packets, tmp_path):
    rows = [{"t": 1.0 * i} for i in range(40)] + [{"t": 60 + i / 10, "src_port": 1} for i in range(40)]
    rows += [{"t": 5.5}] + [{"t": 70 + i / 10, "src_port": 1} for i in range(39)]
    write(make_packets([r | {"pkt_id": i} for i, r in enumerate(rows)]), str(tmp_path / "p"), 3)
    got = run(flow_stream(stream_packets(spark, str(tmp_path / "p"), 1), FlowConfig(idle_us=3 * S, active_us=None)), "late_rows", tmp_path).collect()
    # The second flow of port 1 is still open
    assert sorted((r.src_port, r.packet_count) for r in got) == [(1, 40), (40000, 40)]


def test_window_stream_equals_batch_on_the_epoch_grid(spark, make_packets, tmp_path):
    packets, folder = make_packets(traffic(), raw=True), str(tmp_path)
    write(packets, f"{folder}/p", 4)
    closed = run(facet_stream(with_end(stream_packets(spark, f"{folder}/p", 1), folder)), "facets", tmp_path, folder).filter("host <> '-'")
    closed = until_last_window(closed)
    rows = window_rows(pane_counts(packets, EPOCH), EPOCH)
    for got, want in ((target_rows(closed), target_facets(rows)), (pair_rows(closed), probe_pairs(rows))):
        assert plain(got, want.columns) == plain(want, want.columns)
    facets, pairs = target_facets(rows), probe_pairs(rows)
    for got, want in ((target_totals(target_rows(closed)), target_totals(facets)), (top_sources(target_rows(closed)), top_sources(facets)),
                      (with_probed_ports(source_totals(pair_rows(closed)), pair_rows(closed)), with_probed_ports(source_totals(pairs), pairs))):
        assert plain(got, want.columns) == plain(want, want.columns) and want.count() > 20


def test_cooldown_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    t, rows = 0, []
    for i in range(120):
        t += rng.choice([0, 3, 7, 20])
        rows.append((i, T0 + t * S, f"k{rng.randint(0, 2)}", f"f{i:03d}", "X", "a", "b", "{}"))
    rows = [rows[i] for i in sorted(range(120), key=lambda i: rows[i][1] + rng.randint(0, 9 * S))]  # in order but for nine seconds
    names = "id long, us long, dedup_key string, flow_id string, threat_class string, src_ip string, dst_ip string, evidence string"
    ends = [(1000, T0 + 10_000 * S, "end", "f", "X", "a", "b", "{}"), (1001, T0 + 11_000 * S, "end", "f", "X", "a", "b", "{}")]

    def alerts(part):
        return spark.createDataFrame(part, names).withColumn("ts", F.timestamp_micros("us")).drop("us")
    for at in range(0, 120, 30):
        alerts(rows[at:at + 30]).coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
    alerts(ends).coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
    stream = spark.readStream.schema(alerts(rows).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "a"))
    got = run(cooldown_stream(stream, lateness="10 seconds"), "published", tmp_path).filter("id < 1000")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in suppress_repeats(alerts(rows)).collect())


def attacks():
    """All six classes, each of them again after a while, among harmless traffic."""
    rng, rows = random.Random(5), []
    for start in (0.0, 12.0, 70.0):
        rows += [{"t": start + i / 500, "src_ip": f"198.51.100.{i % 60}", "dst_ip": "10.0.0.80", "dst_port": 80, "syn": True, "ack": False, "payload_length": 0} for i in range(450)]
        rows += [{"t": start + 1 + i / 20, "src_ip": "10.0.0.66", "dst_ip": "10.0.0.9", "dst_port": 1000 + i, "syn": True, "ack": False, "payload_length": 0} for i in range(30)]
        rows += [{"t": start + i / 50, "src_ip": "10.0.0.7", "src_port": 50123, "dst_ip": "203.0.113.50", "packet_length": 60_000, "payload_length": 59_900} for i in range(100)]
        rows += [{"t": start + 2, "src_ip": "10.0.0.5", "src_port": 5000 + int(start), "dst_ip": "203.0.113.53", "dst_port": 53, "protocol": "UDP", "raw_payload": dns_query(name)}
                 for name in ("www.example.org", "vxzq123pkmw9trx8kd.biz")]
        rows += [{"t": start + 3, "src_ip": "10.0.0.6", "src_port": 6000 + int(start), "dst_ip": "203.0.113.60", "dst_port": 4443, "raw_payload": client_hello([5, 4], version=0x0301)}]
    rows += [{"t": 2.0 * i, "src_ip": "10.0.0.4", "dst_ip": "203.0.113.40", "dst_port": 4444, "packet_length": 200, "payload_length": 146} for i in range(80)]
    rows += [{"t": rng.random() * 160, "src_ip": f"10.0.2.{rng.randint(1, 9)}", "dst_ip": "203.0.113.1", "src_port": rng.randint(2000, 2020)} for _ in range(300)]
    return jittered([r | {"t": round(r["t"], 6)} for r in rows], rng)


@pytest.fixture(scope="module")
def six(spark, make_packets, tmp_path_factory):
    """Packets with all attacks, the settings, and what the batch plan publishes."""
    cfg = DetectionConfig(window=EPOCH, flow=FlowConfig(idle_us=10 * S, active_us=40 * S), flood=FloodConfig(pps_threshold=200, min_packets=100))
    packets = make_packets(attacks(), raw=True).persist()
    want = detection.run(packets, cfg)
    assert want.select("threat_class").distinct().count() == 6 and want.groupBy("threat_class").count().filter("count < 2").isEmpty()
    return packets, cfg, plain(want, ALERT_COLUMNS)


def published(spark, table):
    rows = read_alerts(spark, table)
    ids = [r.id for r in rows.select("id").collect()]
    assert len(set(ids)) == len(ids)
    return plain(rows, ALERT_COLUMNS)


def test_streamed_alerts_equal_batch(spark, six, tmp_path):
    packets, cfg, want = six
    folder, table, lines = (str(tmp_path / n) for n in ("job", "alerts", "json"))
    os.makedirs(tmp_path / "p")
    source = stream_packets(spark, str(tmp_path / "p"), 2)
    for parts in ((0, 1, 2), (3, 4)):  # two runs as data comes, the second one taking up the state of the first
        write(packets, str(tmp_path / "p"), 5, parts)
        run_available(source, folder, table, lines, cfg)
    early = published(spark, table)
    assert early and set(early) < set(want)
    run_available(source, folder, table, lines, cfg, end=True)
    assert published(spark, table) == want
    run_available(source, folder, table, lines, cfg, end=True)  # nothing is published twice
    assert published(spark, table) == want
    assert len([json.loads(r.value) for r in spark.read.text(lines).collect()]) == len(want)


def test_repeated_micro_batches_change_nothing(spark, six, tmp_path):
    packets, cfg, want = six
    folder, table = str(tmp_path / "job"), str(tmp_path / "alerts")
    write(packets, str(tmp_path / "p"), 3)
    source = stream_packets(spark, str(tmp_path / "p"), 1)
    run_available(source, folder, table, None, cfg, end=True)

    def forget(query):
        """As if the driver had gone between the work of the last micro-batch and its commit."""
        commits = os.path.join(folder, "checkpoints", query, "commits")
        last = max(int(n) for n in os.listdir(commits) if n.isdigit())
        for name in (str(last), f".{last}.crc"):
            if os.path.exists(os.path.join(commits, name)):
                os.remove(os.path.join(commits, name))
    for query in ("flow", "host", "publisher"):
        forget(query)
    start_flows(source, folder, cfg).awaitTermination()
    run_available(source, folder, table, None, cfg, end=True)
    assert published(spark, table) == want
