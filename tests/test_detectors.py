import json

import pytest
from pyspark.sql import functions as F

from helpers import client_hello
from wiretide.functions.tls import with_client_hello
from wiretide.operators.detection import flow_detections, opinion
from wiretide.operators.detectors import BEACON, MALWARE, Detector, beaconing, built_in, dga, encrypted_malware, exfiltration, flood, port_scan, score
from wiretide.operators.features import fill_defaults
from wiretide.plans import detection


def rows(spark, **values):
    columns = [F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()]
    return spark.range(1).select(*columns)


def run(spark, detector, **values):
    row = score(fill_defaults(rows(spark, **values)), detector).first()
    return row.confidence, row.is_threat, json.loads(row.evidence)


BEACONING = dict(packet_count=25.0, iat_mean=5.0, iat_variance=0.002, iat_cv=0.05)


@pytest.mark.parametrize("change, confidence", [
    ({}, 0.92), ({"iat_variance": 0.04}, 0.82), ({"iat_variance": 0.1, "iat_cv": 0.2}, 0.65), ({"iat_variance": 0.04, "iat_cv": 0.4}, 0.0),
    ({"packet_count": 4.0}, 0.0), ({"iat_mean": 0.5}, 0.0), ({"is_portless": 1.0}, 0.0), ({"dst_broadcast": 1.0}, 0.0),
    ({"dst_port": 1900}, 0.0), ({"src_port": 5353}, 0.0), ({"payload_to_header_ratio": 0.05}, 0.0)])
def test_beaconing(spark, change, confidence):
    got, threat, evidence = run(spark, beaconing(), **(BEACONING | change))
    assert got == confidence and threat == (confidence >= 0.7) and ("indicators" in evidence) == threat


def test_beacon_texts(spark):
    assert run(spark, beaconing(), **BEACONING)[2]["indicators"] == [
        "25 check-ins at a fixed 5.00 s interval", "interval variance 0.0020 (human-driven traffic is irregular)"]


@pytest.mark.parametrize("tunnel, signals, confidence", [(1.0, 0.0, 0.94), (0.0, 5.0, 0.94), (0.0, 4.0, 0.88), (0.0, 3.0, 0.78), (0.0, 2.0, 0.0)])
def test_dga(spark, tunnel, signals, confidence):
    got, _, evidence = run(spark, dga(), is_dns_suspect=tunnel, dns_dga_signals=signals, dns_query="x.biz")
    assert got == confidence and evidence["queried_domain"] == "x.biz" and ("encoded_subdomain_length" in evidence) == bool(tunnel)


def test_known_fingerprint(spark):
    got, threat, evidence = run(spark, encrypted_malware(), is_tls=1.0, ja3_hash="6734f37431670e3ab732c3f8b3799e56")
    assert got == 0.96 and threat and evidence["matched_threat"] == "Cobalt_Strike"


def test_implant_and_browser_hello(spark):
    implant = dict(is_tls=1.0, tls_version=769.0, cipher_count=2.0, tls_extension_count=1.0, tls_has_sni=0.0, tls_complete=1.0, dst_port=4444)
    got, threat, evidence = run(spark, encrypted_malware(), **implant)
    assert got == 0.92 and threat and len(evidence["anomalies"]) == 5
    browser = implant | dict(tls_version=771.0, cipher_count=15.0, tls_extension_count=9.0, tls_has_sni=1.0, dst_port=443)
    assert run(spark, encrypted_malware(), **browser)[:2] == (0.0, False)
    # The parts .35 + .25 + .10 reach the level exactly
    edge = implant | dict(cipher_count=15.0, dst_port=443)
    assert run(spark, encrypted_malware(), **edge)[:2] == (0.7, True)


EXFIL = dict(total_bytes=800_000.0, bytes_per_second=600_000.0, payload_to_header_ratio=35.0, pkt_len_mean=1400.0)


@pytest.mark.parametrize("change, confidence", [
    ({}, 0.89), ({"total_bytes": 6e6}, 0.94), ({"total_bytes": 2e6, "payload_to_header_ratio": 6.0}, 0.86), ({"src_port": 443}, 0.0),
    ({"src_port": 8080}, 0.0), ({"dst_internal": 1.0}, 0.0), ({"pkt_len_mean": 900.0}, 0.0)])
def test_exfiltration(spark, change, confidence):
    assert run(spark, exfiltration(), **(EXFIL | change))[0] == confidence


def test_exfiltration_texts(spark):
    assert run(spark, exfiltration(), **EXFIL)[2]["indicators"] == [
        "781.2 KB pushed in one direction", "payload-to-header ratio 35.0 (bulk data, not control traffic)", "average packet 1,400 B (MTU-sized frames)"]


def test_flood_sum_reaches_the_level_exactly(spark):
    target = dict(packets=500, peak_pps=400, syn_only_ratio=0.0, udp_ratio=1.0, unique_sources=10, dst_ip="10.0.0.1", source_ip_entropy=1.0, top_sources=["a"])
    row = score(rows(spark, **target), flood()).first()
    assert row.confidence == 0.7 and row.is_threat
    assert json.loads(row.evidence)["indicators"] == ["400 pps peak (threshold 300)", "100% UDP packets"]


@pytest.mark.parametrize("ports, hosts, ratio, confidence", [
    (10, 0, 0.6, 0.75), (25, 0, 0.6, 0.85), (100, 0, 0.9, 0.97), (0, 20, 0.95, 0.80), (0, 50, 0.7, 0.85), (9, 19, 1.0, 0.0), (50, 50, 0.5, 0.0)])
def test_port_scan(spark, ports, hosts, ratio, confidence):
    source = dict(max_ports_on_one_host=ports, max_hosts_on_one_port=hosts, probe_ratio=ratio, vertical_target="h", probed_ports=[1])
    assert score(rows(spark, **source), port_scan()).first().confidence == confidence


FLOW = dict(last_us=5, flow_start_us=1, flow_id="f", src_ip="10.0.0.1", dst_ip="1.1.1.1", protocol="TCP", src_port=40000, dst_port=443)


def hybrid(spark, cls, prob, **values):
    probs = F.create_map(F.lit("benign"), F.lit(1 - prob), F.lit(BEACON), F.lit(prob))
    data = rows(spark, **(FLOW | values)).withColumns({"ml_class": F.lit(cls), "ml_prob": F.lit(max(prob, 1 - prob)), "ml_probs": probs, "features": F.lit(None).cast("string")})
    return [(r.threat_class, r.confidence_score, json.loads(r.evidence), r.explain_class) for r in flow_detections(data, built_in(), True, 0.85).collect()]


def test_model_only_alert_is_marked_and_capped(spark):
    (cls, confidence, evidence, explain), = hybrid(spark, BEACON, 0.97, packet_count=20.0, iat_mean=5.0, iat_variance=1.5, iat_cv=0.25)
    assert (cls, confidence, explain) == (BEACON, 0.89, BEACON)
    assert evidence["detected_by"] == "AI model" and evidence["model_probability"] == 0.97 and "indicators" not in evidence


def test_rule_alert_carries_the_model_opinion(spark):
    (cls, confidence, evidence, explain), = hybrid(spark, "benign", 0.1, **BEACONING)
    assert (cls, confidence, explain) == (BEACON, 0.92, None)
    assert evidence["detected_by"] == "Rules" and evidence["model_probability"] == 0.1 and evidence["indicators"]
    (_, confidence, evidence, explain), = hybrid(spark, BEACON, 0.98, **BEACONING)
    assert confidence == 0.98 and evidence["detected_by"] == "Rules + AI model" and explain == BEACON


def test_plug_in_detector(spark):
    big = Detector("Big_Flow", "flow", lambda: F.when(F.col("total_bytes") > 10, F.lit(0.75)).otherwise(F.lit(0.0)), lambda t: {"bytes": F.col("total_bytes")})
    out = flow_detections(rows(spark, **FLOW, total_bytes=11.0), [*built_in(), big]).collect()
    assert [(r.threat_class, r.evidence) for r in out] == [("Big_Flow", '{"bytes":11.0}')]


def test_fingerprint_table_of_any_size(spark, make_packets):
    """A table of 100,000 fingerprints instead of the fixed ones; the known one is that of an ordinary hello."""
    hello = client_hello([0x1301, 0x1302, 0x1303, 0xC02B, 0xC02F, 0xC02C], "example.com", [29], [0], extra=(16, 23, 35))
    rows = [{"t": i, "src_port": 5000 + i, "dst_port": 443, "raw_payload": hello if i else b"x"} for i in range(4)]
    packets = make_packets(rows, raw=True)
    digest = with_client_hello(packets, "raw_payload").filter("is_tls").first().ja3_hash
    table = spark.range(100_000).select(F.md5(F.col("id").cast("string")).alias("ja3_hash"), F.lit("noise").alias("family"))
    table = table.unionByName(spark.createDataFrame([(digest, "Known"), (digest, "Other")], table.schema))
    assert detection.run(packets).filter(F.col("threat_class") == MALWARE).count() == 0
    alert, = detection.run(packets, families=table).filter(F.col("threat_class") == MALWARE).collect()
    assert '"matched_threat":"Known"' in alert.evidence and alert.confidence_score == 0.96
