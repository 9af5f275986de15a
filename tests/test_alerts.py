import json

import pytest
from pyspark.sql import functions as F

from wiretide.operators.alerts import severity, suppress_repeats, to_alerts, with_ids
from wiretide.plans import analytics, report
from wiretide.plans.response import rule_bundle, with_rules
from wiretide.schema import ALERT_SCHEMA
from wiretide.sources import alert_store

EPOCH = "2026-01-01T00:00:00"


@pytest.fixture(scope="module")
def alert(spark):
    def build(*changes):
        base = dict(id=1, ts=0.0, flow_id="172.20.3.14:51515->192.0.2.77:8088_TCP", src_ip="172.20.3.14", dst_ip="192.0.2.77", src_port=51515,
                    dst_port=8088, protocol="TCP", threat_class="Botnet_C2_Beaconing", severity="CRITICAL", confidence_score=0.93, evidence='{"iat_variance":0.0}')
        rows = [{**base, **c} for c in changes or ({},)]
        names = ALERT_SCHEMA.names
        df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], "id long, ts double, " + ", ".join(
            f"{f.name} {f.dataType.simpleString()}" for f in ALERT_SCHEMA.fields[2:]))
        return df.withColumn("ts", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long") + F.unix_micros(F.lit(EPOCH).cast("timestamp"))))
    return build


def test_severity_levels(spark):
    got = spark.createDataFrame([(c,) for c in (0.9, 0.89, 0.8, 0.7, 0.69)], "c double").select(severity(F.col("c")).alias("s")).collect()
    assert [r.s for r in got] == ["CRITICAL", "HIGH", "HIGH", "MEDIUM", "LOW"]


def test_alert_time_is_traffic_time(spark):
    row = to_alerts(spark.createDataFrame([(1577836800000000, None, "1.1.1.1", "2.2.2.2", None, None, None, None, "Data_Exfiltration", 0.9, None)],
                    "ts_us long, flow_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, dedup_key string, "
                    "threat_class string, confidence_score double, evidence string")).first()
    assert row.ts.isoformat() == "2020-01-01T00:00:00" and row.severity == "CRITICAL" and row.protocol == "OTHER"
    assert row.dedup_key == "1.1.1.1->2.2.2.2_Data_Exfiltration" and row.flow_id == "0.0.0.0:0->0.0.0.0:0_OTHER"


def test_cooldown_chain(alert):
    rows = alert(*[{"id": i, "ts": float(t)} for i, t in enumerate((0, 20, 40, 65, 80))], {"id": 9, "ts": 40.0, "flow_id": "zz"}).withColumn("dedup_key", F.lit("k"))
    kept = suppress_repeats(rows).orderBy("ts").collect()
    assert [r.id for r in kept] == [0, 2, 4]


def test_ids_are_dense_and_ordered(alert):
    rows = with_ids(alert(*[{"ts": float(t % 7), "flow_id": f"f{t:02d}"} for t in range(50)]).drop("id").repartition(5), after=10).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(11, 61)) and [(r.ts, r.flow_id) for r in rows] == sorted((r.ts, r.flow_id) for r in rows)


def test_table_round_trip_and_retry(alert, spark, tmp_path):
    path = str(tmp_path / "alerts")
    first = alert({"ts": 1.0}, {"ts": 0.0, "evidence": "{bad"})
    alert_store.append_table(first, path, 0)
    alert_store.append_table(alert({"ts": 5.0}), path, 1)
    alert_store.append_table(alert({"ts": 5.0}), path, 1)
    rows = analytics.latest(alert_store.read_alerts(spark, path), 10).collect()
    assert [r.id for r in rows] == [3, 2, 1] and [r.evidence for r in rows] == ['{"iat_variance":0.0}'] * 2 + ["{}"]


def test_an_append_reads_no_stored_rows(alert, spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    alert_store.append_table(alert({}, {"ts": 90_000.0}), path, 0)
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir() and p.name != alert_store.ENTRIES) == ["day=2026-01-01", "day=2026-01-02"]
    monkeypatch.setattr(alert_store, "try_read", None)  # the table itself is never read again
    for batch, n in ((1, 3), (2, 0), (3, 1), (3, 1), (4, 2)):
        alert_store.append_table(alert(*[{"ts": 1.0 * i} for i in range(n)]) if n else alert().limit(0), path, batch)
    rows = alert_store.read_alerts(spark, path).collect()
    assert sorted(r.id for r in rows) == list(range(1, 9))
    entries = [tuple(map(int, p.name.split("."))) for p in (tmp_path / "t" / alert_store.ENTRIES).iterdir() if not p.name.startswith(".")]
    assert (4, 7, 8) in entries and len(entries) <= 3


def test_json_lines_and_csv(alert, spark, tmp_path):
    alert_store.append_json(alert({}, {"ts": 0.25}), str(tmp_path / "j"))
    rows = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()), key=lambda r: r["timestamp"])
    assert {r["timestamp"] for r in rows} == {"2026-01-01T00:00:00+00:00", "2026-01-01T00:00:00.250000+00:00"} and rows[0]["evidence"] == {"iat_variance": 0.0}
    alert_store.write_csv(alert(), str(tmp_path / "c"))
    row = spark.read.option("header", True).csv(str(tmp_path / "c")).first()
    assert row.asDict()["time_ist"] == "2026-01-01 05:30:00" and list(row.asDict())[:2] == ["id", "time_ist"]


def rules(df):
    row = with_rules(df).first()
    return row.firewall_rules, row.ids_rules, row


def test_c2_rules(alert):
    firewall, ids, row = rules(alert())
    assert firewall == ["iptables -A FORWARD -s 172.20.3.14 -d 192.0.2.77 -j DROP", "iptables -A FORWARD -d 192.0.2.77 -j DROP"]
    assert ids[0].startswith('drop tcp 172.20.3.14 any -> 192.0.2.77 8088 (msg:"') and f"sid:{row.sid};" in ids[0]
    import zlib
    key = f"{row.flow_id}|{row.threat_class}|2026-01-01T00:00:00+00:00"
    assert row.sid == 9_000_000 + zlib.crc32(key.encode()) % 999_999


def test_v6_rules(alert):
    assert all(line.startswith("ip6tables") for line in rules(alert({"src_ip": "2001:db8:7::a1", "dst_ip": "2001:db8:9::b2"}))[0])


def test_captured_names_cannot_inject(alert):
    hostile = "x;|wget${IFS}h`ls`\\n\";rev:7;)'<&>.mal-host.org"
    firewall, ids, row = rules(alert({"threat_class": "DGA_Domains_and_DNS_Tunneling", "evidence": json.dumps({"queried_domain": hostile})}))
    for line in firewall + ids + [row.action]:
        assert not set("$`|<&\\'") & set(line)
    assert ids[0].count("rev:") == 1 and ids[0].count("msg:") == 1 and "mal-host.org" in ids[0]
    assert len(firewall) == 1 and firewall[0].startswith("iptables -A FORWARD -s 172.20.3.14 -p udp --dport 53 ")
    assert row.action.endswith(".mal-host.org CNAME .")


def test_other_classes(alert):
    firewall, ids, _ = rules(alert({"threat_class": "Volumetric_Protocol_DDoS", "evidence": '{"top_sources":["198.51.100.4","y | sh","198.51.100.8"]}'}))
    assert len(firewall) == 3 and firewall[1] == "iptables -A INPUT -s 198.51.100.4 -d 192.0.2.77 -j DROP" and "SYN flood" in ids[0]
    firewall, ids, _ = rules(alert({"threat_class": "Reconnaissance_Port_Scanning", "dst_ip": "*"}))
    assert firewall == ["iptables -A INPUT -s 172.20.3.14 -j DROP"]
    ja3 = "a" * 32
    assert f'content:"{ja3}"' in rules(alert({"threat_class": "Encrypted_Malware_TLS", "evidence": json.dumps({"ja3_hash": ja3})}))[1][0]
    firewall, ids, row = rules(alert({"threat_class": "Something"}))
    assert "LOG" in firewall[0] and ids == [] and row.action == "Review the flow manually."


def test_bundle_keeps_first_occurrence(alert, spark, tmp_path):
    rows = alert({"id": 1}, {"id": 2})
    firewall = rule_bundle(rows).filter("kind = 'firewall'").collect()
    assert len(firewall) == 2 and {r.id for r in firewall} == {1}
    alert_store.write_rule_bundle(rows, str(tmp_path / "b"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "b" / "firewall")).collect()]
    assert lines[0] == "#!/bin/sh" and lines[2] == "set -e" and lines[3].startswith("# alert 1 Botnet_C2_Beaconing") and len(lines) == 6
    assert [r.value for r in spark.read.text(str(tmp_path / "b" / "ids")).collect()][1].startswith("# alert 1")


def test_filters_posture_and_page(alert):
    rows = alert(*[{"id": i, "ts": 60.0 * i, "src_ip": f"10.0.0.{i}"} for i in range(1, 21)])
    assert analytics.filter_alerts(rows, 5).count() == 6
    assert [r.id for r in analytics.filter_alerts(rows, ip="10.0.0.1 ").orderBy("id").collect()] == [1, *range(10, 20)]
    assert analytics.filter_alerts(rows, severities=[]).count() == 20
    assert analytics.threat_posture(rows).first().posture == "Critical"
    assert analytics.threat_posture(rows.limit(0)).first().posture == "Nominal"
    assert [r.id for r in analytics.page(rows, 99).collect()] == [5, 4, 3, 2, 1]


def test_digest_and_descriptions(alert):
    rows = alert({"id": 1, "severity": "HIGH", "confidence_score": 0.85}, {"id": 2, "severity": "CRITICAL"},
                 {"id": 3, "threat_class": "Data_Exfiltration", "severity": "MEDIUM", "evidence": '{"total_bytes":2048,"bytes_per_sec":10,"detected_by":"AI model"}'})
    lead, other = analytics.digest(rows).collect()
    assert (lead.id, lead.n, lead.more, lead.title) == (2, 2, "+1 more of this type", "■ Critical · C2 beaconing (T1071)")
    assert other.body == "172.20.3.14 sent 2.0 KB to 192.0.2.77:8088 at 10 B/s" and other.title.endswith(" · AI model")


def test_report_order(alert):
    rows = alert({"id": 1, "severity": "LOW"}, {"id": 2, "severity": "HIGH", "confidence_score": 0.81}, {"id": 3, "severity": "HIGH", "confidence_score": 0.85})
    assert [r.id for r in report.incidents(rows).collect()] == [3, 2, 1]
    assert {(r.item, r.value) for r in report.evidence_rows(rows).collect()} == {("Iat Variance", "0.0")}
