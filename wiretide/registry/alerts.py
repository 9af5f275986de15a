"""Alert-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretide.config import DetectionConfig
from wiretide.fixtures import ctes, view
from wiretide.functions import text
from wiretide.operators import alerts as ops
from wiretide.operators.detectors import beaconing, exfiltration, flood, port_scan
from wiretide.plans import analytics, catalog, detection, report, response
from wiretide.registry import query
from wiretide.registry.flows import BEACON_SQL, EXFIL_SQL, SHORT_ACTIVE, flow_ctes
from wiretide.registry.windows import _FAN_OUT, _FLOOD_SQL, _SCAN_SQL, BOTH, LOW_FLOOD, LOW_SCAN, packets

ALERTS = ctes("v_alerts")


def alerts(spark, sf_dir):
    return view(spark, sf_dir, "v_alerts")


def _us(name="ts"):
    return F.unix_micros(name)


def _dim(rows, columns):
    def literal(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(values " + ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows) + f") as {columns}"


_THREATS = "th as (select * from " + _dim([(i, *r) for i, r in enumerate(catalog.THREATS)], "t(pos, cls, label, short, mid, technique, tactic, kc)") + ")"
_LEVELS = "lv as (select * from " + _dim(catalog.SEVERITIES, "t(sev, sl, glyph, rk)") + ")"
DIMS = ALERTS + ", " + _THREATS + ", " + _LEVELS
_OK = "(case when json_valid(evidence) then evidence else '{}' end)"
_SEVERITY = ("case when {c} >= 0.9::double then 'CRITICAL' when {c} >= 0.8::double then 'HIGH' when {c} >= 0.7::double then 'MEDIUM' else 'LOW' end")


# ---- from detections to alerts ------------------------------------------------------------------

_UNION_FLOWS = flow_ctes(30_000_000)
_UNION_SQL = BOTH + _FLOOD_SQL + _SCAN_SQL + _UNION_FLOWS[_UNION_FLOWS.index(",\npk as"):] + f""",
rules as (
 select 'Volumetric_Protocol_DDoS' threat_class, round(conf, 4) c, last_ts_us ts_us, format('{{}}:*->{{}}:{{}}_{{}}', first_source, dst_ip, top_dst_port, protocol) flow_id,
   concat('*->', dst_ip) key, window_start_us seq from flood where conf >= 0.7::double
 union all select 'Reconnaissance_Port_Scanning', round(conf, 4), last_ts_us,
   format('{{}}:*->{{}}:{{}}_{{}}', src_ip, case when max_ports_on_one_host >= max_hosts_on_one_port then vertical_target else '*' end,
     case when max_ports_on_one_host >= max_hosts_on_one_port or horizontal_port = 0 then '*' else horizontal_port::varchar end, protocol),
   concat(src_ip, '->', case when max_ports_on_one_host >= max_hosts_on_one_port then vertical_target else '*' end), window_start_us from scan where conf >= 0.7::double
 union all select 'Botnet_C2_Beaconing', c, last_us, flow_id, concat(src_ip, '->', dst_ip), flow_start_us from (select *, {BEACON_SQL} c from ff) where c >= 0.7
 union all select 'Data_Exfiltration', c, last_us, flow_id, concat(src_ip, '->', dst_ip), flow_start_us from (select *, {EXFIL_SQL} c from ff) where c >= 0.7),
al as (select threat_class, c confidence_score, {_SEVERITY.format(c='c')} severity, ts_us, flow_id, concat(key, '_', threat_class) dedup_key, seq from rules)"""


def four_rules():
    """Columns need a session, so the rules are made when a query runs."""
    return [beaconing(), exfiltration(), flood(LOW_FLOOD), port_scan(LOW_SCAN)]


def _detections(spark, sf_dir):
    return detection.detections(packets(spark, sf_dir), DetectionConfig(flow=SHORT_ACTIVE), detectors=four_rules())


@query("alert_union", _UNION_SQL + "select * exclude (seq) from al")
def alert_union(spark, sf_dir):
    out = ops.to_alerts(_detections(spark, sf_dir))
    return out.select("threat_class", "confidence_score", "severity", _us().alias("ts_us"), "flow_id", "dedup_key")


def chain_sql(key, extra=""):
    return f""",
first_at as (select {key} k, ts_us, min(flow_id) flow_id from {extra} group by all),
kept as (select k, min(ts_us) t from first_at group by k
 union all select c.k, min(a.ts_us) from kept c join first_at a on a.k = c.k and a.ts_us >= c.t + 30000000 group by c.k)"""


@query("detect_and_publish", _UNION_SQL + chain_sql("dedup_key", "al") + """,
ranked as (select *, row_number() over (partition by dedup_key, ts_us order by flow_id, seq) rn from al)
select dedup_key, ts_us, flow_id, severity, confidence_score from ranked join kept on k = dedup_key and t = ts_us where rn = 1""")
def detect_and_publish(spark, sf_dir):
    out = ops.suppress_repeats(ops.to_alerts(_detections(spark, sf_dir)))
    return out.select("dedup_key", _us().alias("ts_us"), "flow_id", "severity", "confidence_score")


@query("run_statistics", _UNION_SQL + chain_sql("dedup_key", "al") + """
select (select count(*) from v_packets) total_packets, (select sum(packet_length)::bigint from v_packets) total_bytes, (select count(*) from ff) total_flows,
 (select count(distinct ws) from w) total_windows, (select count(*) from kept) total_alerts""")
def run_statistics(spark, sf_dir):
    """Totals of a whole run; rates and latencies, which no two runs share, are left out here."""
    cfg = DetectionConfig(flow=SHORT_ACTIVE)
    _, seen = detection.run_with_statistics(packets(spark, sf_dir), cfg, None, four_rules())
    return seen.frame(spark).select("total_packets", "total_bytes", "total_flows", "total_windows", "total_alerts")


@query("alert_severity", ALERTS + f"select id, severity, {_SEVERITY.format(c='confidence_score - 0.05')} lowered from v_alerts")
def alert_severity(spark, sf_dir):
    return alerts(spark, sf_dir).select("id", ops.severity(F.col("confidence_score")).alias("severity"),
                                        ops.severity(F.col("confidence_score") - 0.05).alias("lowered"))


@query("alert_cooldown", ALERTS + chain_sql("concat(src_ip, '_', threat_class)", "v_alerts") + """
select id, concat(src_ip, '_', threat_class) dedup_key from v_alerts a join kept on k = concat(src_ip, '_', threat_class) and t = a.ts_us
join first_at f on f.k = kept.k and f.ts_us = a.ts_us and f.flow_id = a.flow_id""")
def alert_cooldown(spark, sf_dir):
    keyed = alerts(spark, sf_dir).withColumn("dedup_key", F.concat_ws("_", "src_ip", "threat_class"))
    return ops.suppress_repeats(keyed).select("id", "dedup_key")


@query("alert_ids", ALERTS + "select id source_id, row_number() over (order by ts_us, flow_id, threat_class) + 1000 id from v_alerts")
def alert_ids(spark, sf_dir):
    rows = alerts(spark, sf_dir).withColumnRenamed("id", "source_id")
    return ops.with_ids(rows, after=1000).select("source_id", "id")


@query("alert_read_back", ALERTS + f"""
select id, ts_us, json_extract_string({_OK}, '$.queried_domain') queried_domain, coalesce(json_extract_string({_OK}, '$.total_bytes')::bigint, -1) total_bytes, {_OK} evidence
from v_alerts order by id desc limit 5000""")
def alert_read_back(spark, sf_dir):
    from wiretide.sources.alert_store import parse_alerts
    rows = analytics.latest(parse_alerts(alerts(spark, sf_dir)), 5000)
    ev = F.col("evidence")
    return rows.select("id", "ts_us", text.field(ev, "queried_domain").alias("queried_domain"),
                       F.coalesce(text.field(ev, "total_bytes", "bigint"), F.lit(-1)).alias("total_bytes"), "evidence")


_CUT = "ts_us >= (select max(ts_us) from v_alerts) - 60000000"


@query("alert_filter", ALERTS + f"select id from v_alerts where {_CUT} and severity in ('CRITICAL', 'HIGH') and threat_class in ('Data_Exfiltration', 'Encrypted_Malware_TLS') and (contains(src_ip, '10.0.1') or contains(dst_ip, '10.0.1'))")
def alert_filter(spark, sf_dir):
    return analytics.filter_alerts(alerts(spark, sf_dir), 1, ["CRITICAL", "HIGH"], ["Data_Exfiltration", "Encrypted_Malware_TLS"], "10.0.1").select("id")


@query("alert_incremental", ALERTS + "select id, threat_class from v_alerts where id > 400")
def alert_incremental(spark, sf_dir):
    return analytics.since(alerts(spark, sf_dir), 400).select("id", "threat_class")


@query("alert_high_water_mark", ALERTS + "select greatest(400, max(id)) seen_id, count(*) filter (id > 400) unread from v_alerts")
def alert_high_water_mark(spark, sf_dir):
    return analytics.high_water_mark(alerts(spark, sf_dir), 400)


@query("alert_lookup", ALERTS + f"""
select id, threat_class, severity, unnest(['queried_domain', 'total_bytes']) item,
 unnest([json_extract_string({_OK}, '$.queried_domain'), json_extract_string({_OK}, '$.total_bytes')]) value from v_alerts where id = 500""")
def alert_lookup(spark, sf_dir):
    return analytics.alert_details(alerts(spark, sf_dir), 500)


@query("alert_page", ALERTS + "select id from v_alerts order by id desc limit 15 offset 30")
def alert_page(spark, sf_dir):
    return analytics.page(alerts(spark, sf_dir), 2).select("id")


@query("alert_latest_urgent", ALERTS + "select id, severity from v_alerts where severity in ('CRITICAL', 'HIGH') order by id desc limit 5")
def alert_latest_urgent(spark, sf_dir):
    return analytics.latest_urgent(alerts(spark, sf_dir)).select("id", "severity")


@query("alert_csv_rows", ALERTS + """
select id, strftime(ts + interval 330 minutes, '%Y-%m-%d %H:%M:%S') time_ist, flow_id, threat_class, severity, confidence_score from v_alerts""")
def alert_csv_rows(spark, sf_dir):
    from wiretide.sources.alert_store import csv_layout
    return csv_layout(alerts(spark, sf_dir)).select("id", "time_ist", "flow_id", "threat_class", "severity", "confidence_score")


@query("alert_titles", DIMS + """
select id, concat(glyph, ' ', sl, ' · ', short, ' (', mid, ')') title, strftime(ts + interval 330 minutes, '%d %b %Y, %H:%M:%S IST') time_ist
from v_alerts join th on cls = threat_class join lv on sev = severity""")
def alert_titles(spark, sf_dir):
    return alerts(spark, sf_dir).select("id", text.title().alias("title"), text.ist(F.col("ts")).alias("time_ist"))


_BYTES = "case when {n} < 1024 then format('{{:,.0f}} B', {n}) when {n} < 1048576 then format('{{:,.1f}} KB', {n} / 1024) else format('{{:,.1f}} MB', {n} / 1048576) end"
_DESCRIBE = f"""case threat_class
 when 'Volumetric_Protocol_DDoS' then format('Packet flood on {{}}: 0 pkt/s from 0 sources', dst_ip)
 when 'Botnet_C2_Beaconing' then format('{{}} beacons to {{}}:443 every 0.0 s (IAT variance 0.0000)', src_ip, dst_ip)
 when 'DGA_Domains_and_DNS_Tunneling' then concat(src_ip, ' resolved algorithmic domain ', coalesce(json_extract_string({_OK}, '$.queried_domain'), '?'))
 when 'Encrypted_Malware_TLS' then format('Suspicious TLS {{}} → {{}}:443: anomalous ClientHello', src_ip, dst_ip)
 when 'Reconnaissance_Port_Scanning' then format('{{}} probed 0 ports on {{}}', src_ip, dst_ip)
 else format('{{}} sent {{}} to {{}}:443 at 0 B/s', src_ip, {_BYTES.format(n="coalesce(json_extract_string(" + _OK + ", '$.total_bytes')::double, 0)")}, dst_ip) end"""


@query("alert_descriptions", ALERTS + f"select id, {_DESCRIBE} description from v_alerts")
def alert_descriptions(spark, sf_dir):
    return alerts(spark, sf_dir).select("id", text.describe().alias("description"))


# ---- analyst views ------------------------------------------------------------------------------

@query("alert_kpis", ALERTS + """
select count(*) alerts, count(*) filter (severity = 'CRITICAL') critical, count(*) filter (severity = 'HIGH') high, count(distinct src_ip) sources,
 count(distinct threat_class) vectors, round(avg(confidence_score), 6) mean_confidence from v_alerts""")
def alert_kpis(spark, sf_dir):
    return analytics.kpis(alerts(spark, sf_dir)).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("severity_counts", DIMS + "select sev severity, rk severity_rank, count(id) n from lv left join v_alerts on severity = sev group by all")
def severity_counts(spark, sf_dir):
    return analytics.severity_counts(alerts(spark, sf_dir))


@query("threat_posture", ALERTS + """,
c as (select count(*) filter (severity = 'CRITICAL') critical, count(*) filter (severity = 'HIGH') high, count(*) filter (severity = 'MEDIUM') medium, count(*) alerts, max(ts_us) last_us from v_alerts)
select *, case when critical >= 5 then 'Critical' when critical >= 1 or high >= 5 then 'Elevated' when high >= 1 then 'Guarded' else 'Nominal' end posture from c""")
def threat_posture(spark, sf_dir):
    return analytics.threat_posture(alerts(spark, sf_dir)).withColumn("last_us", _us("last_ts")).drop("last_ts")


@query("vector_counts", DIMS + "select cls threat_class, short, mid mitre_id, count(id) n from th left join v_alerts on threat_class = cls group by all")
def vector_counts(spark, sf_dir):
    return analytics.vector_counts(alerts(spark, sf_dir))


@query("severity_mix", ALERTS + "select severity, count(*) n, round(count(*) / (select count(*) from v_alerts), 6) share from v_alerts group by severity")
def severity_mix(spark, sf_dir):
    return analytics.severity_mix(alerts(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query("alert_timeline", DIMS + "select id, ts_us, short vector, severity, src_ip, dst_ip, round(confidence_score * 100, 0) confidence_percent from v_alerts join th on cls = threat_class")
def alert_timeline(spark, sf_dir):
    return analytics.timeline(alerts(spark, sf_dir)).withColumn("ts_us", _us()).drop("ts")


@query("top_sources", DIMS + """,
o as (select src_ip, string_agg(cls, ',' order by pos) classes from (select distinct src_ip, cls, pos from v_alerts join th on cls = threat_class) group by all)
select src_ip, count(*) n, count(*) filter (severity = 'CRITICAL') critical, classes from v_alerts join o using (src_ip) group by src_ip, classes order by n desc, src_ip limit 8""")
def top_sources(spark, sf_dir):
    return analytics.top_sources(alerts(spark, sf_dir)).withColumn("classes", F.array_join("classes", ","))


@query("vector_severity_matrix", DIMS + """
select pos::int "position", cls threat_class, short, mid mitre_id, count(*) filter (severity = 'CRITICAL') critical, count(*) filter (severity = 'HIGH') high,
 count(*) filter (severity = 'MEDIUM') medium, count(id) total from th left join v_alerts on threat_class = cls group by all""")
def vector_severity_matrix(spark, sf_dir):
    return analytics.vector_severity_matrix(alerts(spark, sf_dir))


_NODES = """,
ep as (select src_ip ip, 's' side, severity from v_alerts union all select dst_ip, 'd', severity from v_alerts),
nd as (select ip, count(*) involvement, case when bool_or(side = 's') and bool_or(side = 'd') then 'both' when bool_or(side = 's') then 'src' else 'dst' end role,
 min(rk) worst_rank from ep join lv on sev = severity group by ip order by involvement desc, ip limit 36)"""


@query("topology_nodes", DIMS + _NODES + "select ip, involvement, role, worst_rank::int worst_rank, 13 + least(15, 2 * involvement) size from nd")
def topology_nodes(spark, sf_dir):
    return analytics.topology_nodes(alerts(spark, sf_dir))


@query("topology_edges", DIMS + _NODES + """,
eg as (select src_ip, dst_ip, count(*) n from v_alerts group by all)
select src_ip, dst_ip, n, round(1 + 2.5::double * n / (select max(n) from eg), 6) width from eg where src_ip in (select ip from nd) and dst_ip in (select ip from nd)""")
def topology_edges(spark, sf_dir):
    return analytics.topology_edges(alerts(spark, sf_dir)).withColumn("width", F.round("width", 6))


@query("source_heatmap", ALERTS + "select src_ip, count(*) total, "
       + ", ".join(f"count(*) filter (threat_class = '{c}') c{i}" for i, c in enumerate(catalog.CLASSES))
       + " from v_alerts group by src_ip order by total desc, src_ip limit 20")
def source_heatmap(spark, sf_dir):
    return analytics.source_heatmap(alerts(spark, sf_dir))


@query("kill_chain", DIMS + ", st as (select * from " + _dim(list(enumerate(catalog.KILL_CHAIN)), "t(stage_order, stage)") + """),
hit as (select kc, string_agg(short, ', ' order by pos) vectors from th where cls in (select threat_class from v_alerts) group by kc)
select stage_order::int stage_order, stage, coalesce(vectors, '') vectors from st left join hit on kc = stage""")
def kill_chain(spark, sf_dir):
    return analytics.kill_chain(alerts(spark, sf_dir))


@query("mitre_coverage", DIMS + ", tc as (select * from " + _dim(list(enumerate(catalog.TACTICS)), "t(tactic_order, tac)") + """)
select tactic_order::int tactic_order, tactic, mid mitre_id, technique, cls threat_class, count(id) n, round(avg(confidence_score), 6) mean_confidence, count(id) > 0 observed
from th join tc on tac = tactic left join v_alerts on threat_class = cls group by all""")
def mitre_coverage(spark, sf_dir):
    return analytics.mitre_coverage(alerts(spark, sf_dir)).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("report_summary", ALERTS + """
select count(*) total, count(*) filter (severity = 'CRITICAL') critical, count(*) filter (severity = 'HIGH') high, count(*) filter (severity = 'MEDIUM') medium,
 count(distinct src_ip) sources, min(ts_us) first_us, max(ts_us) last_us from v_alerts""")
def report_summary(spark, sf_dir):
    out = analytics.report_summary(alerts(spark, sf_dir))
    return out.withColumns({"first_us": _us("first_ts"), "last_us": _us("last_ts")}).drop("first_ts", "last_ts")


@query("report_techniques", DIMS + "select threat_class, mid mitre_id, tactic, technique, count(*) n from v_alerts join th on cls = threat_class group by all")
def report_techniques(spark, sf_dir):
    return report.technique_counts(alerts(spark, sf_dir))


@query("report_top_sources", ALERTS + "select src_ip, count(*) n, array_to_string(list_sort(list(distinct threat_class)), ', ') classes from v_alerts group by src_ip order by n desc, src_ip limit 10")
def report_top_sources(spark, sf_dir):
    return analytics.report_top_sources(alerts(spark, sf_dir))


_WORST = "order by rk, confidence_score desc, id limit 50"


@query("report_incidents", DIMS + f"select id, severity, threat_class, mid mitre_id, confidence_score, flow_id from v_alerts join lv on sev = severity join th on cls = threat_class {_WORST}")
def report_incidents(spark, sf_dir):
    return report.incidents(alerts(spark, sf_dir)).select("id", "severity", "threat_class", "mitre_id", "confidence_score", "flow_id")


@query("report_evidence", DIMS + f"""
, tp as (select id, {_OK} ev from v_alerts join lv on sev = severity {_WORST}),
it as (select id, unnest(['Queried Domain', 'Total Bytes']) item, unnest([json_extract_string(ev, '$.queried_domain'), json_extract_string(ev, '$.total_bytes')]) value from tp)
select * from it where value is not null""")
def report_evidence(spark, sf_dir):
    return report.evidence_rows(alerts(spark, sf_dir))


@query("alert_digest", DIMS + """,
r as (select a.*, rk, count(*) over (partition by threat_class) n, row_number() over (partition by threat_class order by rk, id desc) rn from v_alerts a join lv on sev = severity)
select threat_class, n, id, rk::int severity_rank, case when n > 1 then format('+{} more of this type', n - 1) else '' end more from r where rn = 1 order by rk, n desc, threat_class limit 6""")
def alert_digest(spark, sf_dir):
    return analytics.digest(alerts(spark, sf_dir)).select("threat_class", "n", "id", "severity_rank", "more")


@query("capture_summary", DIMS + "select threat_class, short, mid mitre_id, count(*) n from v_alerts join th on cls = threat_class group by all")
def capture_summary(spark, sf_dir):
    return analytics.capture_summary(alerts(spark, sf_dir))


# ---- response -----------------------------------------------------------------------------------

_LABEL = ("case when len(string_split(dom, '.')) >= 2 then string_split(dom, '.')[-2] else dom end")
# CRC-32 of an ASCII text, one bit a step: a number is a byte to take in, -1 a shift
_CRC = ("xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split({key}, ''), lambda ch: [unicode(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), "
        "lambda crc, x: case when x >= 0 then xor(crc, x) else xor(crc >> 1, 3988292384 * (crc & 1)) end), 4294967295)")
_SID = "9000000 + " + _CRC.format(key="concat(flow_id, '|', threat_class, '|', strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S'), "
                                  "case when ts_us % 1000000 <> 0 then strftime(make_timestamp(ts_us), '.%f') else '' end, '+00:00')") + " % 999999"
_RULES = ALERTS + f""",
e as (select *, ({_SID})::varchar sid, coalesce(json_extract_string({_OK}, '$.queried_domain'), '') dom, concat('THREAT ', threat_class, ' ', severity) msg from v_alerts),
rl as (select id, threat_class, flow_id, sid, list_transform(case threat_class
  when 'Volumetric_Protocol_DDoS' then [format('iptables -A INPUT -d {{}} -p tcp --syn -m hashlimit --hashlimit-name ddos_SID --hashlimit-above 100/second --hashlimit-mode srcip -j DROP', dst_ip)]
  when 'Reconnaissance_Port_Scanning' then [format('iptables -A INPUT -s {{}} -j DROP', src_ip)]
  when 'Botnet_C2_Beaconing' then [format('iptables -A FORWARD -s {{}} -d {{}} -j DROP', src_ip, dst_ip), format('iptables -A FORWARD -d {{}} -j DROP', dst_ip)]
  when 'DGA_Domains_and_DNS_Tunneling' then case when dom <> '' then [format('iptables -A FORWARD -s {{}} -p udp --dport 53 -m string --string {{}} --algo bm -j DROP', src_ip, {_LABEL})] else [] end
  when 'Encrypted_Malware_TLS' then [format('iptables -A FORWARD -d {{}} -p tcp --dport 443 -j DROP', dst_ip)]
  else [format('iptables -A FORWARD -s {{}} -d {{}} -j DROP', src_ip, dst_ip)] end, lambda line: replace(line, 'SID', sid)) fw,
 list_transform(case threat_class
  when 'Volumetric_Protocol_DDoS' then [format('drop tcp any any -> {{}} 443 (msg:"{{}} SYN flood"; flags:S,12; detection_filter:track by_dst, count 300, seconds 1; sid:SID; rev:1;)', dst_ip, msg)]
  when 'Reconnaissance_Port_Scanning' then [format('drop tcp {{}} any -> any any (msg:"{{}} probe"; flags:S,12; detection_filter:track by_src, count 10, seconds 3; sid:SID; rev:1;)', src_ip, msg)]
  when 'Botnet_C2_Beaconing' then [format('drop tcp {{}} any -> {{}} 443 (msg:"{{}} C2 check-in"; sid:SID; rev:1;)', src_ip, dst_ip, msg)]
  when 'DGA_Domains_and_DNS_Tunneling' then case when dom <> '' then [format('drop dns any any -> any any (msg:"{{}} {{}}"; dns.query; content:"{{}}"; nocase; sid:SID; rev:1;)', msg, dom, dom)] else [] end
  when 'Encrypted_Malware_TLS' then [format('drop tls {{}} any -> {{}} 443 (msg:"{{}}"; sid:SID; rev:1;)', src_ip, dst_ip, msg)]
  else [format('drop tcp {{}} any -> {{}} 443 (msg:"{{}} bulk egress"; dsize:>1000; detection_filter:track by_src, count 20, seconds 5; sid:SID; rev:1;)', src_ip, dst_ip, msg)] end, lambda line: replace(line, 'SID', sid)) ids from e)"""


@query("response_rules", _RULES + r"select id, array_to_string(fw, chr(10)) firewall_rules, array_to_string(ids, chr(10)) ids_rules from rl")
def response_rules(spark, sf_dir):
    rows = response.with_rules(alerts(spark, sf_dir))
    return rows.select("id", F.array_join("firewall_rules", "\n").alias("firewall_rules"), F.array_join("ids_rules", "\n").alias("ids_rules"))


@query("rule_bundle", _RULES + """,
ln as (select 'firewall' kind, id, threat_class, flow_id, unnest(fw) line, unnest(range(len(fw))) p from rl
 union all select 'ids', id, threat_class, flow_id, unnest(ids), unnest(range(len(ids))) from rl),
rn as (select *, row_number() over (partition by kind, line order by id, p) n from ln)
select kind, id, p::int "position", concat('# alert ', id, ' ', threat_class, ' ', flow_id) header, line from rn where n = 1""")
def rule_bundle(spark, sf_dir):
    return response.rule_bundle(alerts(spark, sf_dir))
