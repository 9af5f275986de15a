"""Packet and window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretide.config import FloodConfig, ScanConfig, WindowConfig
from wiretide.fixtures import ctes, view
from wiretide.functions.net import INTERNAL_V4, cidr_join, is_broadcast_or_multicast, is_internal
from wiretide.operators import windows as w
from wiretide.operators.detection import scan_flow
from wiretide.operators.detectors import flood, port_scan, score
from wiretide.operators.features import host_vector_columns
from wiretide.registry import query
from wiretide.schema import flow_id, half_open, is_probe, normalize_packets

LOW_FLOOD = FloodConfig(pps_threshold=10.0, min_packets=20)
LOW_SCAN = ScanConfig(min_ports=2, min_hosts=3)

GRID = ctes("v_packets") + """,
bnd as (select min(ts_us) o, max(ts_us) m from v_packets),
grid as (select o, case when m < o + {size} then 0 else (m - o - {size}) // {slide} + 1 end u from bnd),
w as (select p.*, o + k * {slide} ws from (
  select v.*, o, u, (ts_us - o) // {slide} - j k from v_packets v, grid, (select unnest(range(0, {per})) j)) p
  where k between 0 and u and ts_us < o + k * {slide} + {size})"""


def grid(size: int = 3_000_000, slide: int = 1_000_000) -> str:
    return GRID.format(size=size, slide=slide, per=-(-size // slide))


FAN_IN = grid() + """,
fi_n as (select ws, dst_ip, src_ip, count(*) n, min(pkt_id) f from w group by all),
fi_e as (select ws, dst_ip, sum(n) t, count(*) us, log2(sum(n)) - sum(n * log2(n)) / sum(n) + 0.0 ent from fi_n group by all),
fi_r as (select *, row_number() over (partition by ws, dst_ip order by n desc, f) rn from fi_n),
fi_t as (select ws, dst_ip, string_agg(src_ip, ',' order by rn) top_sources, arg_min(src_ip, rn) first_source from fi_r where rn <= 5 group by all),
fi_p as (select ws, dst_ip, dst_port, row_number() over (partition by ws, dst_ip order by count(*) desc, min(pkt_id)) rn from w group by ws, dst_ip, dst_port),
fi_q as (select ws, dst_ip, protocol, row_number() over (partition by ws, dst_ip order by count(*) desc, min(pkt_id)) rn from w group by ws, dst_ip, protocol),
fi_s as (select ws, dst_ip, max(c) peak_pps from (select ws, dst_ip, (ts_us - ws) // 1000000 b, count(*) c from w group by all) group by all),
fi_a as (select ws, dst_ip, count(*) packets, sum(packet_length)::bigint bytes, count(*) filter (syn and not ack) / count(*) syn_only_ratio,
  count(*) filter (protocol = 'UDP') / count(*) udp_ratio, min(ts_us) first_ts_us, max(ts_us) last_ts_us from w group by all),
fan_in as (select a.ws window_start_us, a.dst_ip, packets, bytes, peak_pps, syn_only_ratio, udp_ratio, us unique_sources,
  greatest(0.0, ent) source_ip_entropy, top_sources, first_source, p.dst_port top_dst_port, q.protocol, first_ts_us, last_ts_us
  from fi_a a join fi_e using (ws, dst_ip) join fi_t using (ws, dst_ip) join fi_s using (ws, dst_ip)
  join fi_p p on p.ws = a.ws and p.dst_ip = a.dst_ip and p.rn = 1
  join fi_q q on q.ws = a.ws and q.dst_ip = a.dst_ip and q.rn = 1)"""

PROBE = "(case protocol when 'TCP' then syn and not ack when 'UDP' then payload_length = 0 else protocol = 'ICMP' end)"

_FAN_OUT = f""",
pr as (select *, {PROBE} probe from w),
fo_h as (select ws, src_ip, dst_ip, count(distinct dst_port) n, min(pkt_id) f, string_agg(distinct dst_port::varchar, ',' order by dst_port::varchar) ports
  from pr where probe group by all),
fo_v as (select *, row_number() over (partition by ws, src_ip order by n desc, f) rn from fo_h),
fo_x as (select ws, src_ip, dst_port, count(distinct dst_ip) n, min(pkt_id) f from pr where probe group by all),
fo_y as (select *, row_number() over (partition by ws, src_ip order by n desc, f) rn from fo_x),
fo_q as (select ws, src_ip, protocol, row_number() over (partition by ws, src_ip order by count(*) desc, min(pkt_id)) rn from pr group by ws, src_ip, protocol),
fo_a as (select ws, src_ip, count(*) packets, count(*) filter (probe) / count(*) probe_ratio, count(distinct dst_ip) unique_targets,
  min(ts_us) first_ts_us, max(ts_us) last_ts_us from pr group by all),
fan_out as (select a.ws window_start_us, a.src_ip, packets, probe_ratio, unique_targets, coalesce(v.n, 0) max_ports_on_one_host,
  coalesce(v.dst_ip, '') vertical_target, coalesce(v.ports, '') probed_ports, coalesce(y.n, 0) max_hosts_on_one_port,
  coalesce(y.dst_port, 0) horizontal_port, q.protocol, first_ts_us, last_ts_us
  from fo_a a left join fo_v v on v.ws = a.ws and v.src_ip = a.src_ip and v.rn = 1
  left join fo_y y on y.ws = a.ws and y.src_ip = a.src_ip and y.rn = 1
  join fo_q q on q.ws = a.ws and q.src_ip = a.src_ip and q.rn = 1)"""
FAN_OUT = grid() + _FAN_OUT
BOTH = FAN_IN + _FAN_OUT


def packets(spark, sf_dir):
    return view(spark, sf_dir, "v_packets")


def targets(spark, sf_dir, cfg=WindowConfig()):
    return w.fan_in(w.pane_counts(packets(spark, sf_dir), cfg), cfg)


def sources(spark, sf_dir, cfg=WindowConfig()):
    return w.fan_out(w.pane_counts(packets(spark, sf_dir), cfg), cfg)


def _r(name, digits=6):
    return F.round(name, digits).alias(name if isinstance(name, str) else None)


@query("packet_view", ctes("v_packets") + """
select *, format('{}:{}->{}:{}_{}', src_ip, src_port, dst_ip, dst_port, protocol) flow_id from v_packets""")
def packet_view(spark, sf_dir):
    return packets(spark, sf_dir).withColumn("flow_id", flow_id())


@query("probe_flags", ctes("v_packets") + f"""
select pkt_id, syn and not ack half_open, {PROBE} probe from v_packets""")
def probe_flags(spark, sf_dir):
    return normalize_packets(packets(spark, sf_dir)).select("pkt_id", half_open().alias("half_open"), is_probe().alias("probe"))


@query("window_fan_in", FAN_IN + """
select window_start_us, dst_ip, packets, bytes, round(syn_only_ratio, 6) syn_only_ratio, round(udp_ratio, 6) udp_ratio,
 unique_sources, first_ts_us, last_ts_us from fan_in""")
def window_fan_in(spark, sf_dir):
    return targets(spark, sf_dir).select("window_start_us", "dst_ip", "packets", "bytes", _r("syn_only_ratio"), _r("udp_ratio"),
                                         "unique_sources", "first_ts_us", "last_ts_us")


@query("window_peak_pps", FAN_IN + "select window_start_us, dst_ip, peak_pps from fan_in")
def window_peak_pps(spark, sf_dir):
    return targets(spark, sf_dir).select("window_start_us", "dst_ip", "peak_pps")


@query("window_source_entropy", FAN_IN + "select window_start_us, dst_ip, unique_sources, round(source_ip_entropy, 6) source_ip_entropy from fan_in")
def window_source_entropy(spark, sf_dir):
    return targets(spark, sf_dir).select("window_start_us", "dst_ip", "unique_sources", _r("source_ip_entropy"))


@query("window_top_sources", FAN_IN + "select window_start_us, dst_ip, top_sources from fan_in")
def window_top_sources(spark, sf_dir):
    return targets(spark, sf_dir).select("window_start_us", "dst_ip", F.array_join("top_sources", ",").alias("top_sources"))


@query("window_modal_port", FAN_IN + "select window_start_us, dst_ip, top_dst_port, protocol from fan_in")
def window_modal_port(spark, sf_dir):
    return targets(spark, sf_dir).select("window_start_us", "dst_ip", "top_dst_port", "protocol")


@query("window_fan_out", FAN_OUT + """
select window_start_us, src_ip, packets, round(probe_ratio, 6) probe_ratio, unique_targets, protocol, first_ts_us, last_ts_us from fan_out""")
def window_fan_out(spark, sf_dir):
    return sources(spark, sf_dir).select("window_start_us", "src_ip", "packets", _r("probe_ratio"), "unique_targets", "protocol",
                                         "first_ts_us", "last_ts_us")


@query("window_vertical_scan", FAN_OUT + "select window_start_us, src_ip, max_ports_on_one_host, vertical_target, probed_ports from fan_out")
def window_vertical_scan(spark, sf_dir):
    ports = F.array_join(F.array_sort(F.transform("probed_ports", lambda p: p.cast("string"))), ",").alias("probed_ports")
    return sources(spark, sf_dir).select("window_start_us", "src_ip", "max_ports_on_one_host", "vertical_target", ports)


@query("window_horizontal_scan", FAN_OUT + "select window_start_us, src_ip, max_hosts_on_one_port, horizontal_port from fan_out")
def window_horizontal_scan(spark, sf_dir):
    return sources(spark, sf_dir).select("window_start_us", "src_ip", "max_hosts_on_one_port", "horizontal_port")


@query("window_tumbling", grid(3_000_000, 3_000_000) + """
select ws window_start_us, dst_ip, count(*) packets, count(distinct src_ip) unique_sources from w group by all""")
def window_tumbling(spark, sf_dir):
    cfg = WindowConfig(slide_us=3_000_000)
    return targets(spark, sf_dir, cfg).select("window_start_us", "dst_ip", "packets", "unique_sources")


_HOSTS = BOTH + """,
hosts as (select coalesce(t.window_start_us, s.window_start_us) window_start_us, coalesce(t.dst_ip, s.src_ip) host,
  coalesce(t.packets, 0) in_packets, coalesce(peak_pps, 0) in_peak_pps, coalesce(syn_only_ratio, 0) in_syn_only_ratio,
  coalesce(udp_ratio, 0) in_udp_ratio, coalesce(unique_sources, 0) in_unique_sources, coalesce(source_ip_entropy, 0) in_source_ip_entropy,
  coalesce(s.packets, 0) out_packets, coalesce(probe_ratio, 0) out_probe_ratio, coalesce(max_ports_on_one_host, 0) out_max_ports_on_one_host,
  coalesce(max_hosts_on_one_port, 0) out_max_hosts_on_one_port, coalesce(unique_targets, 0) out_unique_targets,
  t.dst_ip is not null is_target, s.src_ip is not null is_source
  from fan_in t full join fan_out s on t.window_start_us = s.window_start_us and t.dst_ip = s.src_ip)"""


def host_rows(spark, sf_dir):
    panes = w.pane_counts(packets(spark, sf_dir))
    return w.hosts(w.fan_in(panes), w.fan_out(panes))


@query("host_full_outer", _HOSTS + """
select window_start_us, host, is_target, is_source, in_packets, in_peak_pps, in_unique_sources, round(in_source_ip_entropy, 6) in_source_ip_entropy,
 out_packets, round(out_probe_ratio, 6) out_probe_ratio, out_max_ports_on_one_host, out_max_hosts_on_one_port, out_unique_targets from hosts""")
def host_full_outer(spark, sf_dir):
    return host_rows(spark, sf_dir).select(
        "window_start_us", "host", "is_target", "is_source", "in_packets", "in_peak_pps", "in_unique_sources", _r("in_source_ip_entropy"),
        "out_packets", _r("out_probe_ratio"), "out_max_ports_on_one_host", "out_max_hosts_on_one_port", "out_unique_targets")


# Lower than in production, where the thresholds are 50 and 5
_CANDIDATE = "in_packets >= 20 or out_max_ports_on_one_host >= 2 or out_max_hosts_on_one_port >= 2"


@query("host_candidates", _HOSTS + f"select window_start_us, host, in_packets, out_packets from hosts where {_CANDIDATE}")
def host_candidates(spark, sf_dir):
    return w.candidate_hosts(host_rows(spark, sf_dir), 20, 2).select("window_start_us", "host", "in_packets", "out_packets")


@query("host_vector", _HOSTS + """
select window_start_us, host, round(ln(1 + in_packets), 6) in_log_packets, round(ln(1 + in_peak_pps), 6) in_log_peak_pps,
 round(in_syn_only_ratio, 6) in_syn_only_ratio, round(in_udp_ratio, 6) in_udp_ratio, round(ln(1 + in_unique_sources), 6) in_log_sources,
 round(in_source_ip_entropy, 6) in_source_entropy, round(ln(1 + out_packets), 6) out_log_packets, round(out_probe_ratio, 6) out_probe_ratio,
 round(ln(1 + out_max_ports_on_one_host), 6) out_log_ports_one_host, round(ln(1 + out_max_hosts_on_one_port), 6) out_log_hosts_one_port,
 round(ln(1 + out_unique_targets), 6) out_log_targets from hosts""")
def host_vector(spark, sf_dir):
    return host_rows(spark, sf_dir).select("window_start_us", "host", *[F.round(c, 6).alias(n) for n, c in host_vector_columns().items()])


_FLOOD_SQL = """,
flood as (select *, case when packets >= 20 and peak_pps >= 10 then least(0.99::double, 0.45::double + (case when peak_pps >= 30 then 0.15 else 0 end)::double
  + (case when syn_only_ratio >= 0.8 then 0.35 when udp_ratio >= 0.8 and (unique_sources >= 5 or peak_pps >= 30) then 0.25 else 0 end)::double
  + (case when unique_sources >= 50 then 0.15 else 0 end)::double) else 0::double end conf from fan_in)"""


@query("ddos_window_scores", FAN_IN + _FLOOD_SQL + """
select window_start_us, dst_ip, round(conf, 4) confidence, conf >= 0.7::double is_threat,
 case when conf >= 0.9::double then 'CRITICAL' when conf >= 0.8::double then 'HIGH' when conf >= 0.7::double then 'MEDIUM' else 'LOW' end severity from flood""")
def ddos_window_scores(spark, sf_dir):
    from wiretide.operators.alerts import severity
    scored = score(targets(spark, sf_dir), flood(LOW_FLOOD))
    return scored.select("window_start_us", "dst_ip", "confidence", "is_threat", severity(F.col("confidence")).alias("severity"))


@query("ddos_evidence", FAN_IN + _FLOOD_SQL + """
select window_start_us, dst_ip, format('{}:*->{}:{}_{}', first_source, dst_ip, top_dst_port, protocol) flow_id, concat('*->', dst_ip) dedup_key,
 concat_ws('; ', concat(peak_pps, ' pps peak (threshold 10)'),
  case when syn_only_ratio >= 0.8 then format('{:.0f}% half-open SYN packets', syn_only_ratio * 100)
       when udp_ratio >= 0.8 and (unique_sources >= 5 or peak_pps >= 30) then format('{:.0f}% UDP packets', udp_ratio * 100) end,
  case when unique_sources >= 50 then concat(unique_sources, ' distinct sources (distributed)') end) indicators
from flood where packets >= 20 and peak_pps >= 10""")
def ddos_evidence(spark, sf_dir):
    from wiretide.functions.text import text_list
    rows = score(targets(spark, sf_dir), flood(LOW_FLOOD)).filter("packets >= 20 and peak_pps >= 10")
    return rows.select("window_start_us", "dst_ip",
                       F.format_string("%s:*->%s:%d_%s", F.element_at("top_sources", 1), "dst_ip", "top_dst_port", "protocol").alias("flow_id"),
                       F.concat(F.lit("*->"), F.col("dst_ip")).alias("dedup_key"),
                       F.array_join(text_list(F.col("evidence"), "indicators"), "; ").alias("indicators"))


_SCAN_SQL = """,
scan as (select *, case when probe_ratio >= 0.6 and (max_ports_on_one_host >= 2 or max_hosts_on_one_port >= 3) then
   (case when max_ports_on_one_host >= 2 then case when max_ports_on_one_host >= 100 then 0.92 when max_ports_on_one_host >= 25 then 0.85 else 0.75 end
    else case when max_hosts_on_one_port >= 100 then 0.92 when max_hosts_on_one_port >= 50 then 0.85 else 0.75 end end)::double
   + (case when probe_ratio >= 0.9 then 0.05 else 0 end)::double else 0::double end conf from fan_out)"""


@query("port_scan_scores", FAN_OUT + _SCAN_SQL + """
select window_start_us, src_ip, round(conf, 4) confidence, conf >= 0.7::double is_threat,
 case when probe_ratio >= 0.6 and max_ports_on_one_host >= 2 then 'vertical (many ports, one host)'
      when probe_ratio >= 0.6 and max_hosts_on_one_port >= 3 then 'horizontal (one port, many hosts)' else 'none' end scan_type,
 format('{}:*->{}:{}_{}', src_ip, case when max_ports_on_one_host >= max_hosts_on_one_port then vertical_target else '*' end,
  case when max_ports_on_one_host >= max_hosts_on_one_port or horizontal_port = 0 then '*' else horizontal_port::varchar end, protocol) flow_id
from scan""")
def port_scan_scores(spark, sf_dir):
    from wiretide.functions.text import field
    scored = score(sources(spark, sf_dir), port_scan(LOW_SCAN))
    return scored.select("window_start_us", "src_ip", "confidence", "is_threat", field(F.col("evidence"), "scan_type").alias("scan_type"),
                         scan_flow()["flow_id"].alias("flow_id"))


# ---- addresses ----------------------------------------------------------------------------------

_LONG = ("(split_part({c}, '.', 1)::bigint * 16777216 + split_part({c}, '.', 2)::bigint * 65536 "
         "+ split_part({c}, '.', 3)::bigint * 256 + split_part({c}, '.', 4)::bigint)")
_INTERNAL = ("(case when {c} like '10.%' or {c} like '192.168.%' or {c} like '127.%' or {c} like '169.254.%' then true "
             "when {c} like '172.%' then split_part({c}, '.', 2)::int between 16 and 31 "
             "when {c} like '100.%' then split_part({c}, '.', 2)::int between 64 and 127 else false end)")


def internal_sql(column: str) -> str:
    return _INTERNAL.format(c=column)


@query("internal_addresses", ctes("v_packets") + f"""
select pkt_id, {internal_sql('src_ip')} src_internal, {internal_sql('dst_ip')} dst_internal,
 split_part(dst_ip, '.', 1)::int between 224 and 239 or dst_ip like '%.255' dst_broadcast from v_packets""")
def internal_addresses(spark, sf_dir):
    return packets(spark, sf_dir).select("pkt_id", is_internal(F.col("src_ip")).alias("src_internal"),
                                         is_internal(F.col("dst_ip")).alias("dst_internal"),
                                         is_broadcast_or_multicast(F.col("dst_ip")).alias("dst_broadcast"))


@query("internal_cidr_join", ctes("v_packets") + f"""
select dst_ip, {internal_sql('dst_ip')} inside, count(*) packets from v_packets group by all""")
def internal_cidr_join(spark, sf_dir):
    networks = spark.createDataFrame([(c,) for c in INTERNAL_V4], "cidr string")
    ips = packets(spark, sf_dir).groupBy(F.col("dst_ip").alias("ip")).agg(F.count("*").alias("packets"))
    return cidr_join(ips, networks).select(F.col("ip").alias("dst_ip"), "inside", "packets")
