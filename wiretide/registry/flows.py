"""Flow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretide.config import FlowConfig
from wiretide.fixtures import ctes, view
from wiretide.operators.detectors import DISCOVERY_PORTS, SERVICE_PORTS, beaconing, client_egress, exfiltration, score
from wiretide.operators.features import COMMON_SERVICE_PORTS, fill_defaults, flow_features, flow_vector_columns
from wiretide.operators.flows import flows
from wiretide.registry import query
from wiretide.registry.windows import internal_sql, packets

IDLE = FlowConfig(active_us=None)
SHORT_ACTIVE = FlowConfig(active_us=30_000_000)
_KEY = "src_ip, dst_ip, src_port, dst_port, protocol"


def flow_ctes(active_us: int | None, views: tuple[str, ...] = ("v_packets",)) -> str:
    """Flows of the packet view by plain window functions and a recursive chain."""
    text = ctes(*views) + f""",
pk as (select *, format('{{}}:{{}}->{{}}:{{}}_{{}}', src_ip, src_port, dst_ip, dst_port, protocol) fk from v_packets),
g as (select *, lag(ts_us) over (partition by fk order by ts_us, pkt_id) prev from pk),
s as (select *, sum(case when prev is null or ts_us - prev >= 15000000 then 1 else 0 end)
  over (partition by fk order by ts_us, pkt_id rows unbounded preceding) seg from g)"""
    if active_us is None:
        text += """,
starts as (select fk, seg, min(ts_us) st from s group by all)"""
    else:
        text += f""",
starts as (select fk, seg, min(ts_us) st from s group by all
 union all
 select c.fk, c.seg, min(s.ts_us) from starts c join s on s.fk = c.fk and s.seg = c.seg and s.ts_us >= c.st + {active_us} group by c.fk, c.seg)"""
    return text + f""",
q as (select s.*, c.st from s asof join starts c on s.fk = c.fk and s.seg = c.seg and s.ts_us >= c.st),
x as (select *, (ts_us - lag(ts_us) over f) / 1e6 gap, row_number() over f pos from q window f as (partition by fk, st order by ts_us, pkt_id)),
fl as (select fk flow_id, {_KEY}, st flow_start_us, max(ts_us) last_us, count(*) packet_count, sum(packet_length)::bigint total_bytes,
  sum(payload_length)::bigint payload_bytes, count(*) filter (syn) syn_count, count(*) filter (ack) ack_count,
  count(*) filter (fin) fin_count, count(*) filter (rst) rst_count, count(*) filter (psh) psh_count,
  (max(ts_us) - st) / 1e6 duration, avg(packet_length) pkt_len_mean, stddev_pop(packet_length) pkt_len_std,
  min(packet_length) pkt_len_min, max(packet_length) pkt_len_max, count(gap) gaps,
  coalesce(avg(gap), 0) iat_mean, case when count(gap) > 1 then var_pop(gap) else 0 end iat_variance,
  case when count(gap) > 1 then stddev_pop(gap) else 0 end iat_std, min(pkt_id) first_pkt from x group by fk, {_KEY}, st),
ff as (select *, iat_std / (iat_mean + 1e-6) iat_cv, packet_count / greatest(0.0001::double, duration) packets_per_second,
  total_bytes / greatest(0.0001::double, duration) bytes_per_second, syn_count / (ack_count + 1) syn_ratio,
  payload_bytes / (greatest(0, total_bytes - payload_bytes) + 1) payload_to_header_ratio from fl)"""


# Gap figures are rounded to nanoseconds: means of few gaps would be ties at microseconds. The square of
# half a difference can only be a tie at an odd number of digits.
def _digits(name, digits):
    return 8 if name == "iat_variance" and digits == 9 else digits


def _rounded(*names, digits=6):
    return [F.round(n, _digits(n, digits)).alias(n) for n in names]


def _rsql(*names, digits=6):
    return ", ".join(f"round({n}::double, {_digits(n, digits)}) {n}" for n in names)


_COUNTERS = ("packet_count", "total_bytes", "payload_bytes", "syn_count", "ack_count", "fin_count", "rst_count", "psh_count")


@query("flow_segments", flow_ctes(None) + f"select flow_id, flow_start_us, last_us, {', '.join(_COUNTERS)}, {_rsql('duration')} from ff")
def flow_segments(spark, sf_dir):
    return flows(packets(spark, sf_dir), IDLE, splt=False).select("flow_id", "flow_start_us", "last_us", *_COUNTERS, *_rounded("duration"))


@query("flow_active_chain", flow_ctes(30_000_000) + f"select flow_id, flow_start_us, last_us, packet_count, total_bytes, gaps, {_rsql('iat_mean', 'iat_variance', digits=9)} from ff")
def flow_active_chain(spark, sf_dir):
    return flows(packets(spark, sf_dir), SHORT_ACTIVE, splt=False).select(
        "flow_id", "flow_start_us", "last_us", "packet_count", "total_bytes", "gaps", *_rounded("iat_mean", "iat_variance", digits=9))


_MOMENTS = ("pkt_len_mean", "pkt_len_std", "iat_mean", "iat_std", "iat_variance", "iat_cv")


@query("flow_iat_stats", flow_ctes(120_000_000) + f"select flow_id, flow_start_us, gaps, pkt_len_min, pkt_len_max, {_rsql(*_MOMENTS, digits=9)} from ff")
def flow_iat_stats(spark, sf_dir):
    return flows(packets(spark, sf_dir), splt=False).select("flow_id", "flow_start_us", "gaps", "pkt_len_min", "pkt_len_max", *_rounded(*_MOMENTS, digits=9))


@query("flow_splt", flow_ctes(30_000_000) + """,
sp as (select fk flow_id, st flow_start_us, list(packet_length order by pos) filter (pos <= 30) l from x group by all)
select flow_id, flow_start_us, array_to_string(list_resize(l, 30, 0), ',') splt from sp""")
def flow_splt(spark, sf_dir):
    text = F.array_join(F.transform("splt", lambda v: v.cast("string")), ",").alias("splt")
    return flows(packets(spark, sf_dir), SHORT_ACTIVE).select("flow_id", "flow_start_us", text)


_RATES = ("packets_per_second", "bytes_per_second", "syn_ratio", "payload_to_header_ratio")
_NET = f"""(case when {internal_sql('src_ip')} then 1 else 0 end)::double src_internal, (case when {internal_sql('dst_ip')} then 1 else 0 end)::double dst_internal,
 (case when protocol in ('TCP', 'UDP') then 0 else 1 end)::double is_portless, (case when dst_ip like '%.255' then 1 else 0 end)::double dst_broadcast"""


@query("flow_features", flow_ctes(30_000_000) + f"select flow_id, flow_start_us, {_rsql(*_RATES)}, {_NET}, round(greatest(0.0001::double, duration), 6) duration from ff")
def features(spark, sf_dir):
    rows = flow_features(flows(packets(spark, sf_dir), SHORT_ACTIVE, splt=False))
    return rows.select("flow_id", "flow_start_us", *_rounded(*_RATES, "duration"), "src_internal", "dst_internal", "is_portless", "dst_broadcast")


def _in(column, ports):
    return f"{column} in ({', '.join(map(str, ports))})"


_VECTOR_SQL = {
    "log_packets": "ln(1 + packet_count)", "log_bytes": "ln(1 + total_bytes)", "log_duration": "ln(1 + greatest(0.0001::double, duration))",
    "log_pps": "ln(1 + packets_per_second)", "log_bps": "ln(1 + bytes_per_second)", "pkt_len_mean": "pkt_len_mean",
    "pkt_len_std": "pkt_len_std", "iat_mean": "least(120, iat_mean)", "iat_cv": "least(10, iat_cv)", "syn_share": "syn_count / packet_count",
    "ack_share": "ack_count / packet_count", "log_payload_ratio": "ln(1 + payload_to_header_ratio)",
    "is_dns": "case when src_port = 53 or dst_port = 53 then 1 else 0 end",
    "dst_port_common": f"case when {_in('dst_port', COMMON_SERVICE_PORTS)} then 1 else 0 end",
    "pkt_len_min": "pkt_len_min", "pkt_len_max": "pkt_len_max", "iat_std": "least(120, iat_std)",
    "is_portless": "case when protocol in ('TCP', 'UDP') then 0 else 1 end", "src_internal": f"case when {internal_sql('src_ip')} then 1 else 0 end",
    "dst_internal": f"case when {internal_sql('dst_ip')} then 1 else 0 end",
    "src_port_ephemeral": f"case when src_port >= 1024 and not {_in('src_port', COMMON_SERVICE_PORTS)} then 1 else 0 end",
}


@query("flow_vector", flow_ctes(30_000_000) + "select flow_id, flow_start_us, "
       + ", ".join(f"round(({e})::double, 9) {n}" for n, e in _VECTOR_SQL.items()) + " from ff")
def flow_vector(spark, sf_dir):
    rows = flow_features(flows(packets(spark, sf_dir), SHORT_ACTIVE, splt=False))
    columns = flow_vector_columns()
    return rows.select("flow_id", "flow_start_us", *[F.round(columns[n], 9).alias(n) for n in _VECTOR_SQL])


BEACON_SQL = f"""case when protocol not in ('TCP', 'UDP') or dst_ip like '%.255' or {_in('src_port', DISCOVERY_PORTS)} or {_in('dst_port', DISCOVERY_PORTS)}
  or payload_to_header_ratio < 0.1 then 0 when packet_count >= 5 and iat_mean > 0.5 then
  case when iat_variance < 0.01 then 0.92 when iat_variance < 0.05 and iat_cv < 0.15 then 0.82 when iat_variance < 0.15 and iat_cv < 0.3 then 0.65 else 0 end
  else 0 end::double"""
_CLIENT = f"(src_port >= 1024 and not {_in('src_port', SERVICE_PORTS)} and not {internal_sql('dst_ip')})"
EXFIL_SQL = f"""case when not {_CLIENT} then 0 when total_bytes > 5000000 and payload_to_header_ratio > 10 then 0.94
  when total_bytes > 1000000 and bytes_per_second > 100000 and payload_to_header_ratio > 5 then 0.86
  when total_bytes > 500000 and bytes_per_second > 50000 and payload_to_header_ratio > 15 and pkt_len_mean > 1000 then 0.89 else 0 end::double"""


@query("beacon_scores", flow_ctes(30_000_000) + f", sc as (select *, {BEACON_SQL} c from ff) select flow_id, flow_start_us, c confidence, c >= 0.7 is_threat from sc")
def beacon_scores(spark, sf_dir):
    rows = fill_defaults(flow_features(flows(packets(spark, sf_dir), SHORT_ACTIVE, splt=False)))
    return score(rows, beaconing()).select("flow_id", "flow_start_us", "confidence", "is_threat")


@query("exfil_scores", flow_ctes(30_000_000) + f", sc as (select *, {EXFIL_SQL} c, {_CLIENT} client_egress from ff) select flow_id, flow_start_us, client_egress, c confidence, c >= 0.7 is_threat from sc")
def exfil_scores(spark, sf_dir):
    rows = fill_defaults(flow_features(flows(packets(spark, sf_dir), SHORT_ACTIVE, splt=False)))
    return score(rows, exfiltration()).select("flow_id", "flow_start_us", client_egress().alias("client_egress"), "confidence", "is_threat")


@query("packet_cap", ctes("v_packets") + """,
r as (select pkt_id, protocol, row_number() over (partition by protocol order by pkt_id) rn from v_packets)
select pkt_id, protocol from r where rn <= 100""")
def packet_cap(spark, sf_dir):
    from wiretide.sources.packets import capped
    return capped(packets(spark, sf_dir), 100, ["protocol"]).select("pkt_id", "protocol")
