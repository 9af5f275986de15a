"""Packets with DNS questions and TLS hellos, through flows, features and the six rules.

Up to five names that share a group stand for the questions of one flow; every hello follows a packet that is none.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretide.config import DetectionConfig, FlowConfig
from wiretide.fixtures import ctes, view
from wiretide.operators.features import flow_features, flow_vector_columns
from wiretide.operators.flows import flows
from wiretide.plans import detection
from wiretide.registry import query
from wiretide.registry.alerts import chain_sql
from wiretide.registry.domains import _ANALYSIS, _HELLOS, _PORTS, dns_message, domains, with_hello_bytes

T0 = 1704067200000000
_FLAGS = ("syn", "fin", "rst", "psh", "urg")


def _spread(rows, key):
    """Rows of a small table whose bytes are costly to build, dealt to all tasks whatever the files look like."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def payload_packets(spark, sf_dir):
    """Packets of the domain and handshake views, with their bytes."""
    kinds = F.array(*[F.lit(k) for k in ("page", "dga", "tunnel", "infra", "short")])
    group = F.floor(F.col("id") / 5)
    names = _spread(domains(spark, sf_dir).filter("domain is not null"), "id").select(
        F.concat(F.lit("10.1."), F.array_position(kinds, F.col("kind")).cast("string"), F.lit(".7")).alias("src_ip"), F.lit("8.8.8.8").alias("dst_ip"),
        (1024 + group % 60000).cast("int").alias("src_port"), F.lit(53).alias("dst_port"), F.lit("UDP").alias("protocol"),
        (F.lit(T0) + group * 20_000_000 + (F.col("id") % 5) * 100_000).cast("long").alias("ts_us"), dns_message().alias("raw_payload"))
    # Only the keys of orders are dealt, before the view makes hellos of them
    made = with_hello_bytes(view(spark, sf_dir, "v_hellos", lambda orders: _spread(orders, "o_orderkey")), "record")
    each = made.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    tls = each.select(
        F.concat(F.lit("10.2.0."), (F.col("hello_id") % 3).cast("string")).alias("src_ip"), F.lit("203.0.113.9").alias("dst_ip"),
        (1024 + F.col("hello_id") % 60000).cast("int").alias("src_port"), "dst_port", F.lit("TCP").alias("protocol"),
        (F.lit(T0) + F.col("hello_id") * 8_000_000 + F.col("n") * 100_000).cast("long").alias("ts_us"),
        F.when(F.col("n") == 1, F.col("record")).otherwise(F.encode(F.lit("no hello"), "UTF-8")).alias("raw_payload"))
    size = F.length("raw_payload")
    return (names.unionByName(tls).withColumns({**{flag: F.lit(False) for flag in _FLAGS}, "ack": F.col("protocol") == "TCP", "payload_length": size, "packet_length": size + 54})
            # In traffic order; every packet has its own time within its 5-tuple
            .withColumn("pkt_id", F.col("ts_us")))


def _rows(spark, sf_dir):
    return flow_features(flows(payload_packets(spark, sf_dir), FlowConfig(), splt=False))


_DNS = ctes("v_domains", "v_hellos") + _ANALYSIS + """,
rk as (select *, id // 5 g, row_number() over (partition by kind, id // 5 order by tunnel desc, len(signals) desc, round(ent_l, 4) desc, id % 5) rn,
 count(*) over (partition by kind, id // 5) n from v_domains join an on an.d = domain),
dns as (select *, format('10.1.{}.7:{}->8.8.8.8:53_UDP', list_position(['page', 'dga', 'tunnel', 'infra', 'short'], kind), 1024 + g % 60000) flow_id,
 list_max(list_transform(string_split(trim(d, '.'), '.'), lambda x: length(x))) longest_label from rk where rn = 1)"""


@query("dns_flow_features", _DNS + """
select flow_id, n::bigint packet_count, d dns_query, length(d)::double dns_query_len, round(ent_l, 4) dns_label_entropy, tunnel::int::double is_dns_suspect,
 len(signals)::double dns_dga_signals, length(subdomain)::double dns_subdomain_len, round(ent_s, 4) dns_subdomain_entropy, longest_label::double dns_max_label_len,
 (length(d) - length(replace(d, '-', '')))::double dns_hyphens, infra::int::double dns_infra, 1::double is_dns, 0::double is_tls from dns""")
def dns_flow_features(spark, sf_dir):
    vector = flow_vector_columns()
    names = ("dns_query_len", "dns_dga_signals", "dns_subdomain_len", "dns_subdomain_entropy", "dns_max_label_len", "dns_hyphens", "dns_infra", "is_dns", "is_tls")
    return _rows(spark, sf_dir).filter("protocol = 'UDP'").select(
        "flow_id", "packet_count", "dns_query", F.round(vector["dns_label_entropy"], 4).alias("dns_label_entropy"), "is_dns_suspect",
        *[vector[n].alias(n) for n in names])


_TLS = _HELLOS + """,
tls as (select *, format('10.2.0.{}:{}->203.0.113.9:{}_TCP', hello_id % 3, 1024 + hello_id % 60000, dst_port) flow_id, 1704067200000000 + hello_id * 8000000 st from j)"""


@query("tls_flow_features", _TLS + """
select flow_id, st flow_start_us, 2::bigint packet_count, case when complete then sni else '' end sni, case when complete then md5(s) else '' end ja3_hash,
 1::double is_tls, complete::int::double tls_complete, (tls_version < 771)::int::double tls_legacy, n::double tls_cipher_count,
 (case when complete then case when sni = '' then 2 else 3 end else 0 end)::double tls_extension_count, (complete and sni <> '')::int::double tls_has_sni from tls""")
def tls_flow_features(spark, sf_dir):
    vector = flow_vector_columns()
    names = ("is_tls", "tls_complete", "tls_legacy", "tls_cipher_count", "tls_extension_count", "tls_has_sni")
    return _rows(spark, sf_dir).filter("protocol = 'TCP'").select("flow_id", "flow_start_us", "packet_count", "sni", "ja3_hash", *[vector[n].alias(n) for n in names])


_SIX = _DNS + _TLS[len(ctes("v_hellos")):] + f""",
hits as (
 select 'DGA_Domains_and_DNS_Tunneling' threat_class, (case when tunnel or len(signals) >= 5 then 0.94 when len(signals) >= 4 then 0.88 when len(signals) >= 3 then 0.78 else 0 end)::double c,
  (select max({T0} + (id // 5) * 20000000 + (id % 5) * 100000) from rk k where k.kind = dns.kind and k.g = dns.g) ts_us, flow_id, split_part(flow_id, ':', 1) || '->8.8.8.8' key from dns
 union all select 'Encrypted_Malware_TLS', least(0.92::double, (case when tls_version < 771 then 0.35 else 0 end)::double + (case when complete and sni = '' then 0.25 else 0 end)::double
  + (case when dst_port not in ({_PORTS}) then 0.2 else 0 end)::double + (case when n between 1 and 4 or n > 60 then 0.2 else 0 end)::double
  + (case when complete and sni = '' then 0.1 else 0 end)::double), st + 100000, flow_id, split_part(flow_id, ':', 1) || '->203.0.113.9' from tls),
al as (select *, concat(key, '_', threat_class) dedup_key from hits where c >= 0.7::double)"""


@query("six_rule_alerts", _SIX + chain_sql("dedup_key", "al") + """
select threat_class, flow_id, al.ts_us, round(c, 4) confidence_score from al join kept on k = dedup_key and t = al.ts_us""")
def six_rule_alerts(spark, sf_dir):
    """All built-in rules with production settings, from packets with payloads to published alerts."""
    alerts = detection.run(payload_packets(spark, sf_dir), DetectionConfig())
    return alerts.select("threat_class", "flow_id", F.unix_micros("ts").alias("ts_us"), "confidence_score")
