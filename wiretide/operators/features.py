"""Flow features, model vectors and payload context."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from wiretide.functions.dns import DNS_PORTS, decode_question
from wiretide.functions.domain import analyze
from wiretide.functions.net import is_broadcast_or_multicast, is_internal
from wiretide.functions.tls import with_client_hello
from wiretide.operators.flows import KEY

FLOW_UID = [*KEY, "flow_start_us"]

# Destination ports that count as well known in the flow vector
COMMON_SERVICE_PORTS = (20, 21, 22, 23, 25, 53, 67, 68, 80, 110, 123, 137, 138, 139, 143, 161, 389, 443, 445,
                        465, 587, 636, 853, 993, 995, 1900, 3389, 5353, 8080, 8443)

# Vector layout and the label each entry has in explanations
FLOW_VECTOR = {
    "log_packets": "packet count", "log_bytes": "bytes in flow", "log_duration": "flow duration",
    "log_pps": "packet rate", "log_bps": "byte rate", "pkt_len_mean": "mean packet size",
    "pkt_len_std": "packet-size spread", "pkt_len_min": "smallest packet", "pkt_len_max": "largest packet",
    "iat_mean": "mean inter-arrival time", "iat_cv": "timing irregularity (IAT CV)",
    "iat_std": "inter-arrival spread", "syn_share": "share of SYN packets", "ack_share": "share of ACK packets",
    "log_payload_ratio": "payload-to-header ratio", "is_dns": "DNS flow",
    "dns_label_entropy": "domain-label entropy", "dns_query_len": "query length",
    "dns_dga_signals": "DGA indicators", "dns_subdomain_len": "subdomain length",
    "dns_subdomain_entropy": "subdomain entropy", "dns_max_label_len": "longest domain label",
    "dns_hyphens": "hyphens in domain", "dns_infra": "known cloud / CDN domain",
    "is_tls": "TLS ClientHello seen", "tls_complete": "ClientHello fully parsed",
    "tls_legacy": "legacy TLS version", "tls_cipher_count": "offered cipher suites",
    "tls_extension_count": "TLS extensions", "tls_has_sni": "SNI present",
    "dst_port_common": "well-known destination port",
    "src_port_ephemeral": "client-side (ephemeral) source port", "is_portless": "ICMP / portless flow",
    "src_internal": "source inside the network", "dst_internal": "destination inside the network",
}
HOST_VECTOR = {
    "in_log_packets": "packets received in window", "in_log_peak_pps": "peak inbound packet rate",
    "in_syn_only_ratio": "half-open SYN share (inbound)", "in_udp_ratio": "UDP share (inbound)",
    "in_log_sources": "distinct sources", "in_source_entropy": "source-IP entropy",
    "out_log_packets": "packets sent in window", "out_probe_ratio": "probe share (outbound)",
    "out_log_ports_one_host": "ports probed on one host", "out_log_hosts_one_port": "hosts probed on one port",
    "out_log_targets": "distinct targets",
}

_DNS_FEATURES = ("dns_entropy", "dns_query_len", "is_dns_suspect", "dns_dga_signals", "dns_subdomain_len",
                 "dns_subdomain_entropy", "dns_max_label_len", "dns_hyphens", "dns_infra")
_TLS_FEATURES = ("is_tls", "cipher_count", "tls_version", "tls_extension_count", "tls_has_sni", "tls_complete")

# Values a detector assumes for a feature that a partial row lacks
DEFAULTS = {
    "iat_variance": 1.0, "iat_cv": 1.0, "iat_mean": 0.0, "packet_count": 0.0, "is_portless": 0.0, "dst_broadcast": 0.0,
    "payload_to_header_ratio": 1.0, "src_port": 0, "dst_port": 0, "dns_entropy": 0.0, "dns_query_len": 0.0,
    "is_dns_suspect": 0.0, "dns_dga_signals": 0.0, "is_tls": 0.0, "cipher_count": 0.0, "tls_version": 0.0,
    "tls_extension_count": 0.0, "tls_has_sni": 0.0, "tls_complete": 1.0, "total_bytes": 0.0, "bytes_per_second": 0.0,
    "pkt_len_mean": 0.0, "dst_internal": 0.0,
}
CONTEXT = {"ja3_hash": "string", "ja3_str": "string", "sni": "string", "tls_version_name": "string",
           "dns_query": "string", "dns_label_entropy": "double", "dns_subdomain_length": "int",
           "dns_context_subdomain_entropy": "double", "dns_signal_list": "array<string>"}


def _flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def best_query(samples: DataFrame, keys: list[str]) -> DataFrame:
    """The most suspicious decoded name per flow: tunnel, number of signals, label entropy, first sample.

    ``samples`` has the keys, ``position`` and a domain analysis with ``query_name``.
    """
    rank = F.struct(F.col("is_tunnel_suspect"), F.size("dga_signals"), F.col("label_entropy"), -F.col("position"))
    picked = F.struct("query_name", "query_length", "label_entropy", "subdomain_length", "subdomain_entropy",
                      "max_label_length", "hyphen_count", "is_infrastructure", "dga_signals", "is_tunnel_suspect")
    return samples.groupBy(*keys).agg(F.max_by(picked, rank).alias("dns"))


def _dns_branch(flows: DataFrame) -> DataFrame:
    """Decode the samples of DNS flows only; at most five per flow."""
    on_port = F.col("src_port").isin(*DNS_PORTS) | F.col("dst_port").isin(*DNS_PORTS)
    samples = (flows.filter(on_port)
               .select(*FLOW_UID, F.posexplode("payload_samples").alias("position", "payload"))
               .withColumn("q", decode_question("payload")).filter("q.ok")
               .select(*FLOW_UID, "position", F.col("q.query_name").alias("query_name")))
    return best_query(analyze(samples, "query_name"), FLOW_UID)


def _with_dns(flows: DataFrame) -> DataFrame:
    d = F.col("dns")
    return flows.join(_dns_branch(flows), FLOW_UID, "left").withColumns({
        "dns_entropy": F.coalesce(d["label_entropy"], F.lit(0.0)),
        "dns_query_len": F.coalesce(d["query_length"].cast("double"), F.lit(0.0)),
        "is_dns_suspect": _flag(d["is_tunnel_suspect"]),
        "dns_dga_signals": F.coalesce(F.size(d["dga_signals"]).cast("double"), F.lit(0.0)),
        "dns_subdomain_len": F.coalesce(d["subdomain_length"].cast("double"), F.lit(0.0)),
        "dns_subdomain_entropy": F.coalesce(d["subdomain_entropy"], F.lit(0.0)),
        "dns_max_label_len": F.coalesce(d["max_label_length"].cast("double"), F.lit(0.0)),
        "dns_hyphens": F.coalesce(d["hyphen_count"].cast("double"), F.lit(0.0)),
        "dns_infra": _flag(d["is_infrastructure"]),
        "dns_query": d["query_name"], "dns_label_entropy": d["label_entropy"],
        "dns_subdomain_length": d["subdomain_length"], "dns_context_subdomain_entropy": d["subdomain_entropy"],
        "dns_signal_list": d["dga_signals"],
    }).drop("dns")


def _with_tls(flows: DataFrame) -> DataFrame:
    """ClientHello figures. The stored hello is the first payload that parses as TLS; a payload sample
    cannot be one when no hello was stored, because both pass the same test."""
    decoded = with_client_hello(flows, "tls_client_hello")
    tls = F.col("is_tls")
    return decoded.withColumns({
        "tls_extension_count": F.when(tls, F.col("extension_count").cast("double")).otherwise(F.lit(0.0)),
        "cipher_count": F.when(tls, F.col("cipher_count").cast("double")).otherwise(F.lit(0.0)),
        "tls_version": F.when(tls, F.col("tls_version").cast("double")).otherwise(F.lit(0.0)),
        "tls_has_sni": _flag(tls & (F.col("sni") != "")),
        "tls_complete": _flag(tls & F.col("complete")),
        "is_tls": _flag(tls),
        **{name: F.when(tls, F.col(name)) for name in ("ja3_hash", "ja3_str", "sni", "tls_version_name")},
    }).drop("extension_count", "complete")


def flow_features(flows: DataFrame) -> DataFrame:
    """Flow rows with all numeric features and the non-numeric context used in evidence."""
    with_payload = "payload_samples" in flows.columns
    if with_payload:
        out = _with_tls(_with_dns(flows)).drop("payload_samples", "tls_client_hello")
    else:
        out = flows.withColumns({name: F.lit(0.0) for name in (*_DNS_FEATURES, *_TLS_FEATURES)}
                                | {name: F.lit(None).cast(kind) for name, kind in CONTEXT.items()})
    return out.withColumns({
        "src_internal": _flag(is_internal(F.col("src_ip"))), "dst_internal": _flag(is_internal(F.col("dst_ip"))),
        "is_portless": _flag(~F.col("protocol").isin("TCP", "UDP")),
        "dst_broadcast": _flag(is_broadcast_or_multicast(F.col("dst_ip"))),
        # The feature row floors the duration, the flow row does not
        "duration": F.greatest(F.lit(0.0001), F.col("duration")),
    })


def fill_defaults(rows: DataFrame) -> DataFrame:
    """Complete a partial feature row with what the detectors assume."""
    present = set(rows.columns)
    added = {name: F.coalesce(F.col(name), F.lit(value)) if name in present else F.lit(value)
             for name, value in DEFAULTS.items()}
    # A row without a source port is taken for a client
    added["_client_port"] = F.coalesce(F.col("src_port"), F.lit(50000)) if "src_port" in present else F.lit(50000)
    added |= {name: F.lit(None).cast(kind) for name, kind in CONTEXT.items() if name not in present}
    return rows.withColumns(added)


def log1p(value: Column) -> Column:
    return F.log1p(F.greatest(F.lit(0.0), F.coalesce(value.cast("double"), F.lit(0.0))))


def flow_vector_columns() -> dict[str, Column]:
    packets = F.greatest(F.lit(1.0), F.col("packet_count").cast("double"))
    sport, dport = F.col("src_port"), F.col("dst_port")

    def plain(name: str) -> Column:
        return F.col(name).cast("double")

    columns = {
        "log_packets": log1p(packets), "log_bytes": log1p(F.col("total_bytes")), "log_duration": log1p(F.col("duration")),
        "log_pps": log1p(F.col("packets_per_second")), "log_bps": log1p(F.col("bytes_per_second")),
        **{name: plain(name) for name in ("pkt_len_mean", "pkt_len_std", "pkt_len_min", "pkt_len_max")},
        "iat_mean": F.least(F.lit(120.0), plain("iat_mean")), "iat_cv": F.least(F.lit(10.0), plain("iat_cv")),
        "iat_std": F.least(F.lit(120.0), plain("iat_std")),
        "syn_share": plain("syn_count") / packets, "ack_share": plain("ack_count") / packets,
        "log_payload_ratio": log1p(F.col("payload_to_header_ratio")),
        "is_dns": _flag((sport == 53) | (dport == 53)), "dns_label_entropy": plain("dns_entropy"),
        **{name: plain(name) for name in ("dns_query_len", "dns_dga_signals", "dns_subdomain_len",
                                          "dns_subdomain_entropy", "dns_max_label_len", "dns_hyphens", "dns_infra",
                                          "is_tls", "tls_complete")},
        "tls_legacy": _flag((F.col("tls_version") > 0) & (F.col("tls_version") < 0x0303)),
        "tls_cipher_count": plain("cipher_count"), "tls_extension_count": plain("tls_extension_count"),
        "tls_has_sni": plain("tls_has_sni"), "dst_port_common": _flag(dport.isin(*COMMON_SERVICE_PORTS)),
        "src_port_ephemeral": _flag((sport >= 1024) & ~sport.isin(*COMMON_SERVICE_PORTS)),
        **{name: plain(name) for name in ("is_portless", "src_internal", "dst_internal")},
    }
    return {name: columns[name] for name in FLOW_VECTOR}


def host_vector_columns() -> dict[str, Column]:
    columns = {
        "in_log_packets": log1p(F.col("in_packets")), "in_log_peak_pps": log1p(F.col("in_peak_pps")),
        "in_syn_only_ratio": F.col("in_syn_only_ratio"), "in_udp_ratio": F.col("in_udp_ratio"),
        "in_log_sources": log1p(F.col("in_unique_sources")), "in_source_entropy": F.col("in_source_ip_entropy"),
        "out_log_packets": log1p(F.col("out_packets")), "out_probe_ratio": F.col("out_probe_ratio"),
        "out_log_ports_one_host": log1p(F.col("out_max_ports_on_one_host")),
        "out_log_hosts_one_port": log1p(F.col("out_max_hosts_on_one_port")),
        "out_log_targets": log1p(F.col("out_unique_targets")),
    }
    return {name: columns[name] for name in HOST_VECTOR}


def _assemble(rows: DataFrame, columns: dict[str, Column], output: str) -> DataFrame:
    staged = rows.withColumns({f"_v_{name}": value for name, value in columns.items()})
    names = [f"_v_{name}" for name in columns]
    return VectorAssembler(inputCols=names, outputCol=output).transform(staged).drop(*names)


def with_flow_vector(rows: DataFrame, output: str = "features") -> DataFrame:
    return _assemble(rows, flow_vector_columns(), output)


def with_host_vector(rows: DataFrame, output: str = "features") -> DataFrame:
    return _assemble(rows, host_vector_columns(), output)
