"""Rule detectors as column expressions.

A detector turns the columns of one grain (``flow``, ``target`` or ``source``) into a confidence and
evidence fields. A row is a threat when the unrounded confidence reaches 0.70.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from wiretide.config import DetectionConfig, FloodConfig, ScanConfig
from wiretide.functions.tls import JA3_BLOCKLIST

THREAT_LEVEL = 0.70

FLOOD = "Volumetric_Protocol_DDoS"
BEACON = "Botnet_C2_Beaconing"
DGA = "DGA_Domains_and_DNS_Tunneling"
MALWARE = "Encrypted_Malware_TLS"
SCAN = "Reconnaissance_Port_Scanning"
EXFIL = "Data_Exfiltration"

# Port sets of the rules
DISCOVERY_PORTS = (67, 68, 137, 138, 1900, 5353, 5355)
STANDARD_TLS_PORTS = (443, 8443, 993, 995, 465, 636, 853, 989, 990, 5061)
SERVICE_PORTS = (1080, 1433, 1521, 3128, 3306, 3389, 5432, 5900, 8000, 8080, 8443, 8888)


@dataclass(frozen=True)
class Detector:
    """One rule. ``evidence`` receives the threat condition and returns named fields; a null field is
    left out of the JSON. Add instances to the list given to ``detect`` to plug in further rules."""

    name: str
    grain: str
    confidence: Callable[[], Column]
    evidence: Callable[[Column], dict[str, Column]]


def _percent(value: Column) -> Column:
    return F.format_string("%.0f%%", F.bround(value * 100, 0))


def _texts(*items: Column) -> Column:
    """List of the texts that apply."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.bround(value.cast("double"), digits))


# ---- target grain -------------------------------------------------------------------------------

def flood(cfg: FloodConfig = FloodConfig()) -> Detector:
    peak, packets, sources = F.col("peak_pps"), F.col("packets"), F.col("unique_sources")
    strong = peak >= 3 * cfg.pps_threshold
    gate = (packets >= cfg.min_packets) & (peak >= cfg.pps_threshold)
    half_open = F.col("syn_only_ratio") >= 0.8
    udp = (F.col("udp_ratio") >= 0.8) & ((sources >= 5) | strong)

    def confidence() -> Column:
        total = (F.lit(0.45) + F.when(strong, F.lit(0.15)).otherwise(F.lit(0.0))
                 + F.when(half_open, F.lit(0.35)).when(udp, F.lit(0.25)).otherwise(F.lit(0.0))
                 + F.when(sources >= 50, F.lit(0.15)).otherwise(F.lit(0.0)))
        return F.when(gate, F.least(F.lit(0.99), total)).otherwise(F.lit(0.0))

    def evidence(_: Column) -> dict[str, Column]:
        shares = F.when(half_open, F.concat(_percent(F.col("syn_only_ratio")), F.lit(" half-open SYN packets"))).when(
            udp, F.concat(_percent(F.col("udp_ratio")), F.lit(" UDP packets")))
        reasons = _texts(F.concat(peak.cast("string"), F.lit(f" pps peak (threshold {cfg.pps_threshold:.0f})")), shares,
                         F.when(sources >= 50, F.concat(sources.cast("string"), F.lit(" distinct sources (distributed)"))))
        return {"target": F.col("dst_ip"), "peak_packets_per_sec": peak, "window_packets": packets,
                "syn_only_ratio": F.round("syn_only_ratio", 3), "unique_sources": sources,
                "source_ip_entropy_bits": F.round("source_ip_entropy", 3), "top_sources": F.col("top_sources"),
                "indicators": F.when(gate, reasons).otherwise(F.array().cast("array<string>"))}

    return Detector(FLOOD, "target", confidence, evidence)


# ---- source grain -------------------------------------------------------------------------------

def port_scan(cfg: ScanConfig = ScanConfig()) -> Detector:
    ports, hosts, ratio = F.col("max_ports_on_one_host"), F.col("max_hosts_on_one_port"), F.col("probe_ratio")
    probing = ratio >= cfg.min_probe_ratio
    vertical, horizontal = ports >= cfg.min_ports, hosts >= cfg.min_hosts

    def confidence() -> Column:
        base = (F.when(vertical, F.when(ports >= 100, F.lit(0.92)).when(ports >= 25, F.lit(0.85)).otherwise(F.lit(0.75)))
                .when(horizontal, F.when(hosts >= 100, F.lit(0.92)).when(hosts >= 50, F.lit(0.85)).otherwise(F.lit(0.75))))
        sure = F.when(ratio >= 0.9, F.lit(0.05)).otherwise(F.lit(0.0))
        return F.coalesce(F.when(probing, base + sure), F.lit(0.0))

    def evidence(threat: Column) -> dict[str, Column]:
        kind = (F.when(probing & vertical, F.lit("vertical (many ports, one host)"))
                .when(probing & horizontal, F.lit("horizontal (one port, many hosts)")).otherwise(F.lit("none")))
        reach = F.when(ports >= hosts, F.concat(ports.cast("string"), F.lit(" distinct ports probed on one host within a 3 s window"))
                       ).otherwise(F.concat(hosts.cast("string"), F.lit(" hosts probed on the same port within a 3 s window")))
        share = F.concat(_percent(ratio), F.lit(" of packets are connection probes (SYN without ACK)"))
        return {"scan_type": kind, "distinct_ports_on_one_host": ports, "distinct_hosts_on_one_port": hosts,
                "probe_ratio": F.round(ratio, 3), "target": F.col("vertical_target"),
                "sample_ports": F.slice("probed_ports", 1, 20), "indicators": F.when(threat, F.array(reach, share))}

    return Detector(SCAN, "source", confidence, evidence)


# ---- flow grain ---------------------------------------------------------------------------------

def beaconing() -> Detector:
    mean, variance, cv = F.col("iat_mean"), F.col("iat_variance"), F.col("iat_cv")
    count = F.col("packet_count")

    def confidence() -> Column:
        excluded = ((F.col("is_portless") > 0.5) | (F.col("dst_broadcast") > 0.5)
                    | F.col("src_port").isin(*DISCOVERY_PORTS) | F.col("dst_port").isin(*DISCOVERY_PORTS)
                    | (F.col("payload_to_header_ratio") < 0.1))
        regular = (F.when(variance < 0.01, F.lit(0.92)).when((variance < 0.05) & (cv < 0.15), F.lit(0.82))
                   .when((variance < 0.15) & (cv < 0.30), F.lit(0.65)))
        return F.coalesce(F.when(~excluded & (count >= 5) & (mean > 0.5), regular), F.lit(0.0))

    def evidence(threat: Column) -> dict[str, Column]:
        reasons = F.array(
            F.concat(count.cast("long").cast("string"), F.lit(" check-ins at a fixed "), _fixed(mean, 2), F.lit(" s interval")),
            F.concat(F.lit("interval variance "), _fixed(variance, 4), F.lit(" (human-driven traffic is irregular)")))
        return {"iat_mean_sec": F.round(mean, 3), "iat_variance": F.round(variance, 5), "iat_cv": F.round(cv, 4),
                "packet_count": count.cast("long"), "indicators": F.when(threat, reasons)}

    return Detector(BEACON, "flow", confidence, evidence)


def dga() -> Detector:
    tunnel = F.col("is_dns_suspect") > 0.5
    signals = F.col("dns_dga_signals")

    def confidence() -> Column:
        return (F.when(tunnel | (signals >= 5), F.lit(0.94)).when(signals >= 4, F.lit(0.88))
                .when(signals >= 3, F.lit(0.78)).otherwise(F.lit(0.0)))

    def evidence(_: Column) -> dict[str, Column]:
        return {"queried_domain": F.coalesce("dns_query", F.lit("")), "label_entropy_bits": F.round("dns_entropy", 3),
                "dns_query_length": F.col("dns_query_len").cast("long"),
                "dga_indicators": F.coalesce("dns_signal_list", F.array().cast("array<string>")),
                "is_tunnel_suspect": tunnel,
                "encoded_subdomain_length": F.when(tunnel, F.coalesce("dns_subdomain_length", F.lit(0))),
                "subdomain_entropy_bits": F.when(tunnel, F.round(F.coalesce("dns_context_subdomain_entropy", F.lit(0.0)), 3))}

    return Detector(DGA, "flow", confidence, evidence)


def encrypted_malware(families: dict[str, str] | None = None, column: str | None = None) -> Detector:
    """Fingerprint families are a small fixed mapping or, where a table of any size was joined, a ``column``."""
    known = JA3_BLOCKLIST if families is None else families
    family = F.lit(None).cast("string") if column is None else F.col(column)
    for digest, name in (known if column is None else {}).items():
        family = F.when(F.col("ja3_hash") == digest, F.lit(name)).otherwise(family)
    complete = F.col("tls_complete") > 0.5
    port, ciphers, extensions = F.col("dst_port"), F.col("cipher_count"), F.col("tls_extension_count")
    legacy = (F.col("tls_version") > 0) & (F.col("tls_version") < 0x0303)
    hidden = complete & (F.col("tls_has_sni") < 0.5)
    odd_port = (port != 0) & ~port.isin(*STANDARD_TLS_PORTS)
    odd_ciphers = ((ciphers > 0) & (ciphers < 5)) | (ciphers > 60)
    bare = complete & (extensions < 3)

    def confidence() -> Column:
        parts = ((legacy, 0.35), (hidden, 0.25), (odd_port, 0.20), (odd_ciphers, 0.20), (bare, 0.10))
        total = F.lit(0.0)
        for condition, weight in parts:
            total = total + F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))
        return (F.when(family.isNotNull(), F.lit(0.96))
                .when(F.col("is_tls") > 0.5, F.least(F.lit(0.92), total)).otherwise(F.lit(0.0)))

    def evidence(_: Column) -> dict[str, Column]:
        version = F.when(F.coalesce("tls_version_name", F.lit("")) != "", F.col("tls_version_name")).otherwise(F.lit("TLS < 1.2"))
        texts = _texts(
            F.when(legacy, F.concat(F.lit("legacy "), version, F.lit(" ClientHello"))),
            F.when(hidden, F.lit("no SNI (server name hidden)")),
            F.when(odd_port, F.concat(F.lit("TLS on non-standard port "), port.cast("string"))),
            F.when(odd_ciphers, F.concat(F.lit("unusual cipher suite count ("), ciphers.cast("long").cast("string"), F.lit(")"))),
            F.when(bare, F.concat(F.lit("only "), extensions.cast("long").cast("string"), F.lit(" TLS extensions"))))
        anomalies = (F.when(family.isNotNull(), F.array(F.concat(F.lit("JA3 matches "), family)))
                     .when(F.col("is_tls") > 0.5, texts).otherwise(F.array().cast("array<string>")))
        sni = F.coalesce("sni", F.lit(""))
        ja3 = F.coalesce("ja3_hash", F.lit(""))
        return {"is_tls": F.col("is_tls") > 0.5, "ja3_hash": F.when(ja3 != "", ja3).otherwise(F.lit("N/A")),
                "ja3_string": F.coalesce("ja3_str", F.lit("")), "sni": F.when(sni != "", sni).otherwise(F.lit("(none)")),
                "matched_threat": F.coalesce(family, F.lit("Unknown")), "cipher_count": ciphers.cast("long"),
                "anomalies": anomalies}

    return Detector(MALWARE, "flow", confidence, evidence)


def client_egress(port: str = "src_port") -> Column:
    """Traffic that leaves a client port for an external host."""
    return (F.col(port) >= 1024) & ~F.col(port).isin(*SERVICE_PORTS) & (F.col("dst_internal") < 0.5)


def exfiltration() -> Detector:
    total, rate = F.col("total_bytes").cast("double"), F.col("bytes_per_second")
    ratio, mean = F.col("payload_to_header_ratio"), F.col("pkt_len_mean")

    def confidence() -> Column:
        bulk = (F.when((total > 5_000_000) & (ratio > 10.0), F.lit(0.94))
                .when((total > 1_000_000) & (rate > 100_000) & (ratio > 5.0), F.lit(0.86))
                .when((total > 500_000) & (rate > 50_000) & (ratio > 15.0) & (mean > 1000), F.lit(0.89)))
        return F.coalesce(F.when(client_egress("_client_port"), bulk), F.lit(0.0))

    def evidence(threat: Column) -> dict[str, Column]:
        reasons = F.array(
            F.concat(F.format_string("%,.1f", F.bround(total / 1024, 1)), F.lit(" KB pushed in one direction")),
            F.concat(F.lit("payload-to-header ratio "), _fixed(ratio, 1), F.lit(" (bulk data, not control traffic)")),
            F.concat(F.lit("average packet "), F.format_string("%,.0f", F.bround(mean, 0)), F.lit(" B (MTU-sized frames)")))
        return {"total_bytes": total.cast("long"), "bytes_per_sec": F.round(rate, 2), "payload_ratio": F.round(ratio, 2),
                "avg_packet_size": F.round(mean, 2), "indicators": F.when(threat, reasons)}

    return Detector(EXFIL, "flow", confidence, evidence)


def built_in(cfg: DetectionConfig = DetectionConfig(), family_column: str | None = None) -> list[Detector]:
    return [beaconing(), dga(), encrypted_malware(column=family_column), exfiltration(), flood(cfg.flood), port_scan(cfg.scan)]


def score(rows: DataFrame, detector: Detector) -> DataFrame:
    """Adds ``confidence`` (4 digits), ``is_threat`` and ``evidence`` (JSON) for every row."""
    staged = rows.withColumn("_confidence", detector.confidence())
    threat = F.col("_confidence") >= THREAT_LEVEL
    fields = [value.alias(name) for name, value in detector.evidence(threat).items()]
    return staged.withColumns({"confidence": F.round("_confidence", 4), "is_threat": threat,
                               "evidence": F.to_json(F.struct(*fields))}).drop("_confidence")
