"""Evidence access and display texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wiretide.functions.net import is_ip
from wiretide.plans.catalog import SEVERITIES, level, pick

# Characters that carry meaning in Markdown
_MARKDOWN = r"([\\`*_{}\[\]()#+\-.!|<>~])"


def parsed(evidence: Column) -> Column:
    """Evidence as a JSON object text; anything else becomes an empty object."""
    value = F.try_parse_json(evidence)
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    return F.when(F.coalesce(is_object, F.lit(False)), evidence).otherwise(F.lit("{}"))


def field(evidence: Column, name: str, kind: str = "string") -> Column:
    """One top-level field; null when it is missing or has another shape."""
    text = F.get_json_object(evidence, f"$.{name}")
    return text if kind == "string" else text.try_cast(kind)


def text_list(evidence: Column, name: str) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(evidence, f"$.{name}"), "array<string>"),
                      F.array().cast("array<string>"))


def human_bytes(n: Column) -> Column:
    value = F.coalesce(n.cast("double"), F.lit(0.0))

    def scaled(power: int, unit: str) -> Column:
        return F.concat(F.format_string("%,.1f", F.bround(value / F.lit(float(1024 ** power)), 1)), F.lit(f" {unit}"))

    return (F.when(value < 1024, F.concat(F.format_string("%,.0f", F.bround(value, 0)), F.lit(" B")))
            .when(value < 1024 ** 2, scaled(1, "KB")).when(value < 1024 ** 3, scaled(2, "MB")).otherwise(scaled(3, "GB")))


def ist(ts: Column, with_date: bool = True) -> Column:
    """Indian standard time of a timestamp; null becomes a dash."""
    local = F.from_utc_timestamp(F.to_timestamp(ts), "+05:30")
    pattern = "dd MMM yyyy, HH:mm:ss 'IST'" if with_date else "HH:mm:ss 'IST'"
    return F.coalesce(F.date_format(local, pattern), F.lit("—"))


def ist_from_text(text: Column, with_date: bool = True) -> Column:
    return ist(F.try_to_timestamp(text), with_date)


def escape_markdown(text: Column) -> Column:
    """Captured strings must render literally."""
    return F.regexp_replace(text, _MARKDOWN, r"\\$1")


def safe_domain(text: Column) -> Column:
    """Only host-name characters, so that captured names cannot break out of a generated rule."""
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9._-]", ""), 1, 253)


def valid_ip(ip: Column) -> Column:
    return F.when(is_ip(ip), ip)


def _count(value: Column) -> Column:
    return F.format_string("%,d", F.coalesce(value.cast("long"), F.lit(0).cast("long")))


def _fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.bround(F.coalesce(value, F.lit(0.0)), digits))


def describe() -> Column:
    """One line per alert from its class and evidence. Expects the alert columns."""
    ev = parsed(F.col("evidence"))
    src = F.coalesce("src_ip", F.lit("?"))
    dst = F.coalesce("dst_ip", F.lit("?"))
    port = F.when(F.col("dst_port") != 0, F.col("dst_port").cast("string"))
    sock = F.when(port.isNotNull(), F.concat(dst, F.lit(":"), port)).otherwise(dst)

    def number(name: str) -> Column:
        return F.coalesce(field(ev, name, "double"), F.lit(0.0))

    def non_empty(name: str) -> Column:
        value = field(ev, name)
        return F.when(value != "", value)

    target = F.coalesce(non_empty("target"), dst)
    kind = F.when(number("syn_only_ratio") >= 0.8, F.lit("SYN flood")).otherwise(F.lit("Packet flood"))
    flood = F.concat(kind, F.lit(" on "), target, F.lit(": "), _count(number("peak_packets_per_sec")),
                     F.lit(" pkt/s from "), _count(number("unique_sources")), F.lit(" sources"))
    beacon = F.concat(src, F.lit(" beacons to "), sock, F.lit(" every "), _fixed(number("iat_mean_sec"), 1),
                      F.lit(" s (IAT variance "), _fixed(number("iat_variance"), 4), F.lit(")"))
    tunnel = F.concat(src, F.lit(" is tunnelling data over DNS ("), number("encoded_subdomain_length").cast("long").cast("string"),
                      F.lit("-char encoded subdomain)"))
    domain = F.concat(src, F.lit(" resolved algorithmic domain "), F.coalesce(non_empty("queried_domain"), F.lit("?")))
    family = F.when(field(ev, "matched_threat") != "Unknown", non_empty("matched_threat"))
    anomalies = F.array_join(F.slice(text_list(ev, "anomalies"), 1, 2), "; ")
    tls = F.when(family.isNotNull(), F.concat(src, F.lit(" → "), sock, F.lit(": JA3 matches "), family)).otherwise(
        F.concat(F.lit("Suspicious TLS "), src, F.lit(" → "), sock, F.lit(": "),
                 F.when(anomalies != "", anomalies).otherwise(F.lit("anomalous ClientHello"))))
    ports, hosts = number("distinct_ports_on_one_host").cast("long"), number("distinct_hosts_on_one_port").cast("long")
    scan = F.when(ports >= hosts, F.concat(src, F.lit(" probed "), ports.cast("string"), F.lit(" ports on "), target)).otherwise(
        F.concat(src, F.lit(" swept "), hosts.cast("string"), F.lit(" hosts on port "), F.coalesce(port, F.lit("?"))))
    exfil = F.concat(src, F.lit(" sent "), human_bytes(number("total_bytes")), F.lit(" to "), sock, F.lit(" at "),
                     human_bytes(number("bytes_per_sec")), F.lit("/s"))
    cls = F.col("threat_class")
    return (F.when(cls == "Volumetric_Protocol_DDoS", flood).when(cls == "Botnet_C2_Beaconing", beacon)
            .when(cls == "DGA_Domains_and_DNS_Tunneling",
                  F.when(field(ev, "is_tunnel_suspect") == "true", tunnel).otherwise(domain))
            .when(cls == "Encrypted_Malware_TLS", tls).when(cls == "Reconnaissance_Port_Scanning", scan)
            .when(cls == "Data_Exfiltration", exfil).otherwise(F.concat(src, F.lit(" → "), sock)))


def title() -> Column:
    """Severity glyph and label, class with technique id, and a mark for model-only alerts."""
    sev = level(F.col("severity"))
    cls = F.col("threat_class")
    name = F.coalesce(F.concat(pick(cls, 2), F.lit(" ("), pick(cls, 3), F.lit(")")), cls)
    by_model = F.when(field(parsed(F.col("evidence")), "detected_by") == "AI model", F.lit(" · AI model")).otherwise(F.lit(""))
    return F.concat(pick(sev, 2, SEVERITIES), F.lit(" "), pick(sev, 1, SEVERITIES), F.lit(" · "), name, by_model)
