"""Response rules for the enforcement point, generated per alert as text. Nothing is executed here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wiretide.functions.net import canonical, is_ip
from wiretide.functions.text import field, parsed, safe_domain, text_list

# Local rule ids start here
SID_BASE = 9_000_000
SID_RANGE = 999_999

# Recommended action per class
_ACTIONS = {
    "Volumetric_Protocol_DDoS": "Rate-limit new connections to the targeted service; block the heaviest sources.",
    "Reconnaissance_Port_Scanning": "Block the scanning host and alert on further probes from it.",
    "Botnet_C2_Beaconing": "Cut the C2 channel and isolate the beaconing host for forensics.",
    "DGA_Domains_and_DNS_Tunneling": "Sinkhole the domain at the resolver and investigate the querying host.",
    "Encrypted_Malware_TLS": "Block the C2 endpoint and hunt for the same JA3 fingerprint elsewhere.",
    "Data_Exfiltration": "Stop the outbound transfer and preserve the host for incident response.",
}
_OTHER_ACTION = "Review the flow manually."

HEADER = ("# Review before applying on the enforcement point; the sensor itself never transmits.",)


def iso_time(ts: Column) -> Column:
    """ISO-8601 with offset; the fraction appears only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(F.unix_micros(ts) % 1_000_000 != 0, F.date_format(ts, ".SSSSSS")).otherwise(F.lit(""))
    return F.concat(whole, fraction, F.lit("+00:00"))


def rule_sid() -> Column:
    key = F.concat_ws("|", F.coalesce("flow_id", F.lit("")), F.coalesce("threat_class", F.lit("")),
                      F.coalesce(iso_time(F.col("ts")), F.lit("")))
    return F.lit(SID_BASE).cast("long") + F.crc32(key.cast("binary")) % F.lit(SID_RANGE)


def with_rules(alerts: DataFrame, tag: str = "THREAT") -> DataFrame:
    """Adds ``action``, ``firewall_rules`` and ``ids_rules`` (arrays of lines) and ``sid``.

    ``tag`` opens every rule message and log prefix.
    """
    ev = parsed(F.col("evidence"))
    # Only validated addresses and cleaned names enter a rule
    staged = alerts.withColumns({
        "_src": canonical(F.col("src_ip")), "_dst": canonical(F.col("dst_ip")),
        "_port": F.coalesce("dst_port", F.lit(0)),
        "_proto": F.when(F.lower("protocol").isin("tcp", "udp"), F.lower("protocol")).otherwise(F.lit("ip")),
        "_domain": safe_domain(F.coalesce(field(ev, "queried_domain"), F.lit(""))),
        "_ja3": F.coalesce(F.regexp_extract(F.coalesce(field(ev, "ja3_hash"), F.lit("")), "^[0-9a-f]{32}$", 0), F.lit("")),
        "_tops": F.filter(F.slice(text_list(ev, "top_sources"), 1, 5), is_ip),
        "sid": rule_sid(),
    })
    staged = staged.withColumns({
        "_tool": F.when(F.col("_src").contains(":") | F.col("_dst").contains(":"), F.lit("ip6tables")).otherwise(F.lit("iptables")),
        "_snet": F.coalesce("_src", F.lit("any")), "_dnet": F.coalesce("_dst", F.lit("any")),
        "_dport": F.when(F.col("_port") != 0, F.col("_port").cast("string")).otherwise(F.lit("any")),
        "_msg": F.trim(F.concat_ws(" ", F.lit(tag), F.col("threat_class"), F.coalesce("severity", F.lit("")))),
        "_sid": F.col("sid").cast("string"),
        "_label": F.filter(F.split("_domain", r"\."), lambda x: x != ""),
    }).withColumn("_match", F.when(F.size("_label") >= 2, F.try_element_at("_label", F.lit(-2)))
                  .otherwise(F.coalesce(F.try_element_at("_label", F.lit(1)), F.lit(""))))

    src, dst, tool = F.col("_src"), F.col("_dst"), F.col("_tool")
    fmt = F.format_string
    lines = F.array().cast("array<string>")

    def some(*items: Column) -> Column:
        return F.filter(F.array(*items), lambda x: x.isNotNull())

    def block(chain: str) -> Column:
        return F.when(src.isNotNull() & dst.isNotNull(), fmt(f"%s -A {chain} -s %s -d %s -j DROP", tool, src, dst))

    both = block("FORWARD")
    firewall = {
        "Volumetric_Protocol_DDoS": F.concat(
            some(F.when(dst.isNotNull(), fmt(
                "%s -A INPUT -d %s -p tcp --syn -m hashlimit --hashlimit-name ddos_%s --hashlimit-above 100/second "
                "--hashlimit-mode srcip -j DROP", tool, dst, "_sid"))),
            F.transform("_tops", lambda top: fmt("%s -A INPUT -s %s -d %s -j DROP", tool, top, F.col("_dnet")))),
        "Reconnaissance_Port_Scanning": some(F.when(src.isNotNull(), fmt("%s -A INPUT -s %s -j DROP", tool, src))),
        "Botnet_C2_Beaconing": some(both, F.when(dst.isNotNull(), fmt("%s -A FORWARD -d %s -j DROP", tool, dst))),
        "DGA_Domains_and_DNS_Tunneling": some(F.when(src.isNotNull() & (F.col("_match") != ""), fmt(
            "%s -A FORWARD -s %s -p udp --dport 53 -m string --string %s --algo bm -j DROP", tool, src, "_match"))),
        "Encrypted_Malware_TLS": some(F.when(dst.isNotNull(), F.concat(
            fmt("%s -A FORWARD -d %s", tool, dst),
            F.when(F.col("_port") != 0, fmt(" -p tcp --dport %d", "_port")).otherwise(F.lit("")), F.lit(" -j DROP")))),
        "Data_Exfiltration": some(both),
    }
    other = some(F.when(src.isNotNull(), fmt(f'%s -A INPUT -s %s -j LOG --log-prefix "{tag} "', tool, src)))
    ids = {
        "Volumetric_Protocol_DDoS": some(fmt(
            'drop tcp any any -> %s %s (msg:"%s SYN flood"; flags:S,12; detection_filter:track by_dst, count 300, seconds 1; '
            "sid:%s; rev:1;)", "_dnet", "_dport", "_msg", "_sid")),
        "Reconnaissance_Port_Scanning": some(fmt(
            'drop tcp %s any -> any any (msg:"%s probe"; flags:S,12; detection_filter:track by_src, count 10, seconds 3; '
            "sid:%s; rev:1;)", "_snet", "_msg", "_sid")),
        "Botnet_C2_Beaconing": some(fmt('drop %s %s any -> %s %s (msg:"%s C2 check-in"; sid:%s; rev:1;)',
                                        "_proto", "_snet", "_dnet", "_dport", "_msg", "_sid")),
        "DGA_Domains_and_DNS_Tunneling": some(F.when(F.col("_domain") != "", fmt(
            'drop dns any any -> any any (msg:"%s %s"; dns.query; content:"%s"; nocase; sid:%s; rev:1;)',
            "_msg", "_domain", "_domain", "_sid"))),
        "Encrypted_Malware_TLS": some(F.when(F.col("_ja3") != "", fmt(
            'drop tls any any -> any any (msg:"%s JA3 %s"; ja3.hash; content:"%s"; sid:%s; rev:1;)',
            "_msg", "_ja3", "_ja3", "_sid")).otherwise(fmt(
                'drop tls %s any -> %s %s (msg:"%s"; sid:%s; rev:1;)', "_snet", "_dnet", "_dport", "_msg", "_sid"))),
        "Data_Exfiltration": some(fmt(
            'drop %s %s any -> %s %s (msg:"%s bulk egress"; dsize:>1000; detection_filter:track by_src, count 20, seconds 5; '
            "sid:%s; rev:1;)", "_proto", "_snet", "_dnet", "_dport", "_msg", "_sid")),
    }
    cls = F.col("threat_class")
    fw, rules, action = other, lines, F.lit(_OTHER_ACTION)
    for name, text in _ACTIONS.items():
        fw = F.when(cls == name, firewall[name]).otherwise(fw)
        rules = F.when(cls == name, ids[name]).otherwise(rules)
        action = F.when(cls == name, F.lit(text)).otherwise(action)
    zone = F.when((cls == "DGA_Domains_and_DNS_Tunneling") & (F.col("_domain") != ""),
                  F.concat(F.lit(" RPZ entry: "), F.col("_domain"), F.lit(" CNAME ."))).otherwise(F.lit(""))
    out = staged.withColumns({"action": F.concat(action, zone), "firewall_rules": fw, "ids_rules": rules})
    return out.select(*alerts.columns, "sid", "action", "firewall_rules", "ids_rules")


def rule_bundle(alerts: DataFrame, tag: str = "THREAT") -> DataFrame:
    """Rule lines of many alerts, each kept where it appears first in id order.

    ``kind`` is ``firewall`` or ``ids``; ``header`` introduces the lines of an alert. First occurrence
    is a minimum per line, so a line that many alerts share is combined map-side.
    """
    header = F.concat_ws(" ", F.lit("# alert"), F.col("id").cast("string"), "threat_class", "flow_id")
    rules = with_rules(alerts, tag).select("id", header.alias("header"), F.explode(F.array(
        F.struct(F.lit("firewall").alias("kind"), F.col("firewall_rules").alias("lines")),
        F.struct(F.lit("ids").alias("kind"), F.col("ids_rules").alias("lines")))).alias("r"))
    lines = rules.select("id", "header", "r.kind", F.posexplode("r.lines").alias("position", "line"))
    return (lines.groupBy("kind", "line").agg(F.min(F.struct("id", "position", "header")).alias("first"))
            .select("kind", "first.id", "first.position", "first.header", "line"))


def bundle_lines(bundle: DataFrame, kind: str, first: DataFrame | None = None) -> DataFrame:
    """File lines of one kind in order, with a header before the lines of each alert, after the lines of ``first``
    (id, position, line), whose ids lie before those of all alerts."""
    rows = bundle.filter(F.col("kind") == kind)
    heads = rows.groupBy("id").agg(F.min("header").alias("line")).select("id", F.lit(-1).alias("position"), "line")
    lines = heads.unionByName(rows.select("id", "position", "line"))
    if first is not None:
        lines = first.unionByName(lines)
    return lines.orderBy("id", "position").select(F.col("line").alias("value"))
