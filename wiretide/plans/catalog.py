"""Fixed dimensions: threat classes, severities, kill-chain stages and tactics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Class, label, short name, technique id, technique, tactic, kill-chain stage
THREATS = (
    ("Volumetric_Protocol_DDoS", "Volumetric & protocol DDoS", "DDoS", "T1498", "Network Denial of Service",
     "Impact", "Actions on Objectives"),
    ("Botnet_C2_Beaconing", "Botnet C2 beaconing", "C2 beaconing", "T1071", "Application Layer Protocol",
     "Command and Control", "Command & Control"),
    ("DGA_Domains_and_DNS_Tunneling", "DGA domains & DNS tunneling", "DGA / DNS", "T1568", "Dynamic Resolution",
     "Command and Control", "Command & Control"),
    ("Encrypted_Malware_TLS", "Encrypted malware (TLS metadata)", "Encrypted malware", "T1573", "Encrypted Channel",
     "Command and Control", "Installation"),
    ("Reconnaissance_Port_Scanning", "Reconnaissance port scanning", "Port scan", "T1046", "Network Service Discovery",
     "Discovery", "Reconnaissance"),
    ("Data_Exfiltration", "Data exfiltration", "Exfiltration", "T1048", "Exfiltration Over Alternative Protocol",
     "Exfiltration", "Actions on Objectives"),
)
# Level, label, glyph, rank
SEVERITIES = (("CRITICAL", "Critical", "■", 0), ("HIGH", "High", "▲", 1), ("MEDIUM", "Medium", "◆", 2), ("LOW", "Low", "●", 3))
# Fixed values
KILL_CHAIN = ("Reconnaissance", "Weaponization", "Delivery", "Exploitation", "Installation", "Command & Control",
              "Actions on Objectives")
# Fixed values
TACTICS = ("Discovery", "Command and Control", "Exfiltration", "Impact")
CLASSES = tuple(row[0] for row in THREATS)


def threats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, *row) for i, row in enumerate(THREATS)],
        "position int, threat_class string, label string, short string, mitre_id string, technique string, "
        "tactic string, kill_chain string")


def severities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEVERITIES), "severity string, severity_label string, glyph string, severity_rank int")


def stages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(KILL_CHAIN)), "stage_order int, stage string")


def tactics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(TACTICS)), "tactic_order int, tactic string")


def pick(column: Column, field: int, rows=THREATS) -> Column:
    """Attribute of a fixed dimension without a join; null for an unknown key."""
    value = F.lit(None)
    for row in rows:
        value = F.when(column == row[0], F.lit(row[field])).otherwise(value)
    return value


def level(severity: Column) -> Column:
    """A known severity level; anything else counts as LOW."""
    upper = F.upper(severity)
    return F.when(upper.isin(*[row[0] for row in SEVERITIES]), upper).otherwise(F.lit("LOW"))


def rank(severity: Column) -> Column:
    return pick(level(severity), 3, SEVERITIES)


def short_name(threat_class: Column) -> Column:
    return F.coalesce(pick(threat_class, 2), F.replace(threat_class, F.lit("_"), F.lit(" ")))


def with_catalog(alerts: DataFrame) -> DataFrame:
    """Left equi-join with the threat dimension; unknown classes keep readable defaults."""
    dim = threats(alerts.sparkSession).drop("position")
    return (alerts.join(dim, "threat_class", "left")
            .withColumns({"label": F.coalesce("label", "threat_class"),
                          "short": F.coalesce("short", F.replace(F.col("threat_class"), F.lit("_"), F.lit(" "))),
                          "mitre_id": F.coalesce("mitre_id", F.lit("—")), "tactic": F.coalesce("tactic", F.lit("—")),
                          "severity_rank": rank(F.col("severity"))}))
