"""Packet, domain, handshake and alert views derived from the generic test tables.

Each view is one SQL text with a few dialect tokens, so that Spark and the checking engine
evaluate the same definition.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_TOKENS = {
    "spark": {
        "US": "unix_micros(cast(ts as timestamp))",
        "K": "cast(get_json_object(props,'$.k') as int)",
        "DIV": "div",
        "HOST": "parse_url(url,'HOST')",
        "STR": "string",
        "SEQ": "transform(sequence(0, cast(o_orderkey % 7 as int)), "
               "i -> cast((o_orderkey * 7919 + i * 4099) % 65536 as int))",
        "GREASE": "array(2570, 6682)",
        "CATG": "concat",
        "TS": "timestamp_micros(us)",
    },
    "duckdb": {
        "US": "epoch_us(ts)",
        "K": "cast(json_extract_string(props,'$.k') as int)",
        "DIV": "//",
        "HOST": "regexp_extract(url,'^[a-z]+://([^/:?#]+)',1)",
        "STR": "varchar",
        "SEQ": "list_transform(range(0, cast(o_orderkey % 7 as int) + 1), "
               "lambda i: cast((o_orderkey * 7919 + i * 4099) % 65536 as int))",
        "GREASE": "[2570, 6682]",
        "CATG": "list_concat",
        "TS": "make_timestamp(us)",
    },
}

_E = ("select event_id, user_id, event_type, value, <US> us, <K> k from events")

_VIEWS = {
    "v_packets": f"""
with e as ({_E}),
p as (select event_id pkt_id, 1704067200000000 + (us - 1704067200000000) <DIV> 14400 ts_us, k, event_type et,
  user_id u, cast(floor(value*10) as int) v,
  case when event_type<>'error' then case when event_type='signup' then 'UDP' else 'TCP' end
       when k%4=0 then 'ICMP' when k%4=1 then 'UDP' else 'TCP' end protocol from e)
select pkt_id, ts_us, concat('10.0.',cast(u%4 as <STR>),'.',cast(u%40+2 as <STR>)) src_ip,
 case et when 'view' then '10.9.0.5' when 'click' then concat('203.0.113.',cast(k%5+1 as <STR>))
   when 'purchase' then concat('198.51.100.',cast(k%3+1 as <STR>)) when 'signup' then '8.8.8.8'
   else concat('10.9.1.',cast(k%10+1 as <STR>)) end dst_ip,
 case when protocol='ICMP' then 0 else cast(40000+u%1000 as int) end src_port,
 case when protocol='ICMP' then 0 when et='view' then 80 when et='click' then 443
   when et='purchase' then case when k%2=1 then 443 else 4444 end when et='signup' then 53 else k+1 end dst_port,
 protocol, case when et='error' then 0 else v end payload_length,
 case protocol when 'TCP' then 54 when 'UDP' then 42 else 98 end + case when et='error' then 0 else v end packet_length,
 protocol='TCP' and (et='error' or k<5) syn, protocol='TCP' and et<>'error' and k>=5 ack,
 protocol='TCP' and k=99 fin, protocol='TCP' and k=98 rst, protocol='TCP' and et<>'error' and k>=5 and v>0 psh
from p""",
    "v_domains": """
select page_id id, <HOST> domain, 'page' kind from pages
union all
select doc_id, case doc_id%4
   when 0 then concat(substr(md5(cast(doc_id as <STR>)),1,16),'.biz')
   when 1 then concat(md5(cast(doc_id as <STR>)),substr(md5(concat('t',cast(doc_id as <STR>))),1,8),'.',cast(doc_id%7 as <STR>),'.t.exfil-c2.net')
   when 2 then concat('d',substr(md5(cast(doc_id as <STR>)),1,13),'.cloudfront.net')
   else concat(substr(md5(cast(doc_id as <STR>)),1,6),'.gov.in') end,
 case doc_id%4 when 0 then 'dga' when 1 then 'tunnel' when 2 then 'infra' else 'short' end from documents""",
    "v_hellos": """
select o_orderkey hello_id, case o_orderkey%4 when 0 then 769 when 1 then 770 else 771 end tls_version,
 case when o_orderkey%3=0 then <CATG>(<GREASE>, <SEQ>) else <SEQ> end ciphers,
 case when o_orderkey%5=0 then '' else 'example.org' end sni,
 case when o_orderkey%2=0 then 443 else 4444 end dst_port, o_orderkey%11<>0 complete
from orders""",
    "v_alerts": """
with e as (select event_id, user_id, event_type,
  1704067200000000 + (<US> - 1704067200000000) <DIV> 14400 us, <K> k from events)
select event_id+1 id, <TS> ts, us ts_us,
 concat('10.0.',cast(user_id%4 as <STR>),'.',cast(user_id%40+2 as <STR>)) src_ip,
 concat('203.0.113.',cast(k%12+1 as <STR>)) dst_ip, cast(40000+user_id%1000 as int) src_port, 443 dst_port, 'TCP' protocol,
 concat('f',cast(event_id as <STR>)) flow_id,
 case when event_id%17=0 then '{bad' else concat('{"queried_domain":"d',cast(event_id as <STR>),'.evil.com","total_bytes":',cast(k*1000 as <STR>),'}') end evidence,
 case k%6 when 0 then 'Volumetric_Protocol_DDoS' when 1 then 'Botnet_C2_Beaconing' when 2 then 'DGA_Domains_and_DNS_Tunneling'
   when 3 then 'Encrypted_Malware_TLS' when 4 then 'Reconnaissance_Port_Scanning' else 'Data_Exfiltration' end threat_class,
 cast(70+k%30 as double)/cast(100 as double) confidence_score,
 case when 70+k%30>=90 then 'CRITICAL' when 70+k%30>=80 then 'HIGH' else 'MEDIUM' end severity
from e""",
    "v_host_labels": """
select event_id label_seq, concat('10.0.',cast(user_id%4 as <STR>),'.',cast(user_id%40+2 as <STR>)) ip,
 case when <K>%2=0 then 'Reconnaissance_Port_Scanning' else 'Volumetric_Protocol_DDoS' end cls,
 1704067200000000 + (<US> - 1704067200000000) <DIV> 14400 t_start_us,
 1704067200000000 + (<US> - 1704067200000000) <DIV> 14400 + 2000000 t_end_us
from events where event_type='purchase'""",
}

# Views on top of the views above
_VIEWS["v_flow_labels"] = """
select distinct src_ip, dst_ip, src_port, dst_port, protocol,
 case src_port%5 when 0 then 'benign' when 1 then 'Botnet_C2_Beaconing' when 2 then 'Encrypted_Malware_TLS'
   else 'Data_Exfiltration' end cls
from v_packets where src_port%5<>4"""
_VIEWS["v_scores"] = """
select *, cast(id*37 % 100 as double)/cast(100 as double) prob from v_alerts"""

_TABLES = {"v_packets": ("events",), "v_domains": ("pages", "documents"), "v_hellos": ("orders",),
           "v_alerts": ("events",), "v_host_labels": ("events",)}
_BASE = {"v_flow_labels": "v_packets", "v_scores": "v_alerts"}


def view_sql(name: str, dialect: str) -> str:
    """The defining query of a view in one dialect."""
    text = _VIEWS[name]
    for token, value in _TOKENS[dialect].items():
        text = text.replace(f"<{token}>", value)
    if dialect == "spark":
        # Own names, so that views of the calling session are left alone
        text = re.sub(r"\bfrom (events|pages|documents|orders|v_packets|v_alerts)\b", r"from wiretide_\1", text)
    return text.strip()


def ctes(*names: str) -> str:
    """``WITH`` prefix that defines the named views for the checking engine."""
    ordered: list[str] = []
    for name in names:
        if name in _BASE and _BASE[name] not in ordered:
            ordered.append(_BASE[name])
        if name not in ordered:
            ordered.append(name)
    return "with recursive " + ",\n".join(f"{n} as materialized ({view_sql(n, 'duckdb')})" for n in ordered)


def view(spark: SparkSession, sf_dir: str, name: str, dealt: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """A derived view as a lazy DataFrame over the parquet tables in ``sf_dir``; ``dealt`` may lay out the rows of a table anew."""
    base = _BASE.get(name)
    if base:
        view(spark, sf_dir, base).createOrReplaceTempView(f"wiretide_{base}")
    else:
        for table in _TABLES[name]:
            dealt(spark.read.parquet(f"{sf_dir}/{table}.parquet")).createOrReplaceTempView(f"wiretide_{table}")
    return spark.sql(view_sql(name, "spark"))
