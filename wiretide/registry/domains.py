"""Domain-name, DNS and TLS queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretide.fixtures import ctes, view
from wiretide.functions import tls
from wiretide.functions.dns import decode_question
from wiretide.functions.domain import INFRA_SUFFIXES, NON_SCORED_SUFFIXES, TWO_LEVEL_SUFFIXES, analyze, suffix_join, with_domain_split
from wiretide.functions.text import text_list
from wiretide.operators.detectors import STANDARD_TLS_PORTS, dga, encrypted_malware, score
from wiretide.operators.features import best_query, fill_defaults
from wiretide.registry import query


def _strings(values):
    return ", ".join(f"'{v}'" for v in values)


# Shannon entropy of a text in the checking engine
def _entropy(text):
    return (f"(case when length({text}) = 0 then 0::double else (select coalesce(-sum(c.n / length({text}) * log2(c.n / length({text}))), 0) + 0.0 "
            f"from (select count(*) n from (select unnest(string_split({text}, '')) ch) where ch <> '' group by ch) c) end)")


_INFRA = r"(^|\.)(" + "|".join(s.replace(".", r"\.") for s in INFRA_SUFFIXES) + ")$"
_ANALYSIS = f""",
dm as (select distinct domain d from v_domains where domain is not null),
d1 as (select d, list_filter(string_split(lower(d), '.'), lambda x: x <> '') p from dm),
d2 as (select *, len(p) - case when len(p) >= 3 and array_to_string(p[-2:], '.') in ({_strings(TWO_LEVEL_SUFFIXES)}) then 2
   when len(p) >= 2 then 1 else 0 end k from d1),
d3 as (select *, case when k >= 1 then p[k] else '' end label, case when k > 1 then array_to_string(p[1:k-1], '.') else '' end subdomain,
   case when k >= 1 then array_to_string(p[k+1:], '.') else array_to_string(p, '.') end suffix,
   regexp_matches(regexp_replace(lower(d), '\\.+$', ''), '{_INFRA}') infra,
   regexp_replace(d, '[^a-zA-Z0-9]', '', 'g') clean from d2),
chars as (select t, ch, count(*) n from (select t, unnest(string_split(t, '')) ch from
   (select d t from d3 union select label from d3 union select subdomain from d3 union select unnest(string_split(subdomain, '.')) from d3)) where ch <> '' group by all),
ent as (select t, -sum(n / length(t) * log2(n / length(t))) + 0.0 h from chars group by t),
d4 as (select d3.*, not infra and not ({' or '.join(f"ends_with(regexp_replace(lower(d), '\\.+$', ''), '{s}')" for s in NON_SCORED_SUFFIXES)}) scored,
   coalesce(e1.h, 0) ent_d, coalesce(e2.h, 0) ent_l, coalesce(e3.h, 0) ent_s,
   length(regexp_replace(label, '[^a-z]', '', 'g')) letters,
   coalesce(list_max(list_transform(regexp_extract_all(label, '[b-df-hj-np-tv-xz]+'), lambda x: length(x))), 0) run
   from d3 left join ent e1 on e1.t = d left join ent e2 on e2.t = label left join ent e3 on e3.t = subdomain),
d5 as (select *, case when letters > 0 then length(regexp_replace(label, '[^b-df-hj-np-tv-xz]', '', 'g')) / letters else 0 end cons,
   case when length(label) > 0 then length(regexp_replace(label, '[^0-9]', '', 'g')) / length(label) else 0 end digs from d4),
enc as (select d, sum(length(l)) total, max(length(l)) longest from (select d, unnest(string_split(subdomain, '.')) l from d5) join ent on ent.t = l
   where length(l) >= 25 and length(l) - length(replace(l, '-', '')) <= 1 and h >= case when length(l) < 45 then 3.8 else 3.5 end group by d),
an as (select d5.*, scored and (coalesce(longest, 0) >= 30 or coalesce(total, 0) >= 60) tunnel,
   case when scored and label <> '' and ent_l >= 3.0 then list_filter([format('high label entropy ({{:.2f}} bits)', ent_l),
     case when length(label) >= 10 then format('long random label ({{}} chars)', length(label)) end,
     case when cons >= 0.8 then format('consonant ratio {{:.2f}}', cons) end,
     case when letters > 0 and digs between 0.1 and 0.7 then format('letters mixed with digits ({{:.0f}}%)', digs * 100) end,
     case when run >= 6 then format('{{}} consecutive consonants', run) end], lambda x: x is not null) else []::varchar[] end signals
   from d5 left join enc using (d))"""
DOMAINS = ctes("v_domains") + _ANALYSIS


def domains(spark, sf_dir):
    return view(spark, sf_dir, "v_domains")


def analysis(spark, sf_dir):
    return analyze(domains(spark, sf_dir))


@query("domain_split", DOMAINS + "select id, kind, label, subdomain, suffix from v_domains join an on an.d = domain")
def domain_split(spark, sf_dir):
    return with_domain_split(domains(spark, sf_dir)).select("id", "kind", "label", "subdomain", "suffix")


@query("domain_lexical", DOMAINS + """
select id, kind, domain, length(d) query_length, round(ent_d, 6) entropy,
 round(length(regexp_replace(clean, '(?i)[^b-df-hj-np-tv-z]', '', 'g')) / greatest(1, length(clean)), 4) consonant_ratio,
 round(length(regexp_replace(clean, '[^0-9]', '', 'g')) / greatest(1, length(clean)), 4) digit_ratio,
 length(d) - length(replace(d, '.', '')) subdomain_count, regexp_matches(d, '(?i)[b-df-hj-np-tv-z]{5,}') has_consecutive_consonants,
 round(ent_l, 4) label_entropy, length(subdomain) subdomain_length, round(ent_s, 4) subdomain_entropy,
 list_max(list_transform(string_split(trim(d, '.'), '.'), lambda x: length(x))) max_label_length, length(d) - length(replace(d, '-', '')) hyphen_count,
 infra is_infrastructure from v_domains join an on an.d = domain""")
def domain_lexical(spark, sf_dir):
    names = ("id", "kind", "domain", "query_length", "consonant_ratio", "digit_ratio", "subdomain_count", "has_consecutive_consonants",
             "label_entropy", "subdomain_length", "subdomain_entropy", "max_label_length", "hyphen_count", "is_infrastructure")
    counts = ("query_length", "subdomain_count", "subdomain_length", "max_label_length", "hyphen_count")
    rows = analysis(spark, sf_dir).select(*names, F.round("entropy", 6).alias("entropy"))
    return rows.withColumns({c: F.col(c).cast("long") for c in counts})


@query("domain_dga_signals", DOMAINS + "select id, kind, len(signals)::bigint n_signals, array_to_string(signals, '; ') signals from v_domains join an on an.d = domain")
def domain_dga_signals(spark, sf_dir):
    return analysis(spark, sf_dir).select("id", "kind", F.size("dga_signals").cast("long").alias("n_signals"), F.array_join("dga_signals", "; ").alias("signals"))


@query("domain_tunnel", DOMAINS + "select id, kind, tunnel is_tunnel_suspect from v_domains join an on an.d = domain")
def domain_tunnel(spark, sf_dir):
    return analysis(spark, sf_dir).select("id", "kind", "is_tunnel_suspect")


def _dns_features(rows):
    return fill_defaults(rows.withColumns({
        "dns_entropy": F.col("label_entropy"), "dns_query_len": F.col("query_length").cast("double"),
        "is_dns_suspect": F.col("is_tunnel_suspect").cast("double"), "dns_dga_signals": F.size("dga_signals").cast("double"),
        "dns_query": F.col("domain"), "dns_signal_list": F.col("dga_signals"),
        "dns_subdomain_length": F.col("subdomain_length"), "dns_context_subdomain_entropy": F.col("subdomain_entropy")}))


@query("dga_scores", DOMAINS + """,
sc as (select id, kind, (case when tunnel or len(signals) >= 5 then 0.94 when len(signals) >= 4 then 0.88 when len(signals) >= 3 then 0.78 else 0 end)::double confidence
 from v_domains join an on an.d = domain)
select *, confidence >= 0.7 is_threat from sc""")
def dga_scores(spark, sf_dir):
    return score(_dns_features(analysis(spark, sf_dir)), dga()).select("id", "kind", "confidence", "is_threat")


@query("dns_best_query", DOMAINS + """,
r as (select id // 5 flow, domain, tunnel, label, row_number() over (partition by kind, id // 5
   order by tunnel desc, len(signals) desc, round(ent_l, 4) desc, id % 5) rn, kind from v_domains join an on an.d = domain)
select kind, flow, domain query_name, tunnel is_tunnel_suspect from r where rn = 1""")
def dns_best_query(spark, sf_dir):
    """Groups of five names stand for the payload samples of one flow."""
    rows = (domains(spark, sf_dir).filter("domain is not null")
            .select("kind", F.floor(F.col("id") / 5).alias("flow"), (F.col("id") % 5).alias("position"), F.col("domain").alias("query_name")))
    return (best_query(analyze(rows, "query_name"), ["kind", "flow"])
            .select("kind", "flow", "dns.query_name", "dns.is_tunnel_suspect"))


@query("infra_suffix_join", DOMAINS + "select id, kind, domain from v_domains join an on an.d = domain where infra")
def infra_suffix_join(spark, sf_dir):
    suffixes = spark.createDataFrame([(s,) for s in INFRA_SUFFIXES], "suffix string")
    return suffix_join(domains(spark, sf_dir), suffixes).select("id", "kind", "domain")


def _hex(value, digits):
    return F.lpad(F.hex(value.cast("long")), digits, "0")


def dns_message():
    """A DNS question for the name in ``domain``, by native expressions."""
    name = F.array_join(F.transform(F.split("domain", r"\."), lambda p: F.concat(_hex(F.length(p), 2), F.hex(p))), "")
    return F.unhex(F.concat(F.lit("ABCD01000001000000000000"), name, F.lit("0000010001")))


@query("dns_question_decode", ctes("v_domains") + "select id, kind, domain query_name, '1' query_type, true ok from v_domains where domain is not null")
def dns_question_decode(spark, sf_dir):
    """Names are encoded as DNS questions by native expressions and decoded from the bytes."""
    return (domains(spark, sf_dir).filter("domain is not null").select("id", "kind", decode_question(dns_message()).alias("q"))
            .select("id", "kind", "q.query_name", "q.query_type", "q.ok"))


# ---- TLS ----------------------------------------------------------------------------------------

_HELLOS = ctes("v_hellos") + f""",
h as (select *, list_filter(ciphers, lambda v: not ((v & 3855) = 2570 and (v >> 8) = (v & 255))) cs from v_hellos),
j as (select *, len(cs) n, concat(tls_version, ',', array_to_string(cs, '-'), ',', case when sni = '' then '10-11' else '0-10-11' end, ',29-23,0') s from h)"""


def hellos(spark, sf_dir):
    return view(spark, sf_dir, "v_hellos")


def _fingerprints(spark, sf_dir):
    clean = tls.drop_grease(F.col("ciphers"))
    extensions = F.when(F.col("sni") == "", F.array(F.lit(10), F.lit(11))).otherwise(F.array(F.lit(0), F.lit(10), F.lit(11)))
    ja3 = tls.ja3_string(F.col("tls_version"), F.col("clean"), extensions, F.array(F.lit(29), F.lit(23)), F.array(F.lit(0)))
    return hellos(spark, sf_dir).withColumn("clean", clean).withColumns({"ja3_str": ja3, "extension_count": F.size(extensions)}) \
        .withColumn("ja3_hash", F.md5("ja3_str"))


@query("ja3_fingerprint", _HELLOS + """select hello_id, s ja3_str, md5(s) ja3_hash, n::int cipher_count,
 case tls_version when 769 then 'TLS 1.0' when 770 then 'TLS 1.1' else 'TLS 1.2' end tls_version_name from j""")
def ja3_fingerprint(spark, sf_dir):
    return _fingerprints(spark, sf_dir).select("hello_id", "ja3_str", "ja3_hash", F.size("clean").alias("cipher_count"),
                                               tls.version_name(F.col("tls_version")).alias("tls_version_name"))


_KNOWN = " union all ".join(f"select '{k}' k, '{v}' family" for k, v in tls.JA3_BLOCKLIST.items())
_DEMO = "md5('771,' || (7919 % 65536) || '-' || ((7919 + 4099) % 65536) || ',0-10-11,29-23,0')"


@query("ja3_blocklist_join", _HELLOS + f""",
b as ({_KNOWN} union all select {_DEMO}, 'Observed')
select hello_id, md5(s) ja3_hash, coalesce(family, 'Unknown') matched_family from j left join b on b.k = md5(s)""")
def ja3_blocklist_join(spark, sf_dir):
    """The fixed list plus one fingerprint that may occur in the data."""
    observed = spark.range(1).select(F.md5(F.concat(F.lit("771,"), F.lit(str(7919 % 65536)), F.lit("-"), F.lit(str((7919 + 4099) % 65536)),
                                                    F.lit(",0-10-11,29-23,0"))).alias("ja3_hash"), F.lit("Observed").alias("family"))
    families = tls.blocklist(spark).unionByName(observed)
    return tls.with_family(_fingerprints(spark, sf_dir), families).select("hello_id", "ja3_hash", "matched_family")


_PORTS = ", ".join(map(str, STANDARD_TLS_PORTS))


@query("tls_anomaly_scores", _HELLOS + f""",
sc as (select hello_id, least(0.92::double, (case when tls_version < 771 then 0.35 else 0 end)::double + (case when complete and sni = '' then 0.25 else 0 end)::double
  + (case when dst_port not in ({_PORTS}) then 0.2 else 0 end)::double + (case when n between 1 and 4 or n > 60 then 0.2 else 0 end)::double
  + (case when complete and sni = '' then 0.1 else 0 end)::double) c,
  concat_ws('; ', case when tls_version < 771 then case tls_version when 769 then 'legacy TLS 1.0 ClientHello' else 'legacy TLS 1.1 ClientHello' end end,
   case when complete and sni = '' then 'no SNI (server name hidden)' end, case when dst_port not in ({_PORTS}) then concat('TLS on non-standard port ', dst_port) end,
   case when n between 1 and 4 or n > 60 then format('unusual cipher suite count ({{}})', n) end, case when complete and sni = '' then 'only 2 TLS extensions' end) anomalies from j)
select hello_id, round(c, 4) confidence, c >= 0.7::double is_threat, anomalies from sc""")
def tls_anomaly_scores(spark, sf_dir):
    rows = _fingerprints(spark, sf_dir).withColumns({
        "is_tls": F.lit(1.0), "cipher_count": F.size("clean").cast("double"), "tls_version_name": tls.version_name(F.col("tls_version")),
        "tls_extension_count": F.col("extension_count").cast("double"), "tls_has_sni": (F.col("sni") != "").cast("double"),
        "tls_complete": F.col("complete").cast("double"), "tls_version": F.col("tls_version").cast("double")})
    scored = score(fill_defaults(rows), encrypted_malware())
    return scored.select("hello_id", "confidence", "is_threat", F.array_join(text_list(F.col("evidence"), "anomalies"), "; ").alias("anomalies"))


def with_hello_bytes(rows, name):
    """ClientHello record of the rows of the view, built by native expressions; incomplete ones lose their last ten bytes.

    Each part is a column, because a text that an expression names twice is built twice.
    """
    def block(part, width):
        return F.concat(_hex(F.length(part) / 2, width), F.col(part))
    parts = {
        "_suites": F.array_join(F.transform("ciphers", lambda c: _hex(c, 4)), ""),
        "_name": F.hex("sni"),
        "_host": F.concat(F.lit("00"), block("_name", 4)),
        "_hosts": block("_host", 4),
        "_sni": F.when(F.col("sni") == "", F.lit("")).otherwise(F.concat(F.lit("0000"), block("_hosts", 4))),
        "_extensions": F.concat("_sni", F.lit("000A00080006" "1A1A001D0017"), F.lit("000B00020100")),
        "_body": F.concat(_hex(F.col("tls_version"), 4), F.repeat(F.lit("00"), 33), block("_suites", 4), F.lit("0100"), block("_extensions", 4)),
        "_message": F.concat(F.lit("01"), block("_body", 6)),
        "_record": F.unhex(F.concat(F.lit("160301"), block("_message", 4)))}
    out = rows
    for part, value in parts.items():
        out = out.withColumn(part, value)
    cut = F.substring("_record", F.lit(1), F.length("_record") - 10)
    return out.withColumn(name, F.when(F.col("complete"), F.col("_record")).otherwise(cut)).drop(*parts)


@query("client_hello_decode", _HELLOS + """select hello_id, true is_tls, tls_version, n::int cipher_count,
 case when complete then sni else '' end sni, case when complete then case when sni = '' then 2 else 3 end else 0 end extension_count,
 case when complete then s else '' end ja3_str, case when complete then md5(s) else '' end ja3_hash, complete from j""")
def client_hello_decode(spark, sf_dir):
    rows = with_hello_bytes(hellos(spark, sf_dir), "payload").select("hello_id", "payload")
    sniffed = rows.filter(tls.looks_like_hello(F.col("payload")))
    return tls.with_client_hello(sniffed, "payload").select("hello_id", "is_tls", "tls_version", "cipher_count", "sni", "extension_count",
                                                             "ja3_str", "ja3_hash", "complete")
