import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import client_hello, dns_query
from wiretide.functions import net, text, tls
from wiretide.functions.dns import decode_question
from wiretide.functions.domain import analyze, shannon_entropy, suffix_join, with_domain_split
from wiretide.functions.register import register

BENIGN = """apache.org python.org kernel.org debian.org gutenberg.org blueharbor.com greenlantern.net weatherstation.co.uk
d9k2m4p6r8.cloudfront.net riverbank.com mountaintrail.org paperlanterns.com""".split()
GENERATED = "wqz7kx3bvt.biz zxcv8uiop2qwrt.info hjkl56bnmtz.org q4wz7xkjv9pl2.club".split()
TUNNEL = "nbswy3dpeb3w64tmmqqhi2djomqgs4zamfxca5dfon2a.q.leak-path.net"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def names(spark, values):
    return spark.createDataFrame([(v,) for v in values], "domain string")


def test_entropy_matches_counting(spark):
    values = ["", "a", "aabb", "abcd", "hello world", "x1x2x3..", "zzzzzzzzy"]
    got = names(spark, values).select("domain", shannon_entropy(F.col("domain")).alias("h")).collect()
    for row in got:
        n = len(row.domain)
        want = -sum(c / n * math.log2(c / n) for c in Counter(row.domain).values()) if n else 0.0
        assert row.h == pytest.approx(want, abs=1e-9)


def test_domain_split(spark):
    cases = {"www.records.gov.in": ("records", "www", "gov.in"), "gov.in": ("gov", "", "in"), "a.b.example.com.": ("example", "a.b", "com"),
             "host": ("host", "", ""), "": ("", "", ""), "..": ("", "", ""), "EXAMPLE.co.uk": ("example", "", "co.uk")}
    rows = with_domain_split(names(spark, cases), "domain").collect()
    assert {r.domain: (r.label, r.subdomain, r.suffix) for r in rows} == cases


def test_benign_and_generated_names(spark):
    rows = {r.domain: r for r in analyze(names(spark, BENIGN + GENERATED)).collect()}
    assert all(len(rows[d].dga_signals) < 3 for d in BENIGN), [d for d in BENIGN if len(rows[d].dga_signals) >= 3]
    assert all(len(rows[d].dga_signals) >= 3 for d in GENERATED)


def test_tunnel_and_empty_record(spark):
    rows = {r.domain: r for r in analyze(names(spark, [TUNNEL, "www.gutenberg.org", "", None])).collect()}
    assert rows[TUNNEL].is_tunnel_suspect and not rows["www.gutenberg.org"].is_tunnel_suspect
    for empty in (rows[""], rows[None]):
        assert (empty.query_length, empty.entropy, empty.max_label_length, empty.dga_signals) == (0, 0.0, 0, [])
        assert not empty.is_tunnel_suspect


def test_long_labels_need_entropy(spark):
    varied, dull = "abcdefghijklmnopqrstuvwxyz0123456789", "q7x9z2k4" * 7
    rows = {r.domain[:4]: r for r in analyze(names(spark, [f"{varied}.example.com", f"{dull}.example.com"])).collect()}
    assert rows["abcd"].is_tunnel_suspect and rows["abcd"].subdomain_length == 36
    assert not rows["q7x9"].is_tunnel_suspect and rows["q7x9"].max_label_length == 56


def test_suffix_join(spark):
    suffixes = spark.createDataFrame([("cloudfront.net",), ("example.com",)], "suffix string")
    hits = suffix_join(names(spark, ["a.cloudfront.net", "xcloudfront.net", "example.com.", "Example.com", "com"]), suffixes)
    assert {r.domain for r in hits.collect()} == {"a.cloudfront.net", "example.com.", "Example.com"}


def test_addresses(spark):
    cases = {"10.1.2.3": (True, False), "172.16.0.1": (True, False), "172.32.0.1": (False, False), "100.64.0.1": (True, False),
             "198.51.100.7": (False, False), "192.168.1.255": (True, True), "224.0.0.251": (False, True), "fe80::1": (True, False),
             "fd12:3456::1": (True, False), "::1": (True, False), "2001:db8::1": (False, False), "ff02::fb": (False, True),
             "fc00": (False, False), "10.1.2": (False, False), "10.0.0.256": (False, False), "junk": (False, False), "": (False, False)}
    rows = spark.createDataFrame([(k,) for k in cases], "ip string").select(
        "ip", net.is_internal(F.col("ip")).alias("i"), net.is_broadcast_or_multicast(F.col("ip")).alias("b")).collect()
    assert {r.ip: (r.i, r.b) for r in rows} == cases


def test_ip_validity(spark):
    cases = {"1.2.3.4": True, "01.2.3.4": False, "1.2.3": False, "2001:db8::2": True, "::": True, "1::2::3": False, "12345::1": False,
             "1:2:3:4:5:6:7:8": True, "1:2:3:4:5:6:7": False, ":1:2": False, "*": False}
    rows = spark.createDataFrame([(k,) for k in cases], "ip string").select("ip", net.is_ip(F.col("ip")).alias("ok")).collect()
    assert {r.ip: r.ok for r in rows} == cases


def test_sql_and_column_agree_on_addresses(spark):
    register(spark)
    cases = {"10.1.2.3": True, "9.300.0.0": False, "10.1.1.999": False, "172.31.0.1": True, "172.32.0.1": False, "100.127.1.1": True, "100.128.0.1": False,
             "fe80::1": True, "fe80::1%eth0": True, "fe80:zzz": False, "febf::9": True, "fec0::9": False, "fdff:1::": True, "::1": True, "0:0:0:0:0:0:0:1": True,
             "::ffff:10.0.0.1": False, "::10.0.0.999": False, "1:2:3": False, "": False, None: False, "FE80::A": True}
    rows = names(spark, cases).select("domain", net.is_internal(F.col("domain")).alias("c"), F.expr("is_internal_ip(domain)").alias("s")).collect()
    assert {r.domain: r.c for r in rows} == cases and {r.domain: r.s for r in rows} == cases


def test_canonical_addresses(spark):
    cases = {"2001:DB8:0:0::1": "2001:db8::1", "10.0.0.1": "10.0.0.1", "::ffff:192.0.2.1": "::ffff:192.0.2.1", "fe80::1%eth0": "fe80::1%eth0", "x": None, "1.2.3": None}
    rows = names(spark, cases).select("domain", net.canonical(F.col("domain")).alias("c")).collect()
    assert {r.domain: r.c for r in rows} == cases


def test_cidr_join_of_both_versions(spark):
    ips = spark.createDataFrame([("2001:db8::5",), ("2001:DB9::5",), ("10.2.0.1",), ("bad",), ("::1",)], "ip string")
    nets = spark.createDataFrame([("2001:db8::/32",), ("10.2.0.0/16",), ("junk/8",), ("::1/128",)], "cidr string")
    assert {r.ip: r.inside for r in net.cidr_join(ips, nets).collect()} == {"2001:db8::5": True, "2001:DB9::5": False, "10.2.0.1": True, "bad": False, "::1": True}


def test_cidr_join(spark):
    ips = spark.createDataFrame([("10.1.1.1",), ("11.0.0.1",), ("192.168.4.9",), ("x",)], "ip string")
    nets = spark.createDataFrame([("10.0.0.0/8",), ("192.168.4.0/24",)], "cidr string")
    assert {r.ip: r.inside for r in net.cidr_join(ips, nets).collect()} == {"10.1.1.1": True, "11.0.0.1": False, "192.168.4.9": True, "x": False}


def _hellos(spark, payloads):
    return tls.with_client_hello(spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "id int, payload binary"), "payload").orderBy("id").collect()


def test_ja3(spark):
    hello = client_hello([0x0A0A, 0x1301, 0xC02F], "example.com", [0x1A1A, 29, 23], [0], (23, 0x2A2A))
    full, cut, no_ext, junk, none = _hellos(spark, [hello, hello[:-10], client_hello([1, 2]), b"\x16\x03nonsense", None])
    assert full.ja3_str == "771,4865-49199,0-10-11-23,29-23,0"
    assert full.ja3_hash == "d98313c9bedc185d58695455b2f7136e"
    assert (full.sni, full.cipher_count, full.extension_count, full.tls_version_name, full.complete) == ("example.com", 2, 4, "TLS 1.2", True)
    assert cut.is_tls and not cut.complete and cut.ja3_hash == "" and cut.cipher_count == 2
    assert no_ext.complete and no_ext.ja3_str == "771,1-2,,,"
    assert not junk.is_tls and not none.is_tls


def test_blocklist(spark):
    rows = spark.createDataFrame([("6734f37431670e3ab732c3f8b3799e56",), ("x",)], "ja3_hash string")
    got = {r.ja3_hash: r.matched_family for r in tls.with_family(rows, tls.blocklist(spark)).collect()}
    assert got == {"6734f37431670e3ab732c3f8b3799e56": "Cobalt_Strike", "x": "Unknown"}


def test_dns_question(spark):
    good = dns_query("mail.example.org", 16)
    loop = bytes.fromhex("abcd01000001000000000000") + b"\xc0\x0c" + b"\0\1\0\1"
    payloads = [good, good[:-3], b"short", None, loop, bytes(12)]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "id int, p binary").select("id", decode_question("p").alias("q")).orderBy("id").collect()
    assert (rows[0].q.ok, rows[0].q.query_name, rows[0].q.query_type) == (True, "mail.example.org", "16")
    assert [r.q.ok for r in rows[1:5]] == [False] * 4
    assert rows[5].q.ok and rows[5].q.query_name == "" and rows[5].q.query_type == "UNKNOWN"


def test_texts(spark):
    row = one(spark, *[text.human_bytes(F.lit(n)).alias(f"b{i}") for i, n in enumerate((0, 1023, 1536, 5 << 20, 3 << 40))],
              text.ist_from_text(F.lit("2026-01-01T00:00:00+00:00")).alias("ok"), text.ist_from_text(F.lit("not a time")).alias("bad"),
              text.ist(F.timestamp_micros(F.lit(0)), False).alias("epoch"), text.safe_domain(F.lit('a$(reboot)`id`";sid:1;.evil.com')).alias("d"),
              text.escape_markdown(F.lit("[x](y)")).alias("md"))
    assert [row[f"b{i}"] for i in range(5)] == ["0 B", "1,023 B", "1.5 KB", "5.0 MB", "3,072.0 GB"]
    assert (row.ok, row.bad, row.epoch) == ("01 Jan 2026, 05:30:00 IST", "—", "05:30:00 IST")
    assert row.d == "arebootidsid1.evil.com" and row.md == r"\[x\]\(y\)"


def test_bad_evidence_is_an_empty_object(spark):
    values = ['{"a":1}', "{bad", "[1]", "3", "", None]
    rows = spark.createDataFrame([(v,) for v in values], "e string").select(text.parsed(F.col("e")).alias("e")).collect()
    assert [r.e for r in rows] == ['{"a":1}'] + ["{}"] * 5


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("""select shannon_entropy('abcd') h, domain_split('www.records.gov.in') d, is_internal_ip('10.0.0.1') a,
                       is_internal_ip('8.8.8.8') b, is_internal_ip('fe80::1') c, is_internal_ip('zz') z""").first()
    assert row.h == 2.0 and tuple(row.d) == ("records", "www", "gov.in") and (row.a, row.b, row.c, row.z) == (True, False, True, False)
    spark.createDataFrame([(bytearray(dns_query("a.b")), bytearray(client_hello([1])))], "q binary, h binary").createOrReplaceTempView("payloads")
    row = spark.sql("select parse_dns_query(q).query_name n, parse_client_hello(h).is_tls t from payloads").first()
    assert row.n == "a.b" and row.t
