"""Lexical analysis of domain names with native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Two-label public suffixes
TWO_LEVEL_SUFFIXES = (
    "co.in", "gov.in", "nic.in", "ac.in", "org.in", "net.in", "res.in", "mil.in",
    "co.uk", "ac.uk", "gov.uk", "org.uk", "com.au", "net.au", "co.jp", "com.cn", "com.br",
)
# Names that are never scored
NON_SCORED_SUFFIXES = ("in-addr.arpa", "ip6.arpa", ".local")
# Cloud and CDN suffixes whose generated host names look random by design
INFRA_SUFFIXES = (
    "amazonaws.com", "cloudfront.net", "akamaiedge.net", "akadns.net", "akamai.net", "akamaihd.net", "edgekey.net",
    "edgesuite.net", "fastly.net", "fastlylb.net", "cloudflare.net", "azureedge.net", "azurefd.net",
    "trafficmanager.net", "cloudapp.net", "msedge.net", "office.net", "googlevideo.com", "googleusercontent.com",
    "gvt1.com", "1e100.net", "alibabadns.com", "linode.com", "force.com", "siteforce.com", "footprint.net",
    "llnwd.net", "cdn77.org", "hwcdn.net", "services.mozilla.com",
)

_INFRA_PATTERN = r"(?:^|\.)(?:" + "|".join(s.replace(".", r"\.") for s in INFRA_SUFFIXES) + r")$"


def shannon_entropy(text: Column) -> Column:
    """Bits per character; an empty text has none."""
    n = F.length(text)
    # Removing one character shortens the text by its number of occurrences
    weighted = F.aggregate(
        F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), F.lit(0.0),
        lambda acc, c: acc + (n - F.length(F.replace(text, c))) * F.log2((n - F.length(F.replace(text, c))).cast("double")))
    return F.when(n > 0, F.greatest(F.lit(0.0), F.log2(n.cast("double")) - weighted / n)).otherwise(F.lit(0.0))


def labels(domain: Column) -> Column:
    """Lower-case labels, without empty ones."""
    return F.filter(F.split(F.lower(domain), r"\."), lambda x: x != "")


def is_infrastructure(domain: Column) -> Column:
    return F.regexp_replace(F.lower(domain), r"\.+$", "").rlike(_INFRA_PATTERN)


def suffix_length(parts: Column) -> Column:
    n = F.size(parts)
    last_two = F.concat_ws(".", F.slice(parts, -2, 2))
    return (F.when((n >= 3) & last_two.isin(*TWO_LEVEL_SUFFIXES), F.lit(2))
            .otherwise(F.when(n >= 2, F.lit(1)).otherwise(F.lit(0))))


def with_domain_split(df: DataFrame, domain: str = "domain", prefix: str = "") -> DataFrame:
    """Adds ``label`` (the registered label), ``subdomain`` and ``suffix``."""
    out = df.withColumn("_parts", labels(F.coalesce(F.col(domain), F.lit(""))))
    out = out.withColumn("_at", F.size("_parts") - suffix_length(F.col("_parts")))
    at = F.col("_at")
    part = F.col("_parts")
    return (out
            .withColumn(f"{prefix}label", F.when(at >= 1, F.element_at(part, F.greatest(at, F.lit(1)))).otherwise(F.lit("")))
            .withColumn(f"{prefix}subdomain",
                        F.when(at > 1, F.concat_ws(".", F.slice(part, F.lit(1), F.greatest(at - 1, F.lit(0))))).otherwise(F.lit("")))
            .withColumn(f"{prefix}suffix",
                        F.when(at >= 1, F.concat_ws(".", F.slice(part, at + 1, F.size(part)))).otherwise(F.concat_ws(".", part)))
            .drop("_parts", "_at"))


def _count(text: Column, pattern: str) -> Column:
    """Number of characters that match a character class."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _percent(value: Column) -> Column:
    return F.format_string("%.0f%%", F.bround(value * 100, 0))


ANALYSIS_COLUMNS = (
    "query_length", "entropy", "consonant_ratio", "digit_ratio", "subdomain_count", "has_consecutive_consonants",
    "label", "label_entropy", "subdomain_length", "subdomain_entropy", "max_label_length", "hyphen_count",
    "is_infrastructure", "dga_signals", "is_tunnel_suspect")


def analyze(df: DataFrame, domain: str = "domain") -> DataFrame:
    """Adds the domain analysis columns. Null and empty names give the all-zero record."""
    d = F.col("_d")
    out = df.withColumn("_d", F.coalesce(F.col(domain), F.lit("")))
    out = with_domain_split(out, "_d")
    clean = F.regexp_replace(d, "[^a-zA-Z0-9]", "")
    clean_len = F.greatest(F.lit(1), F.length(clean))
    lowered = F.regexp_replace(F.lower(d), r"\.+$", "")
    scored = ~is_infrastructure(d)
    for suffix in NON_SCORED_SUFFIXES:
        scored = scored & ~lowered.endswith(suffix)
    label = F.col("label")
    letters = _count(label, r"\p{L}")
    out = (out
           .withColumn("query_length", F.length(d))
           .withColumn("entropy", shannon_entropy(d))
           .withColumn("consonant_ratio", F.round(_count(clean, "(?i)[b-df-hj-np-tv-z]") / clean_len, 4))
           .withColumn("digit_ratio", F.round(_count(clean, "[0-9]") / clean_len, 4))
           .withColumn("subdomain_count", F.length(d) - F.length(F.replace(d, F.lit("."))))
           .withColumn("has_consecutive_consonants", d.rlike("(?i)[b-df-hj-np-tv-z]{5,}"))
           .withColumn("max_label_length", F.coalesce(
               F.array_max(F.transform(F.split(F.trim(d, F.lit(".")), r"\."), lambda x: F.length(x))), F.lit(0)))
           .withColumn("hyphen_count", F.length(d) - F.length(F.replace(d, F.lit("-"))))
           .withColumn("is_infrastructure", is_infrastructure(d))
           .withColumn("_scored", scored)
           .withColumn("_label_entropy", shannon_entropy(label))
           .withColumn("_consonants", F.when(letters > 0, _count(label, "[b-df-hj-np-tv-xz]") / letters).otherwise(F.lit(0.0)))
           .withColumn("_digits", F.when(F.length(label) > 0, _count(label, r"\p{Nd}") / F.length(label)).otherwise(F.lit(0.0)))
           .withColumn("_run", F.coalesce(F.array_max(F.transform(
               F.regexp_extract_all(label, F.lit("([b-df-hj-np-tv-xz]+)"), 1), lambda m: F.length(m))), F.lit(0)))
           .withColumn("_letters", letters))
    entropy = F.col("_label_entropy")
    signals = F.filter(F.array(
        F.format_string("high label entropy (%.2f bits)", F.bround(entropy, 2)),
        F.when(F.length(label) >= 10, F.format_string("long random label (%d chars)", F.length(label))),
        F.when(F.col("_consonants") >= 0.80, F.format_string("consonant ratio %.2f", F.bround(F.col("_consonants"), 2))),
        F.when((F.col("_letters") > 0) & F.col("_digits").between(0.1, 0.7),
               F.format_string("letters mixed with digits (%s)", _percent(F.col("_digits")))),
        F.when(F.col("_run") >= 6, F.format_string("%d consecutive consonants", F.col("_run"))),
    ), lambda x: x.isNotNull())
    # Entropy is a precondition, the other indicators only add to it
    signals = F.when(F.col("_scored") & (label != "") & (entropy >= 3.0), signals).otherwise(
        F.array().cast("array<string>"))
    # Encoded payloads are long single labels of random characters
    encoded = F.filter(F.split(F.col("subdomain"), r"\."), lambda x: (
        (F.length(x) >= 25) & (F.length(x) - F.length(F.replace(x, F.lit("-"))) <= 1)
        & (shannon_entropy(x) >= F.when(F.length(x) < 45, F.lit(3.8)).otherwise(F.lit(3.5)))))
    out = out.withColumn("_encoded", F.transform(encoded, lambda x: F.length(x)))
    out = (out
           .withColumn("dga_signals", signals)
           .withColumn("is_tunnel_suspect", F.col("_scored") & (
               F.exists("_encoded", lambda n: n >= 30)
               | (F.aggregate("_encoded", F.lit(0), lambda acc, n: acc + n) >= 60)))
           .withColumn("label_entropy", F.round(entropy, 4))
           .withColumn("subdomain_length", F.length("subdomain"))
           .withColumn("subdomain_entropy", F.round(shannon_entropy(F.col("subdomain")), 4)))
    return out.drop("_d", "_scored", "_label_entropy", "_consonants", "_digits", "_run", "_letters", "_encoded",
                    "subdomain", "suffix")


def suffix_join(domains: DataFrame, suffixes: DataFrame, domain: str = "domain", suffix: str = "suffix") -> DataFrame:
    """Domains that are, or lie under, a suffix of an operator-maintained table.

    Every dot-bounded tail of a distinct domain is matched with an equi semi-join; Catalyst
    broadcasts the suffix table only when its size is below the broadcast threshold.
    """
    name = F.regexp_replace(F.lower(F.col(domain)), r"\.+$", "")
    parts = F.split(name, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    exploded = domains.select(domain).distinct().withColumn("_tail", F.explode(tails))
    hits = (exploded.join(suffixes.select(F.lower(F.col(suffix)).alias("_tail")), "_tail", "left_semi")
            .select(domain).distinct())
    return domains.join(hits, domain, "left_semi")
