"""TLS ClientHello decoding and JA3 fingerprints."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Protocol version names
VERSION_NAMES = {0x0300: "SSL 3.0", 0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"}
# Fingerprints of known malicious clients
JA3_BLOCKLIST = {
    "6734f37431670e3ab732c3f8b3799e56": "Cobalt_Strike",
    "a0e9f5d64349fb13191bc781f81f42e1": "Emotet_C2",
    "b38466b04313e68364bc823880ded94a": "TrickBot",
    "72a589da586844d7f0818ce684948eea": "Metasploit_Payload",
}

_RAW_SCHEMA = T.StructType([
    T.StructField("is_tls", T.BooleanType()),
    T.StructField("tls_version", T.IntegerType()),
    T.StructField("ciphers", T.ArrayType(T.IntegerType())),
    T.StructField("extensions", T.ArrayType(T.IntegerType())),
    T.StructField("groups", T.ArrayType(T.IntegerType())),
    T.StructField("point_formats", T.ArrayType(T.IntegerType())),
    T.StructField("sni", T.StringType()),
    T.StructField("complete", T.BooleanType()),
])


def looks_like_hello(payload: Column) -> Column:
    """Handshake record, major version 3, ClientHello: cheap enough to run on every packet."""
    return ((F.length(payload) > 5) & (F.substring(payload, 1, 2) == F.unhex(F.lit("1603")))
            & (F.substring(payload, 6, 1) == F.unhex(F.lit("01"))))


class _Cursor:
    """Bounds-checked big-endian reader."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def number(self, width: int) -> int:
        raw = self.data[self.at:self.at + width]
        if len(raw) < width:
            raise EOFError
        self.at += width
        return int.from_bytes(raw, "big")

    def skip(self, width: int) -> None:
        self.at += width

    def block(self, width: int) -> bytes:
        raw = self.data[self.at:self.at + width]
        self.at += width
        if len(raw) < width:
            raise EOFError
        return raw


def _shorts(raw: bytes) -> list[int]:
    count = len(raw) // 2
    return list(struct.unpack(f"!{count}H", raw[:2 * count]))


def _decode(payload: bytes | None) -> tuple:
    """Fields of one ClientHello; what was read before a cut is kept, and ``complete`` stays false."""
    if not payload or len(payload) < 9 or payload[:2] != b"\x16\x03" or payload[5] != 1:
        return False, 0, [], [], [], [], "", False
    version, ciphers, extensions, groups, formats, sni = 0, [], [], [], [], ""
    cursor = _Cursor(payload, 9)
    try:
        version = cursor.number(2)
        cursor.skip(32)
        cursor.skip(cursor.number(1))
        ciphers = _shorts(cursor.block(cursor.number(2)))
        cursor.skip(cursor.number(1))
        if cursor.at + 2 <= len(payload):
            body = _Cursor(cursor.block(cursor.number(2)))
            while body.at + 4 <= len(body.data):
                kind, size = body.number(2), body.number(2)
                # The last extension may run past the block; it is then as long as what is left
                data = payload[cursor.at - len(body.data) + body.at:][:size]
                body.at += size
                extensions.append(kind)
                if kind == 0 and len(data) >= 5:
                    sni = data[5:5 + int.from_bytes(data[3:5], "big")].decode("ascii", errors="replace")
                elif kind == 10 and len(data) >= 2:
                    groups = _shorts(data[2:])
                elif kind == 11 and data:
                    formats = list(data[1:1 + data[0]])
    except EOFError:
        return True, version, ciphers, [], [], [], "", False
    return True, version, ciphers, extensions, groups, formats, sni, True


@F.pandas_udf(_RAW_SCHEMA)
def decode_client_hello(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [field.name for field in _RAW_SCHEMA.fields]
    for payloads in batches:
        yield pd.DataFrame([_decode(p) for p in payloads], columns=names)


def drop_grease(values: Column) -> Column:
    """RFC 8701 placeholder values are not part of a fingerprint."""
    return F.filter(values, lambda v: ~((v.bitwiseAND(F.lit(0x0F0F)) == 0x0A0A)
                                        & (F.shiftright(v, 8) == v.bitwiseAND(F.lit(0xFF)))))


def ja3_string(version: Column, ciphers: Column, extensions: Column, groups: Column, formats: Column) -> Column:
    """The five fields; the lists must be free of GREASE."""
    def joined(values: Column) -> Column:
        return F.array_join(F.transform(values, lambda v: v.cast("string")), "-")
    return F.concat_ws(",", version.cast("string"), joined(ciphers), joined(extensions), joined(groups), joined(formats))


def version_name(version: Column) -> Column:
    name = F.concat(F.lit("0x"), F.lower(F.hex(version.cast("long"))))
    for number, text in VERSION_NAMES.items():
        name = F.when(version == number, F.lit(text)).otherwise(name)
    return name


HELLO_COLUMNS = ("is_tls", "tls_version", "tls_version_name", "cipher_count", "extension_count", "sni",
                 "ja3_str", "ja3_hash", "complete")


def with_client_hello(df: DataFrame, payload: str) -> DataFrame:
    """Adds the ClientHello record of a binary column. Only the byte decoding leaves the JVM."""
    out = df.withColumn("_h", decode_client_hello(F.col(payload)))
    out = out.select(*df.columns, *[F.col(f"_h.{f.name}").alias(f"_{f.name}") for f in _RAW_SCHEMA.fields])
    for name in ("ciphers", "extensions", "groups"):
        out = out.withColumn(f"_{name}", drop_grease(F.col(f"_{name}")))
    complete = F.col("_complete")
    ja3 = ja3_string(F.col("_tls_version"), F.col("_ciphers"), F.col("_extensions"), F.col("_groups"), F.col("_point_formats"))
    return (out
            .withColumn("is_tls", F.col("_is_tls"))
            .withColumn("tls_version", F.col("_tls_version"))
            .withColumn("tls_version_name", F.when(F.col("_tls_version") > 0, version_name(F.col("_tls_version"))).otherwise(F.lit("")))
            .withColumn("cipher_count", F.size("_ciphers"))
            .withColumn("extension_count", F.when(complete, F.size("_extensions")).otherwise(F.lit(0)))
            .withColumn("sni", F.col("_sni"))
            .withColumn("ja3_str", F.when(complete, ja3).otherwise(F.lit("")))
            .withColumn("ja3_hash", F.when(complete, F.md5(ja3)).otherwise(F.lit("")))
            .withColumn("complete", complete)
            .drop(*[f"_{f.name}" for f in _RAW_SCHEMA.fields]))


def blocklist(spark) -> DataFrame:
    """Fingerprint dimension: four fixed rows."""
    return spark.createDataFrame(list(JA3_BLOCKLIST.items()), "ja3_hash string, family string")


def with_family(df: DataFrame, families: DataFrame, ja3: str = "ja3_hash") -> DataFrame:
    """Left equi-join with a fingerprint table; a miss is ``Unknown``."""
    lookup = families.select(F.col("ja3_hash").alias(ja3), F.col("family").alias("matched_family"))
    return df.join(lookup, ja3, "left").fillna({"matched_family": "Unknown"})


def with_known_family(df: DataFrame, families: DataFrame, ja3: str = "ja3_hash", name: str = "ja3_family") -> DataFrame:
    """Adds the family of a fingerprint from a table of any size, null for a miss.

    Rows without a fingerprint get keys of their own, so that they do not meet in one task.
    """
    known = families.groupBy(F.col("ja3_hash").alias("_ja3")).agg(F.min("family").alias(name))
    key = F.when(F.length(ja3) > 0, F.col(ja3)).otherwise(F.concat(F.lit("-"), F.xxhash64("flow_id", "flow_start_us").cast("string")))
    return df.drop(name).withColumn("_ja3", key).join(known, "_ja3", "left").drop("_ja3")
