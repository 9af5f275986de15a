"""Decoding of DNS questions from payload bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F, types as T

DNS_PORTS = (53, 5353)

QUESTION_SCHEMA = T.StructType([
    T.StructField("ok", T.BooleanType()),
    T.StructField("query_name", T.StringType()),
    T.StructField("query_type", T.StringType()),
])


def _name(data: bytes, at: int) -> tuple[str, int]:
    """A possibly compressed name and the offset behind it."""
    parts, size, resume, floor = [], 0, None, at
    while True:
        length = data[at]
        if length == 0:
            break
        if length >= 0xC0:
            target = int.from_bytes(data[at:at + 2], "big") & 0x3FFF
            # Pointers must lead strictly backwards, so decoding always ends
            if at + 2 > len(data) or target >= floor:
                raise ValueError("bad compression pointer")
            resume = at + 2 if resume is None else resume
            at = floor = target
            continue
        if length >= 0x40:
            raise ValueError("bad label length")
        parts.append(data[at + 1:at + 1 + length])
        size += length + 1
        if size > 255:
            raise ValueError("name too long")
        at += 1 + length
    return b".".join(parts).decode("utf-8"), (at + 1 if resume is None else resume)


def _question(payload: bytes | None) -> tuple[bool, str | None, str | None]:
    """First question of a message; every section must be well formed."""
    if not payload or len(payload) < 12:
        return False, None, None
    counts = [int.from_bytes(payload[i:i + 2], "big") for i in (4, 6, 8, 10)]
    name, kind, at = "", "UNKNOWN", 12
    try:
        for index in range(counts[0]):
            current, at = _name(payload, at)
            if at + 4 > len(payload):
                return False, None, None
            if index == 0:
                name, kind = current, str(int.from_bytes(payload[at:at + 2], "big"))
            at += 4
        for _ in range(sum(counts[1:])):
            _, at = _name(payload, at)
            if at + 10 > len(payload):
                return False, None, None
            at += 10 + int.from_bytes(payload[at + 8:at + 10], "big")
            if at > len(payload):
                return False, None, None
    except (IndexError, ValueError):
        return False, None, None
    return True, name, kind


@F.pandas_udf(QUESTION_SCHEMA)
def decode_question(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [field.name for field in QUESTION_SCHEMA.fields]
    for payloads in batches:
        yield pd.DataFrame([_question(p) for p in payloads], columns=names)
