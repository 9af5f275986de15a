"""SQL names for the scalar functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from wiretide.functions.dns import decode_question
from wiretide.functions.domain import TWO_LEVEL_SUFFIXES
from wiretide.functions.net import IS_INTERNAL_SQL
from wiretide.functions.tls import decode_client_hello

_SUFFIXES = ", ".join(f"'{s}'" for s in TWO_LEVEL_SUFFIXES)

# SQL functions are inlined by the optimizer, so they cost no more than the written-out expression
_SQL_FUNCTIONS = {
    "shannon_entropy": ("(s string) returns double", """
        case when length(s) > 0 then greatest(0D, log2(cast(length(s) as double)) - aggregate(
          array_distinct(filter(split(s, ''), c -> c <> '')), 0D,
          (acc, c) -> acc + (length(s) - length(replace(s, c))) * log2(cast(length(s) - length(replace(s, c)) as double))) / length(s))
        else 0D end"""),
    "domain_split": ("(d string) returns struct<label:string, subdomain:string, suffix:string>", f"""
        element_at(transform(array(filter(split(lower(d), '[.]'), x -> x <> '')), p ->
          element_at(transform(array(size(p) - case when size(p) >= 3 and concat_ws('.', slice(p, -2, 2)) in ({_SUFFIXES}) then 2
                                                    when size(p) >= 2 then 1 else 0 end), k -> named_struct(
            'label', case when k >= 1 then element_at(p, greatest(k, 1)) else '' end,
            'subdomain', case when k > 1 then concat_ws('.', slice(p, 1, greatest(k - 1, 0))) else '' end,
            'suffix', case when k >= 1 then concat_ws('.', slice(p, k + 1, size(p))) else concat_ws('.', p) end)), 1)), 1)"""),
    "is_internal_ip": ("(ip string) returns boolean", IS_INTERNAL_SQL),
}


def register(spark: SparkSession) -> None:
    """Make the functions callable from SQL in this session."""
    for name, (signature, body) in _SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}{signature} return {body}")
    spark.udf.register("parse_client_hello", decode_client_hello)
    spark.udf.register("parse_dns_query", decode_question)
