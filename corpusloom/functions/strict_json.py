"""Strict validation of model output: no coercion, no missing or unknown keys, bounded lists.

The shape is read off the parsed value's own schema, so a number as text, a
Boolean as number, or an extra key is told apart before anything is cast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLAIMS = "array<struct<text:string,sources:array<int>>>"
_INT = "(?:BIGINT)"
_CLAIM = rf"OBJECT<sources: ARRAY<{_INT}>, text: STRING>"
#: The schema a valid answer has; key order is that of the names.
_ANSWER = rf"^OBJECT<claims: ARRAY<(?:{_CLAIM}|VOID)>, supported: BOOLEAN>$"
_JUDGE_PAIR = rf"OBJECT<pair: {_INT}, supported: BOOLEAN>"
_JUDGMENT = rf"^OBJECT<accurate: BOOLEAN, citations: ARRAY<(?:{_JUDGE_PAIR}|VOID)>>$"


def parsed(x: Column) -> Column:
    return F.try_parse_json(x)


def answer(x: Column) -> Column:
    """struct<supported boolean, claims array<struct<text, sources>>> of a valid answer, else null.

    At most 8 claims; each of 1 to 2000 characters with 1 to 20 source numbers.
    """
    v = parsed(x)
    claims = F.try_variant_get(v, "$.claims", CLAIMS)
    ok = F.schema_of_variant(v).rlike(_ANSWER) & (F.size(claims) <= 8) & F.forall(claims, lambda c: F.length(c["text"]).between(1, 2000) & F.size(c["sources"]).between(1, 20))
    return F.when(ok, F.struct(F.try_variant_get(v, "$.supported", "boolean").alias("supported"), claims.alias("claims")))


def judgment(x: Column) -> Column:
    """struct<accurate boolean, citations array<struct<pair, supported>>> of a valid judgment, else null. Pairs start at 1."""
    v = parsed(x)
    pairs = F.try_variant_get(v, "$.citations", "array<struct<pair:int,supported:boolean>>")
    ok = F.schema_of_variant(v).rlike(_JUDGMENT) & F.forall(pairs, lambda c: c["pair"] >= 1)
    return F.when(ok, F.struct(F.try_variant_get(v, "$.accurate", "boolean").alias("accurate"), pairs.alias("citations")))


def complete_judgment(judged: Column, pairs: Column) -> Column:
    """Whether a judgment decides exactly the pairs 1..n; n may be 0."""
    expected = F.when(pairs > 0, F.sequence(F.lit(1), pairs.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.transform(judged["citations"], lambda c: c["pair"]) == expected, F.lit(False))
