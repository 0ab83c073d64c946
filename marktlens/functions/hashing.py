"""Stable hashes of texts."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.LongType())
def h64(texts: pd.Series) -> pd.Series:
    """BLAKE2b of eight bytes, big-endian, as a signed long; a null text hashes as an empty one. Spark has no such function."""
    return texts.map(lambda t: int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=8).digest(), "big", signed=True))


def task_hashes(kind: Column, product: Column, company: Column, place: Column) -> dict[str, Column]:
    """Hashes of what a task's ratings of contacts, branches and cities depend on."""
    k, p, c, g = (F.coalesce(x, F.lit("")) for x in (kind, product, company, place))
    return {"contact": h64(F.concat(k, p, c, g)), "branch": h64(F.concat(p, c)), "city": h64(F.concat(p, c, g))}


DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def short_id(key: Column, mask: int, factor: int) -> Column:
    """A bijection of 32-bit keys, written in base 62 (digits, capitals, small letters)."""
    product = key.bitwiseXOR(F.lit(mask)).cast("decimal(20,0)") * F.lit(factor).cast("decimal(12,0)")
    n = F.pmod(product, F.lit(1 << 32).cast("decimal(20,0)")).cast("long") + 1
    places = [F.floor(n / F.lit(62**i)).cast("long") for i in range(5, -1, -1)]
    text = F.concat(*[F.substring(F.lit(DIGITS), (p % 62 + 1).cast("int"), F.lit(1)) for p in places])
    return F.regexp_replace(text, "^0+(?=.)", "")


def long_id(text: Column, mask: int, factor: int) -> Column:
    """The inverse of short_id for an odd factor; null for texts that aren't such an id."""
    digits = F.split(text, "")
    n = F.aggregate(digits, F.lit(0).cast("long"), lambda t, d: t * 62 + F.instr(F.lit(DIGITS), d) - 1)
    product = (n - 1).cast("decimal(20,0)") * F.lit(pow(factor, -1, 1 << 32)).cast("decimal(12,0)")
    key = F.pmod(product, F.lit(1 << 32).cast("decimal(20,0)")).cast("long").bitwiseXOR(F.lit(mask))
    return F.when(text.rlike("^[0-9A-Za-z]{1,6}$"), F.when(n.between(1, 1 << 32), key))


def memo_key(function: str, *arguments: Column) -> Column:
    """SHA-1 of a function's name and its arguments as JSON: the key of its stored result."""
    return F.sha1(F.concat(F.lit(function), F.lit(":"), F.to_json(F.array(*[a.cast("string") for a in arguments]))))
