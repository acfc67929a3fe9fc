"""Lengths of what Python's ``json.dumps`` writes with its defaults, as column expressions: a
space after each colon and comma, signs outside printable ASCII escaped, floats as ``repr``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def escaped_bytes(c) -> Column:
    """Bytes of JSON text after escaping: 1 for printable ASCII, 6 (\\uXXXX) for another sign, 12
    (two such) for one outside the basic plane."""
    c = _c(c)
    odd = F.regexp_count(c, F.lit(r"[^\x20-\x7E]"))
    astral = F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return F.length(c) + 5 * odd + 6 * astral


def string_length(c) -> Column:
    """Bytes of a string with its quotes; of null, 4."""
    js = F.to_json(F.struct(_c(c).alias("s")))                # {"s":"..."}
    return F.when(_c(c).isNull(), 4).otherwise(escaped_bytes(js) - len('{"s":}'))


def int_length(c) -> Column:
    return F.coalesce(F.length(_c(c).cast("string")), F.lit(4))


def float_length(c) -> Column:
    """Characters of ``repr(float)``: the fewest digits that read back as the same (normal)
    number, without an exponent from 1e-4 up to 1e16. Of null, 4.

    A lambda over an array of one, as Spark interprets lambdas: several such
    expressions in one row would outgrow a generated method."""
    return F.transform(F.array(_c(c).cast("double")), _float_length)[0]


def _float_length(x: Column) -> Column:
    size = F.abs(x)

    def digits(places):
        """Mantissa digits without the zeros at its end, and the decimal exponent."""
        text = F.format_string(f"%.{places - 1}e", size)
        mantissa = F.rtrim(F.replace(F.substring_index(text, "e", 1), F.lit("."), F.lit("")), F.lit("0"))
        same = text.cast("double") == size
        return F.length(mantissa), F.substring_index(text, "e", -1).cast("int"), same

    n15, e15, same15 = digits(15)
    n16, e16, same16 = digits(16)
    n17, e17, _ = digits(17)
    n = F.when(same15, n15).when(same16, n16).otherwise(n17)
    e = F.when(same15, e15).when(same16, e16).otherwise(e17)
    plain = F.when(e >= n - 1, e + 3).when(e >= 0, n + 1).otherwise(n + 1 - e)
    power = n + F.when(n > 1, 1).otherwise(0) + 2 + F.greatest(F.lit(2), F.length(F.abs(e).cast("string")))
    number = F.when((e >= -4) & (e < 16), plain).otherwise(power)
    sign = x.cast("string").startswith("-").cast("int")
    return F.when(x.isNull(), 4).when(F.isnan(x), 3).when(size == float("inf"), 8 + sign) \
        .when(x == 0, 3 + sign).otherwise(number + sign)
