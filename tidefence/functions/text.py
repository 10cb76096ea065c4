"""Text and number formats as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import _let, _product


def _exact(digits: int):
    @F.pandas_udf("string")
    def text(v: pd.Series) -> pd.Series:
        return pd.Series([None if x != x else f"{x:.{digits}g}" for x in v], dtype=object)

    return text


def _is_tie(v: Column, digits: int) -> Column:
    """Whether the shortest decimal of v has one digit more than is printed, a five."""
    sig = F.rtrim(F.regexp_replace(F.regexp_replace(F.abs(v).cast("string"), "E.*", ""), r"^0\.0*|\.", ""), F.lit("0"))
    return (F.length(sig) == digits + 1) & sig.endswith("5")


def _untied(v: Column, digits: int) -> Column:
    """v, or its neighbour towards zero where Java would round a tie of its shortest decimal up although the double itself, half to even, goes down.

    The tie is decided by an exact product with a power of ten, for powers up to 22 (at 15 digits: sizes from 1e-7 to 1e15). Each step is bound once.
    """
    size = F.abs(v)
    sig = F.rtrim(F.regexp_replace(F.regexp_replace(size.cast("string"), "E.*", ""), r"^0\.0*|\.", ""), F.lit("0"))
    power = F.lit(digits) - F.substring_index(F.format_string("%.17e", size), "e", -1).try_cast("int")
    tens = F.array(*[F.lit(float(10**i)) for i in range(23)])
    bound = F.struct(sig.try_cast("long").alias("d"), power.alias("power"), F.get(tens, power).alias("ten"))

    def settled(t: Column) -> Column:
        p, low = _product(size, t["ten"])
        d, high = t["d"], t["d"].cast("double")
        rest = ((p - high) - (d - high.cast("long")).cast("double")) + low
        down = t["power"].between(0, 22) & ((rest < 0) | ((rest == 0) & (F.floor(d / 10) % 2 == 0)))
        return F.when(down, v * (1 - 2.0**-52)).otherwise(v)

    return _let(bound, settled)


def _java_number(v: Column, digits: int) -> Column:
    """v in C's %g notation with the digits that Java prints; the mantissa is printed once."""
    strip = lambda s: F.when(F.contains(s, F.lit(".")), F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))).otherwise(s)

    def shown(sci: Column) -> Column:
        exponent = F.substring_index(sci, "e", -1).cast("int")
        # the rounded decimal is exact, so printing it with many places and stripping zeros prints the digits alone
        plain = strip(sci.try_cast("decimal(38,20)").cast("string"))
        power = F.concat(F.when(exponent < 0, "-").otherwise("+"), padded(F.abs(exponent), 2))
        small = (exponent >= -4) & (exponent < digits)
        return F.when(small, plain).otherwise(F.concat(strip(F.substring_index(sci, "e", 1)), F.lit("e"), power))

    special = F.when(v == float("inf"), "inf").when(v == -float("inf"), "-inf").when(F.isnan(v), "nan")
    zero = F.when(F.format_string("%.1f", v).startswith("-"), "-0").otherwise("0")
    return F.when(v.isNull(), None).when(special.isNotNull(), special).when(v == 0, zero).otherwise(_let(F.format_string(f"%.{digits - 1}e", v), shown))


def short_number(v: Column, digits: int = 15, arrow: bool = True) -> Column:
    """A double with so many significant digits and without trailing zeros, as C's %g prints it; nan, inf and -inf.

    Plain notation for exponents from -4 up to digits, else mantissa and an exponent of at least two digits. Java rounds the shortest decimal that
    reads back as the same double. That is the double's own rounding unless what follows the last digit is nearly a half; only those rows,
    subnormal numbers, and numbers of 16 and more digits are printed in Arrow batches, all others in the JVM. Without arrow all are printed in the JVM;
    ties are then exact for sizes from 1e-7 to 1e15 at 15 digits, and what is smaller or larger may be rounded up at a tie.
    """
    size, text = F.abs(v), v.cast("string")
    # Java's shortest decimal as it stands: no exponent, no more digits than are printed, so nothing is rounded (at most 15 digits of a double are its own)
    short = (size >= 1e-3) & (size < float(10 ** min(digits, 7))) & (F.length(text) <= digits + 1) if digits <= 15 else F.lit(False)
    plain = F.when(short, F.when(text.endswith(".0"), F.substring_index(text, ".", 1)).otherwise(text))
    if not arrow:
        return plain.when(_is_tie(v, digits), _let(_untied(v, digits), lambda u: _java_number(u, digits))).otherwise(_java_number(v, digits))
    shortest = F.regexp_replace(F.regexp_replace(size.cast("string"), "E.*", ""), r"^0\.0*|\.", "")
    nearly_half = F.substr(shortest, F.lit(digits + 1), F.lit(1)).isin("3", "4", "5", "6")
    doubt = nearly_half | (size < 2.3e-308) if digits <= 15 else size < float("inf")
    doubt = doubt & (size > 0) & (size < float("inf"))
    return plain.when(doubt, _exact(digits)(F.when(doubt, v))).otherwise(_java_number(v, digits))


def point_wkt(x: Column, y: Column, crs: Column | None = None) -> Column:
    text = F.concat(F.lit("POINT ("), short_number(x, arrow=False), F.lit(" "), short_number(y, arrow=False), F.lit(")"))
    return text if crs is None else F.concat(F.lit("<"), crs, F.lit("> "), text)


def _corners(digits: int = 15):
    @F.pandas_udf("string")
    def text(shells: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else ", ".join(f"{p['x']:.{digits}g} {p['y']:.{digits}g}" for p in s) for s in shells], dtype=object)

    return text


def polygon_wkt(shell: Column, crs: Column | None = None) -> Column:
    """shell: array of struct<x, y>; its corners are printed in Arrow batches."""
    text = F.concat(F.lit("POLYGON (("), _corners()(shell), F.lit("))"))
    return text if crs is None else F.concat(F.lit("<"), crs, F.lit("> "), text)


def iri_part(s: Column) -> Column:
    """Percent-encoding of everything but letters, digits and _.-~ in UTF-8."""
    out = F.url_encode(s)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def json_string(s: Column) -> Column:
    """A JSON string literal; non-ASCII characters stay, control characters are written in lower-case hexadecimal."""
    literal = F.substring(F.to_json(F.named_struct(F.lit("v"), s)), 6, 2**31 - 1)
    literal = F.substr(literal, F.lit(1), F.length(literal) - 1)
    # to_json writes \u001F, the format wants \u001f; only 00-1F occur, so six letters in two places
    for c in "ABCDEF":
        for h in "01":
            literal = F.replace(literal, F.lit(f"\\u00{h}{c}"), F.lit(f"\\u00{h}{c.lower()}"))
    return literal


def iri_local_name(s: Column) -> Column:
    """What follows the last / and then the last #."""
    return F.substring_index(F.substring_index(s, "/", -1), "#", -1)


def padded(i: Column, width: int = 4) -> Column:
    """A number with leading zeros; longer ones stay whole."""
    text = i.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def duration_us(amount: Column, unit: Column) -> Column:
    """An amount in ms, s, min, h or day as whole microseconds."""
    factors = F.create_map(*[F.lit(v) for k, f in {"ms": 1e3, "s": 1e6, "min": 6e7, "h": 3.6e9, "day": 8.64e10}.items() for v in (k, f)])
    return F.bround(amount * F.element_at(factors, unit)).cast("long")
