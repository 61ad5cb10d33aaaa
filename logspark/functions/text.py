"""Scalar functions of the event model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a, 64 bits. Only the low 54 bits are kept; the four lanes need no more.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME_LOW = 435
FNV_PRIME_HIGH_SHIFT = 40
_LOW54 = (1 << 54) - 1


def get(m: Column | str, key: str) -> Column:
    """A map's value; a missing key reads as empty."""
    return F.coalesce(F.element_at(m, key), F.lit(""))


def put(m: Column, key: str, value: Column) -> Column:
    return F.map_concat(without(m, key), F.create_map(F.lit(key), value))


def without(m: Column, key: str) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def overlay(low: Column, high: Column) -> Column:
    """Both maps' keys; where they share one, the value of `high`. Maps should be columns, as they are read often."""
    both = F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)
    return F.when(F.size(low) == 0, high).when(F.size(high) == 0, low).otherwise(both)


def sorted_pairs(pairs: Column) -> Column:
    """An array of structs k, v in the order of k, of equal ones the last first."""
    return F.sort_array(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), (-i).alias("at"), p["v"].alias("v"))))


def map_of_sorted(pairs: str) -> Column:
    """The map of a column of sorted_pairs: the last of each key. It has to be a column, as each step looks back in it."""
    last = F.filter(pairs, lambda p, i: (i == 0) | (F.get(pairs, i - 1)["k"] != p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def blank(x: Column) -> Column:
    x = F.coalesce(x, F.lit(""))
    return (x == "") | ~x.rlike(r"(?U)\S")


def first_non_blank(*values: Column) -> Column:
    """The first value that isn't blank, untrimmed; else empty."""
    return F.coalesce(*[F.when(~blank(v), v) for v in values], F.lit(""))


def severity(x: Column) -> Column:
    """Trimmed and in small letters; `warning` becomes `warn`."""
    low = F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.when(low == "warning", F.lit("warn")).otherwise(low)


def number_text(x: Column) -> Column:
    """A double with up to six decimals, no zeros at the end."""
    return F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")


def general_number(x: Column) -> Column:
    """A double with as few digits as tell it apart; an exponent, of two digits at least, below 0.0001 and from 10^21 on."""
    shown = x.cast("string")
    digits = F.regexp_replace(F.regexp_replace(shown.try_cast("decimal(38,22)").cast("string"), r"0+$", ""), r"\.$", "")
    whole = shown.try_cast("decimal(38,0)").cast("string")
    power = F.regexp_replace(F.regexp_replace(shown, r"(\.0)?E(\d)", "e+$2"), r"(\.0)?E-", "e-")
    power = F.regexp_replace(power, r"e([+-])(\d)$", "e$10$2")
    return F.when((F.abs(x) >= 1e21) | ((F.abs(x) < 1e-4) & (x != 0)), power).when(x == F.rint(x), whole).otherwise(digits)


def stream_key(tenant: Column | str, labels: Column | str) -> Column:
    """tenant|k=v|..., keys in order; the bare tenant without labels."""
    tenant, labels = (F.col(x) if isinstance(x, str) else x for x in (tenant, labels))
    pairs = F.transform(F.array_sort(F.map_keys(labels)), lambda k: F.concat(k, F.lit("="), F.element_at(labels, k)))
    return F.concat_ws("|", tenant, pairs)


def tokens(body: Column) -> Column:
    """Runs of ASCII letters and digits in small letters."""
    return F.filter(F.split(F.lower(body), "[^a-z0-9]+"), lambda t: t != "")


def bloom_bits(token: Column) -> Column:
    """The four bit numbers (one for each 64-bit lane) of a token of ASCII letters and digits."""
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, b: (
        F.shiftleft(h.bitwiseXOR(b).bitwiseAND(F.lit((1 << 14) - 1)), FNV_PRIME_HIGH_SHIFT) + h.bitwiseXOR(b) * FNV_PRIME_LOW
    ).bitwiseAND(F.lit(_LOW54))
    h = F.aggregate(codes, F.lit(FNV_OFFSET & _LOW54).cast("long"), step)
    return F.array(*[F.shiftright(h, 16 * lane).bitwiseAND(F.lit(63)).cast("int") for lane in range(4)])


def stored_bytes(body: Column, texts: list[Column], maps: list[Column]) -> Column:
    """Bytes of the body, some texts, and all keys and values of some maps."""
    total = F.octet_length(body).cast("long")
    for t in texts:
        total = total + F.octet_length(t)
    for m in maps:
        total = total + F.aggregate(F.map_entries(m), F.lit(0).cast("long"), lambda n, e: n + F.octet_length(e["key"]) + F.octet_length(e["value"]))
    return total


def bucket(ts: Column) -> Column:
    """The hour's segment, YYYY-MM-DD/HH."""
    return F.date_format(ts, "yyyy-MM-dd/HH")


def hex_id(x: Column) -> Column:
    """A trace or span id: standard base64 is decoded to hex, anything else put in small letters."""
    base64 = x.rlike(r"^[A-Za-z0-9+/]*={0,2}\z") & (F.length(x) % 4 == 0) & (x != "")
    return F.when(base64, F.lower(F.hex(F.unbase64(F.when(base64, x))))).otherwise(F.lower(F.coalesce(x, F.lit(""))))
