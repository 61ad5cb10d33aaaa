import pytest
from pyspark.sql import functions as F

from logspark.functions import regex, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_stream_key(spark):
    labels = F.create_map(F.lit("service"), F.lit("api"), F.lit("env"), F.lit("prod"))
    assert one(spark, text.stream_key(F.lit("tenant-a"), labels)) == "tenant-a|env=prod|service=api"
    assert one(spark, text.stream_key(F.lit("t"), F.create_map().cast("map<string,string>"))) == "t"


@pytest.mark.parametrize("x, want", [(500.0, "500"), (1.5, "1.5"), (0.0, "0"), (1234567.25, "1234567.25"), (100.0, "100"), (-0.1234567, "-0.123457")])
def test_number_text(spark, x, want):
    assert one(spark, text.number_text(F.lit(x))) == want


def test_severity_and_blank(spark):
    assert one(spark, text.severity(F.lit("  WARNING\t"))) == "warn"
    assert one(spark, text.severity(F.lit("Error"))) == "error"
    assert one(spark, text.first_non_blank(F.lit(None), F.lit("  "), F.lit(" b "), F.lit("c"))) == " b "


def fnv(token):
    h = 0xCBF29CE484222325
    for b in token.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return [h >> 16 * lane & 63 for lane in range(4)]


@pytest.mark.parametrize("token", ["a", "timeout", "k42", "0", "z" * 50])
def test_bloom_bits(spark, token):
    assert one(spark, text.bloom_bits(F.lit(token))) == fnv(token)


def test_tokens(spark):
    assert one(spark, text.tokens(F.lit("GET /api/v1?x=Ünal 500!"))) == ["get", "api", "v1", "x", "nal", "500"]


def test_hex_id(spark):
    assert one(spark, text.hex_id(F.lit("AAECAw=="))) == "00010203"
    assert one(spark, text.hex_id(F.lit("ABC-D"))) == "abc-d"
    assert one(spark, text.hex_id(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize(
    "pattern, body, hit",
    [("a$", "a\n", False), ("(?m)a$", "a\nb", True), ("a.c", "a\rc", True), ("a.c", "a\nc", False), (r"\s", "\x0b", False), ("[$]", "$", True), (r"timeout\s+\w+", "timeout beta", True), (r"\$x", "$x", True)],
)
def test_regex_dialect(spark, pattern, body, hit):
    assert one(spark, F.lit(body).rlike(regex.to_java(pattern)[0])) is hit


def test_regex_groups_and_limits():
    assert regex.to_java(r"(a)(?P<b_1>x)(?:y)(?<c>z)")[1] == [("b_1", 2), ("c", 3)]
    for bad in (r"(a)\1", "(?=a)", "a++", "(?<!a)b", "x" * 257):
        with pytest.raises(ValueError):
            regex.to_java(bad)


@pytest.mark.parametrize(
    "pattern, body, hit",
    [
        ("^[[:digit:]]+$", "12", True), ("^[[:digit:]]+$", "d:", False), ("^[[:^alpha:]]$", "1", True), ("^[a[:digit:]_]+$", "a1_", True), ("(?i)É", "é", True),
        ("(?i:É)x", "éX", False), ("[a&&b]", "&", True), ("^[]a]+$", "]a", True), ("^[^]a]$", "b", True), ("[[a]", "[", True), (r"\Qa.b\E", "axb", False), (r"\Qa.b\E", "a.b", True),
        (r"^\v$", "\x0b", True), (r"\p{Greek}", "α", True), (r"\pL", "é", True), (r"^[\s]$", "\x0b", False), ("a{,2}", "a{,2}", True), ("(?m)^b$", "a\nb\nc", True), ("^b$", "a\nb\nc", False),
        ("a.c", "a\rc", True), ("a.c", "a\nc", False), ("(?s)a.c", "a\nc", True), (r"^\w+$", "é", False), ("a#b", "a#b", True), ("[#~]", "~", True),
    ],
)
def test_patterns_mean_what_they_mean_in_re2(spark, pattern, body, hit):
    assert one(spark, F.lit(body).rlike(regex.to_java(pattern)[0])) is hit


@pytest.mark.parametrize("bad", ["(?U)a+", r"\C", r"(a)\1", "(?=a)", "[[:letter:]]", "[a", "(a", "a)", "a\\", "a*+", r"\Z"])
def test_patterns_that_are_refused(bad):
    with pytest.raises(ValueError):
        regex.checked(bad)


@pytest.mark.parametrize("x, shown", [(0.0, "0"), (2.0, "2"), (-1.5, "-1.5"), (1e7, "10000000"), (123456789.5, "123456789.5"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (1.5e-7, "1.5e-07"), (0.0001, "0.0001"), (1e100, "1e+100")])
def test_general_number(spark, x, shown):
    assert one(spark, text.general_number(F.lit(x))) == shown
