import base64
import random
from decimal import Decimal, localcontext

from pyspark.sql import functions as F

from tests.conftest import IDS, MAX
from tickloom.functions import fixed as X
from tickloom.functions.ids import csv_reference, event_id, failure_id, frame_reference
from tickloom.functions.jsontext import json_string
from tickloom.functions.text import (
    binary_payload, pad_symbol, payload_preview, redact_message, redact_payload, trim_symbol, upper_venue,
)
from tickloom.functions.times import iso_parse, iso_utc, nanos_parse


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)],
                               f"i int, {schema}")
    return [r[0] for r in df.select(column.alias("v"), "i").orderBy("i").select("v").collect()]


def test_event_ids_match_the_published_ones(spark):
    got = values(spark, list(IDS), "n bigint", event_id(F.lit("feed/alpha"), F.col("n")))
    assert got == list(IDS.values())


def test_failure_id_ignores_payload_and_separates_parts(spark):
    def make(*parts):
        return failure_id(*[F.lit(p) for p in parts])

    a, b, c = spark.range(1).select(
        make("p", "1", "PARSE", "f:line 1", None, "C", "m"), make("p", "1", "PARSE", "f:line 1", "", "C", "m"),
        make("p", "1", "PARSE", "f:line", " 1", "C", "m")).first()
    assert a == b != c and len(a) == 64


def test_references(spark):
    assert spark.range(1).select(csv_reference(F.lit("s"), F.lit(3)), frame_reference(F.lit("s"), F.lit(4))).first() \
        == ("csv:s:row:3", "stp:s:frame:4")


def plain(m, s):
    digits = str(abs(m)).rjust(s + 1, "0")
    text = digits if s == 0 else f"{digits[:-s]}.{digits[-s:]}"
    return ("-" if m < 0 else "") + text


def random_decimals(n=400):
    rng = random.Random(7)
    edges = [0, 1, -1, 9, 10, MAX, -MAX - 1, 5, -5, 100, 10 ** 18]
    pool = [rng.choice(edges) if rng.random() < 0.4 else rng.randint(-10 ** rng.randint(1, 18), 10 ** rng.randint(1, 18))
            for _ in range(n)]
    return [(m, rng.randint(0, 18)) for m in pool]


def test_plain_text_and_parse_are_inverse(spark):
    rows = random_decimals()
    fd = X.fixed(F.col("m"), F.col("s"))
    assert values(spark, rows, "m bigint, s int", X.fd_plain(fd)) == [plain(m, s) for m, s in rows]
    back = values(spark, rows, "m bigint, s int", X.fd_parse(X.fd_plain(fd)))
    assert [(r["mantissa"], r["scale"]) for r in back] == rows


def test_compare_is_exact_across_scales(spark):
    rows = [(*a, *b) for a, b in zip(random_decimals(), reversed(random_decimals()))]
    rows += [(100, 2, 1, 0), (MAX, 0, MAX, 18), (-MAX - 1, 0, -MAX - 1, 18), (10, 1, 1, 0)]
    got = values(spark, rows, "a bigint, s int, b bigint, t int",
                 X.fd_compare(X.fixed(F.col("a"), F.col("s")), X.fixed(F.col("b"), F.col("t"))))
    with localcontext() as ctx:
        ctx.prec = 60
        want = [int(Decimal(a).scaleb(-s).compare(Decimal(b).scaleb(-t))) for a, s, b, t in rows]
    assert got == want


def test_literal_comparison_equals_compare(spark):
    rows = random_decimals()
    for op, test in (("LT", lambda c: c < 0), ("GTE", lambda c: c >= 0), ("EQ", lambda c: c == 0)):
        fd = X.fixed(F.col("m"), F.col("s"))
        got = values(spark, rows, "m bigint, s int", X.fd_compare_literal(fd, 100, 2, op))
        assert got == [test(Decimal(m) - Decimal(10) ** s) for m, s in rows]


def test_rescale_is_exact_or_null(spark):
    rows = random_decimals()
    for target in (0, 2, 18):
        got = values(spark, rows, "m bigint, s int", X.fd_rescale(X.fixed(F.col("m"), F.col("s")), target))
        for (m, s), r in zip(rows, got):
            up = target - s
            value = m * 10 ** up if up >= 0 else (m // 10 ** -up if m % 10 ** -up == 0 else None)
            fits = value is not None and -MAX - 1 <= value <= MAX
            assert (r["mantissa"] if r else None) == (value if fits else None)


def test_decimal_text_rules(spark):
    good = {"187.2500": (1872500, 4), "-0.05": (-5, 2), "007": (7, 0), "0" * 50 + "1.5": (15, 1), str(MAX): (MAX, 0)}
    bad = ["", "-", "+1", "1.", ".5", "1e3", "1.2.3", " 1", "1\n", str(MAX + 1), "0." + "0" * 19, "abc"]
    got = values(spark, list(good) + bad, "x string", X.fd_parse(F.col("x")))
    assert [(r["mantissa"], r["scale"]) if r else None for r in got] == list(good.values()) + [None] * len(bad)


def test_price_text(spark):
    cases = {"187.25": 18725, "1e3": 100000, "12.345": None, ".5": 50, "5.": 500, "+5.10": 510, "1.2E-1": 12, "0e5": 0,
             "92233720368547758.07": MAX, "92233720368547758.08": None, "-92233720368547758.08": -MAX - 1, "": None, "x": None,
             "1.10000000000000000000000000000000000000000000000": 110, "1e99999999999": None, "1e-2": 1, "1e400": None,
             "12 ": None, "-": None, "1_0": None, "123456789012345.12": 12345678901234512}
    assert values(spark, list(cases), "x string", X.price_at_scale(F.col("x"), 2)) == list(cases.values())


def test_long_and_nanos_text(spark):
    cases = {"5": 5, "+5": 5, "-5": -5, " 5": None, "5 ": None, "5\n": None, "1.0": None, str(MAX): MAX, str(MAX + 1): None, "": None}
    assert values(spark, list(cases), "x string", X.long_parse(F.col("x"))) == list(cases.values())
    assert values(spark, ["-1", "0", "7"], "x string", nanos_parse(F.col("x"))) == [None, 0, 7]


def test_instants(spark):
    cases = {"1970-01-01T00:00:01.000000001Z": 1000000001, "2262-04-11T23:47:16.854775807Z": MAX,
             "2262-04-11T23:47:16.854775808Z": None, "2024-02-30T00:00:00Z": None, "1969-12-31T23:59:59Z": None,
             "2024-01-01T24:00:00Z": 1704153600000000000, "2024-01-01T00:00:00+01:00": 1704063600000000000,
             "2024-01-01T00:00:00-00:00:30": 1704067230000000000, "2024-01-01t00:00:00.5z": 1704067200500000000,
             "2024-01-01T23:59:60Z": 1704153599000000000, "2024-01-01T00:00:60Z": None, "2024-01-01 00:00:00Z": None,
             "2024-01-01T00:00:00": None, "2024-01-01T00:00:00+19:00": None, "2024-01-01T00:00Z": None}
    assert values(spark, list(cases), "x string", iso_parse(F.col("x"))) == list(cases.values())
    shown = {0: "1970-01-01T00:00:00Z", 1_500_000_000: "1970-01-01T00:00:01.500Z", 1_000_001_000: "1970-01-01T00:00:01.000001Z",
             MAX: "2262-04-11T23:47:16.854775807Z"}
    assert values(spark, list(shown), "x bigint", iso_utc(F.col("x"))) == list(shown.values())


def test_instants_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.range(1).select(iso_utc(F.lit(1704067200000000000)), iso_parse(F.lit("2024-01-01T00:00:00Z"))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row == ("2024-01-01T00:00:00Z", 1704067200000000000)


def test_messages(spark):
    cases = {"a\r\n\tb": "a b", "Password = abc, token:x": "Password=[REDACTED], token=[REDACTED]", "  ": "unspecified failure",
             "api-key:1 api_key=2": "api-key=[REDACTED] api_key=[REDACTED]", "x" * 512: "x" * 512, "x" * 513: "x" * 512 + "..."}
    assert values(spark, list(cases), "x string", redact_message(F.col("x"))) == list(cases.values())


def test_payload_is_redacted_then_cut_between_characters(spark):
    got = values(spark, ['{"password":"do-not-retain"}', "héé€😀"], "x string", redact_payload(F.col("x"), 64))
    assert got[0]["value"] == '{"password=[REDACTED]}' and not got[0]["truncated"]
    text = "aé€😀z"
    for limit in range(1, 12):
        cut = values(spark, [text], "x string", redact_payload(F.col("x"), limit))[0]
        want = ""
        for ch in text:
            if len((want + ch).encode()) > limit:
                break
            want += ch
        assert (cut["value"], cut["truncated"]) == (want, want != text)


def test_binary_payload_and_preview(spark):
    data = bytes(range(200))
    got = spark.createDataFrame([(bytearray(data),)], "b binary").select(
        binary_payload(F.col("b"), 150).alias("p")).first()["p"]
    assert base64.b64decode(got["value"]) == data[:150] and got["truncated"] and "\n" not in got["value"]
    long = spark.range(1).select(redact_payload(F.lit("y" * 5000), 4999).alias("p")).select(
        payload_preview(F.col("p")).alias("v")).first()["v"]
    assert len(long["value"]) == 4096 and long["truncated"]


def test_symbol_venue_and_json_text(spark):
    row = spark.range(1).select(pad_symbol(F.lit("AB")), trim_symbol(F.lit("AB      ")), upper_venue(F.lit("x-1"))).first()
    assert row == ("AB      ", "AB", "X-1")
    text = 'q" b\\ \b\f\n\r\t \x01\x1f é😀/ \\u000B'
    assert values(spark, [text], "x string", json_string(F.col("x"))) == [
        '"q\\" b\\\\ \\b\\f\\n\\r\\t \\u0001\\u001f é😀/ \\\\u000B"']
