"""Literal cases of the value functions."""

from pyspark.sql import functions as F

from leadweave.functions import text as T


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_names(spark):
    assert values(spark, T.normalize_name, ["The Acme HVAC, L.L.C.", "Smith & Sons Plumbing Co.", None, "!!!"]) == ["acme hvac", "smith sons plumbing", "", ""]


def test_clean_text(spark):
    assert values(spark, T.clean_text, ["  a \t  b ", "N/A", "na", "", "　", None]) == ["a b", None, None, None, None, None]


def test_domains(spark):
    assert values(spark, T.normalize_domain, ["HTTPS://www.AcmeHVAC.com/about?x=1", "owner@acme.com", "not a domain", "N/A", "www2.x.org:80"]) == ["acmehvac.com", "acme.com", None, None, "x.org"]


def test_phones(spark):
    a, b, c, d, e = values(spark, T.normalize_phone, ["(512) 555-2671", "+1 512 555 2671", "(800) 555-0142", "12345", "+44 20 7946 0958"])
    assert a.e164 == b.e164 == "+15125552671"
    assert c.type == "TOLL_FREE" and c.valid
    assert not d.valid and d.type is None
    assert e.e164 == "+442079460958" and e.valid and e.type is None
    assert values(spark, T.normalize_phone, ["", None, "n/a"]) == [None, None, None]


def test_numbers(spark):
    assert values(spark, T.parse_money, ["$1.2M", "1,500,000", "750k", "1-5M", "$1.2 million", "x", None]) == [1_200_000, 1_500_000, 750_000, 1, 1_200_000, None, None]
    assert values(spark, T.parse_int_loose, ["11-50", "25", "x", None]) == [31, 25, None, None]
    assert values(spark, lambda c: T.parse_year(c, 2026), ["Est. 1998", "3000", None]) == [1998, None, None]


def test_email_rules(spark):
    assert values(spark, T.email_syntax_ok, ["a@b.co", "john.smith@@gmail.com", "a..b@c.com", None]) == [True, False, False, False]
    assert values(spark, T.is_role_email, ["info@x.com", "no-reply@x.com", "bob@x.com", None]) == [True, True, False, False]
    assert values(spark, T.domain_typo_fix, ["gmial.com", "gmail.com"]) == ["gmail.com", None]
    df = spark.createDataFrame([("mx.tempmail.net",), ("com",), (None,)], "d string")
    dim = spark.createDataFrame([("tempmail.net",)], "domain string")
    assert {r.d: r.is_disposable for r in T.flag_disposable(df, "d", dim).collect()} == {"mx.tempmail.net": True, "com": False, None: False}


def test_revenue_traps(spark):
    """The keyword of an earlier group within a word counts."""
    assert values(spark, lambda c: T.estimate_revenue(c, F.lit(10)), ["Auto Repair", "Plumbing", None]) == [2_000_000, 1_800_000, 1_500_000]


def test_similarity_and_money(spark):
    df = spark.createDataFrame([("copperline", "coperline"), ("", "a"), ("a", "a")], "a string, b string")
    assert [round(r[0], 2) for r in df.select(T.name_similarity(F.col("a"), F.col("b"))).collect()] == [0.9, 0.0, 1.0]
    assert values(spark, T.fmt_money, [2e6, 2.5e6, 750e3], "double") == ["$2M", "$2.5M", "$750K"]
