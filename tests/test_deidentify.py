"""Scrubbing of synthetic cases: no forbidden fragment may be left."""

import pytest
from pyspark.sql import functions as F

from talkloom.operators import deidentify

CASES = [
    ("Replies go to nora.k@postbox.example, please.", ["nora.k@postbox.example"], True, True),
    ("Use billing+march@shop.example for invoices", ["billing+march@shop.example"], True, True),
    ("We see timeouts from 172.16.44.9 since noon.", ["172.16.44.9"], True, True),
    ("Open http://172.16.0.7/wp-admin/ and log in", ["172.16.0.7"], True, True),
    ("The page https://garden-club.example/members/list.html stays blank.", ["garden-club.example/members", "https://garden-club"], True, True),
    ("Log in under teashop.com/wp-login.php first", ["teashop.com/wp-login"], True, False),
    ("It says so on www.teashop.example/help/faq", ["www.teashop.example"], True, True),
    ("My number is +1-212-555-0147, after six.", ["+1-212-555-0147"], True, True),
    ("The password is Marzipan#42 as before", ["Marzipan#42"], True, True),
    ("Header was Authorization: Bearer abCdEf0123456789abCdEf0123456789.xyz.123", ["abCdEf0123456789abCdEf0123456789"], True, True),
    ("Our script sends sk-live_zz91yy82xx73ww64vv", ["sk-live_zz91yy82xx73ww64vv"], True, True),
    ("It texted me that the verification code is 518204", ["518204"], False, True),
    ("This is Greta Olsen from the front desk.", ["Greta Olsen"], False, False),
    ("Mail tim@works.example, admin at works.com/wp-admin on 198.51.100.23, password: Lakeside7!", ["tim@works.example", "works.com/wp-admin", "198.51.100.23", "Lakeside7!"], True, False),
]


@pytest.mark.parametrize("variant,column", [("sql", 2), ("codes", 3)])
def test_cases(spark, variant, column):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    for r in df.select("i", deidentify.scrub(F.col("t"), variant).alias("s")).collect():
        clean = not any(x.lower() in r.s.lower() for x in CASES[r.i][1])
        assert clean == CASES[r.i][column], (CASES[r.i][0], r.s)


def test_order_shows(spark):
    got = spark.createDataFrame([("Open http://172.16.0.7/wp-admin/",)], "t string").select(deidentify.scrub(F.col("t"))).first()[0]
    assert got == "Open [URL]]/wp-admin/"


def test_numbers_never_pass_one(spark):
    df = spark.createDataFrame([("[PERSON] met [PERSON] at [URL]",)], "t string").select(deidentify.number_placeholders(F.col("t")).alias("t"))
    assert df.first()[0] == "[PERSON_1] met [PERSON_1] at [URL_1]"
    assert df.select(deidentify.number_placeholders(F.col("t"))).first()[0] == df.first()[0]


def test_residual(spark):
    got = {r.risk_type: (r.hits, r.status) for r in deidentify.residual_scan(spark.createDataFrame([("a@b.io",), ("clean",), (None,)], "t string"), "t").collect()}
    assert got["email"] == (1, "REVIEW") and got["ipv4"] == (0, "CLEAN") and len(got) == 8
