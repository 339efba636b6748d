import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismfold.functions import names as N
from prismfold.functions import values as V


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "raw, norm, first",
    [
        ("Aptean Acquiror, Inc. (dba Aptean)", "aptean", "Aptean Acquiror, Inc. (dba Aptean)"),
        ("Foo L.P.", "foo l p", "Foo L.P."),
        ("The Step2 Company and Co.", "step2 company", "The Step2 Company"),
        ("Mustang Prospects Holdco, LLC, Mustang Prospects Purchaser, LLC and X", "mustang prospects mustang prospects x", "Mustang Prospects Holdco, LLC"),
        ("Zinc, Ltd", "zinc", "Zinc"),
        ("Holdings Group LLC", "", "Holdings Group LLC"),
    ],
)
def test_names(spark, raw, norm, first):
    assert one(spark, N.normalize_name, raw) == norm
    assert one(spark, N.first_entity, raw) == first


def test_jaccard(spark):
    sim = lambda a, b: spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(N.jaccard(F.col("a"), F.col("b"))).first()[0]
    assert sim(list("abc"), list("bcd")) == 0.5
    assert sim([], []) == 0.0


@pytest.mark.parametrize("raw, number", [("$1,234.5", 1234.5), ("(12)", -12.0), ("—", None), ("x", None), ("7", 7.0), ("A-", None)])
def test_clean_number(spark, raw, number):
    assert one(spark, V.clean_number, raw) == number


@pytest.mark.parametrize("raw, name", [("US", "United States"), ("USA", "United States"), ("UK", "United Kingdom"), ("ZZ", "ZZ"), (None, None)])
def test_country(spark, raw, name):
    assert one(spark, V.country_name, raw) == name


@pytest.mark.parametrize("raw", ["NaN", "nan", " None ", ""])
def test_nulls_in_disguise(spark, raw):
    assert one(spark, V.clean_text, raw) is None


def test_quarters(spark):
    assert one(spark, lambda c: V.quarter_label(c.cast("date")), "2024-03-31") == "Q1 2024"
    assert str(one(spark, lambda c: V.quarter_end(c.cast("date")), "2024-02-10")) == "2024-03-31"


def test_instruments_match_inside_words(spark):
    assert [one(spark, V.is_instrument, n) for n in ("Bitcoin Trust", "Bethany Foods", "Acme Robotics")] == [True, True, False]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=20))
def test_md5_uuid_is_pythons(spark, text):
    import hashlib

    assert one(spark, N.md5_uuid, text) == str(uuid.UUID(hashlib.md5(text.encode()).hexdigest()))
