"""Hand-derived values of the text and similarity functions."""

import pytest
from pyspark.sql import functions as F

from kinfolk.functions import normalise, phonetics, similarity, text


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


@pytest.mark.parametrize("token, skeleton", [("industries", "intstrs"), ("imdastris", "intstrs"), ("kheti", "kt"), ("yyz", "is"), ("221", "221"), ("", "")])
def test_skeleton(spark, token, skeleton):
    assert one(spark, t=token).select(text.skeleton(F.col("t"))).first()[0] == skeleton


@pytest.mark.parametrize("raw, expected", [
    ("M/s. ABC Pvt. Ltd.", dict(n_full="abc pvt ltd", n_core="abc", n_skel="abk", n_alias=False)),
    ("Foo LLC d/b/a Bar Inc", dict(n_full="foo llc bar inc", n_core="foo bar", n_alt_a="foo", n_alt_b="bar", n_alias=True)),
    ("maamedia.com", dict(n_core="maamedia", n_domain=True)),
    ("A.B.C. Industries", dict(n_core="abc ind")),
    ("", dict(n_full="", n_core="", n_concat="", n_translit=False)),
    (None, dict(n_full="", n_domain=False)),
])
def test_name_forms(spark, raw, expected):
    rows = spark.createDataFrame([(raw,)], "business_name string")
    got = normalise.with_name_forms(rows).first().asDict()
    assert {k: got[k] for k in expected} == expected


@pytest.mark.parametrize("raw, country, expected", [
    ("304, 3Rd Floor, Plot No. 1 Rg Complex, Rohini Sector-8, Delhi", "India", dict(a_full="304 3 1 rg complex rohini sector 8 delhi", a_nums="304 3 1 8", a_alpha="rohini", a_skel="rn", a_state="delhi", a_ncomp=5)),
    ("12 Maple St, New York, NY 10001", "US", dict(a_full="12 maple street ny ny 10001", a_state="ny", a_nums="12 10001", a_alpha="maple")),
    ("n/a", "US", dict(a_empty=True, a_full="")),
    ("Near City Mall, Pune", "IN", dict(a_core="pune", a_ncomp=2)),
    ("महाराष्ट्र", "India", dict(a_translit=True, a_empty=False)),
    (None, None, dict(a_empty=True, a_ncomp=0)),
])
def test_address_forms(spark, raw, country, expected):
    row = spark.createDataFrame([(raw, country)], "business_address string, country string")
    got = normalise.with_address_forms(row).first().asDict()
    assert {k: got[k] for k in expected} == expected


def test_transliteration():
    assert normalise.ascii_lower("Société Générale") == "societe generale"
    assert normalise.ascii_lower("भारत") == "bharat"


def test_similarities():
    assert similarity.ratio("abcd", "bcde") == 0.75
    assert similarity.partial_ratio("bcd", "abcde") == 1.0
    assert similarity.token_sort_ratio("b a", "a b") == 1.0
    assert similarity.token_set_ratio("a b", "a b c") == 1.0
    assert similarity.token_set_ratio("", "a") == 0.0
    assert round(similarity.jaro_winkler("martha", "marhta"), 6) == 0.961111
    assert similarity.lcs_length("", "abc") == 0


def test_phonetics_agree_on_a_typo():
    assert phonetics.nysiis("221") == "221" and phonetics.nysiis("") == ""
    assert phonetics.nysiis("industries") == phonetics.nysiis("industris")


def test_masks_and_house_numbers(spark):
    row = one(spark, a="भारत", b="abc é", c="12a 7 9", d="").select(text.is_non_latin(F.col("a")), text.is_non_latin(F.col("b")), text.has_native_script(F.col("a")), text.first_house_number(F.col("c")), text.first_house_number(F.col("d")), text.is_null_word(F.col("d"))).first()
    assert tuple(row) == (True, False, True, 7, -1, True)
