"""Golden rows for names, units and prices."""

import pytest
from pyspark.sql import functions as F

from pricewright.functions import prices as P
from pricewright.functions import text as T


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalize_text(spark):
    given = ["  İNCİR  Kuru ", "Çiğ Köfte", None, "", "a–b ‘x’", "Café\tNoir", "čőž ½ ﬁne Ĳ", "x\u00a0y"]
    assert apply(spark, T.normalize_text, given) == ["incir kuru", "cig kofte", "", "", "a-b 'x'", "cafe noir", "coz 1⁄2 fine ij", "x y"]


def test_other_scripts_go_through_arrow(spark):
    import unicodedata

    given = ["ｆｕｌｌ ｗｉｄｔｈ", "Ελλάδα", "Çay", None, "①②", "한글"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string")
    got = [r.x for r in T.normalize_exact(df, "v", "x").orderBy("i").collect()]
    want = ["".join(c for c in unicodedata.normalize("NFKD", (v or "").lower().replace("ç", "c")) if not unicodedata.combining(c)) for v in given]
    assert got == want


def test_standardize_name(spark):
    given = ["Domates Salkım Kg", "Hıyar Kg", "Süt 1 L Tam Yağlı", "500 g", None, "Kültür Mantarı Paket 400 G", "Kestane Mantarı Kg", "Limon Taze", "İstridye Mantar 200 g", "Kuru Soğan Dökme Kg", "Makarna 5 Paket", "Elma Yeşil"]
    assert apply(spark, T.standardize_name, given) == ["domates", "salatalik", "sut tam yagli", None, None, "mantar", "kestane mantar", "limon taze", "istiridye mantar", "sogan", "makarna", "elma yesil"]


def test_unit_of_takes_the_first_kind(spark):
    got = apply(spark, T.unit_of, ["Elma 1,5 kg", "Peynir 750 g", "Su 500 ml", "Yumurta 15 adet", "Ekmek", None, "Yumurta 15'lu", "Süt 1 LT", "Un 5 KG 2 adet", "Su 1 Lt"])
    assert [(r.unit, r.quantity) if r else None for r in got] == [("KG", 1.5), ("GRAM", 750.0), ("ML", 500.0), ("PIECE", 15.0), None, None, ("PIECE", 15.0), ("LITER", 1.0), ("KG", 5.0), None]


def test_api_unit(spark):
    rows = [("Elma 2 kg", "AD", None), ("Elma", "kgm", None), ("Ceviz", "gr", 250.0), ("Ekmek", "adet", None), ("Gazoz", "kasa", None), ("Tuz", None, None)]
    df = spark.createDataFrame(rows, "n string, c string, w double")
    got = [tuple(r.x) if r.x else None for r in df.select(T.api_unit(F.col("n"), F.col("c"), F.col("w")).alias("x")).collect()]
    assert got == [("KG", 2.0), ("KG", 1.0), ("GRAM", 250.0), ("PIECE", 1.0), ("KASA", 1.0), None]


def test_weight_in(spark):
    assert apply(spark, T.weight_in, ["Elma 2 kg", "Ceviz 250 g", "Su", "Çay 1,2345 GRAM", "Un 500 gr"]) == [2.0, 0.25, None, 0.0012, None]


def test_normalize_unit(spark):
    df = spark.createDataFrame([("GRAM", 750.0), ("PIECE", None), (None, 3.0), ("ML", 500.0)], "u string, q double")
    got = [tuple(r.x) for r in df.select(P.normalize_unit(F.col("u"), F.col("q")).alias("x")).collect()]
    assert got == [("kg", 0.75), ("piece", 1.0), (None, None), ("ml", 500.0)]


def test_suspicion_and_reject_reason(spark):
    df = spark.createDataFrame([(None, "x"), (0.0, "x"), (501.0, "x"), (250.0, "çay paket"), (20.0, "x")], "p double, n string")
    assert [r.x for r in df.select(P.suspicion(F.col("p"), F.col("n")).alias("x")).collect()] == ["price_null", "price_invalid", "price_too_high", "small_package_price_too_high", None]


@pytest.mark.parametrize(("a", "b", "want"), [(1.0, 2.0, "a"), (2.0, 1.0, "b"), (1.0, 1.0, "same"), (None, 3.0, "b"), (None, None, None)])
def test_cheaper_source(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a double, b double")
    assert df.select(P.cheaper_source({"a": F.col("a"), "b": F.col("b")}).alias("x")).first().x == want
