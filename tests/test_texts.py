"""Product texts, labels, keywords, slugs and fences."""

from pyspark.sql import functions as F

from shelfrank.functions.text import (
    any_literal,
    any_regex,
    judge_slug,
    parse_keywords,
    product_text,
    relevance_label,
    slug,
    strip_code_fences,
    ustrip,
)
from shelfrank.operators.labels import judged_table

PARTS = "ProductName string, BrandName string, Level4_ProductGroup string, ProductType string"


def texts(spark, row):
    df = spark.createDataFrame([row], PARTS)
    return df.select(*[product_text(v).alias(v) for v in ("judged", "explore", "catalog", "search", "search_safe")]).collect()[0]


def test_all_parts_null(spark):
    r = texts(spark, (None, None, None, None))
    assert r["judged"] == "" and r["catalog"] == "" and r["explore"] == "   "
    assert r["search"] == "UNKNOWN_PRODUCT" and r["search_safe"] == "UNKNOWN_PRODUCT"


def test_all_parts_empty(spark):
    r = texts(spark, ("", "", "", ""))
    assert r["search_safe"] == "   " and r["search"] == "  "


def test_variant_orders(spark):
    r = texts(spark, ("N", None, "L", "T"))
    assert r["judged"] == "N  L T"
    assert r["catalog"] == "N  T L"
    assert r["search"] == "N L"
    assert r["search_safe"] == "N T L"
    r = texts(spark, ("N", "B", None, "T"))
    assert r["search"] == "N B T"


def test_unicode_blanks_stripped(spark):
    df = spark.createDataFrame([("\t abc  ",)], "t string")
    assert df.select(ustrip("t")).collect()[0][0] == "abc"


def test_null_selects_label_zero(spark):
    df = spark.createDataFrame([(None,), (0,), (3,)], "s long")
    assert [r[0] for r in df.select(relevance_label("s")).collect()] == [0, 0, 1]


def test_judged_drops_null_queries_keeps_empty_text(spark):
    df = spark.createDataFrame(
        [(None, "de", None, None, None, None, 1, 1), ("q", "de", None, None, None, None, None, 2)],
        "OriginalQuery string, PageLanguage string, " + PARTS + ", UniqueSelects long, product_id long",
    )
    rows = judged_table(df).collect()
    assert len(rows) == 1 and rows[0]["product_text"] == "" and rows[0]["relevant"] == 0


def test_regex_vs_literal_keyword(spark):
    df = spark.createDataFrame([("abc",)], "t string")
    r = df.select(any_regex("t", ["a.c"]).alias("rx"), any_literal(["t"], ["a.c"]).alias("lit")).collect()[0]
    assert r["rx"] is True and r["lit"] is False


def test_parse_keywords():
    assert parse_keywords(" Anvil, ,bolt ,") == ["anvil", "bolt"]
    assert parse_keywords(None) == []


def test_slugs(spark):
    df = spark.createDataFrame([("black dress!",), ("!!!",), (None,)], "q string")
    r = df.select(slug("q").alias("s"), judge_slug("q").alias("j")).collect()
    assert [x["s"] for x in r] == ["blackdress", "query", "query"]
    assert r[2]["j"] == "no_query" and r[1]["j"] == ""


def test_strip_code_fences(spark):
    cases = [
        ("```json\n{\"a\":1}\n```", '{"a":1}'),
        ("  ```\n{}\n```  ", "{}"),
        ("```json {\"a\":", '```json {"a":'),
        ("plain", "plain"),
        ("```JSON\n[1]\n``` tail ```", "[1]\n``` tail"),
    ]
    df = spark.createDataFrame([(a,) for a, _ in cases], "t string")
    got = [r[0] for r in df.select(strip_code_fences("t")).collect()]
    assert got == [b for _, b in cases]


def test_require_columns_lists_all_missing(spark):
    import pytest

    from shelfrank.operators.dedup import unique_products
    from shelfrank.schema import MissingColumnsError

    df = spark.createDataFrame([("n",)], "ProductName string")
    with pytest.raises(MissingColumnsError) as e:
        unique_products(df)
    msg = str(e.value)
    for c in ("BrandName", "ProductType", "Level4_ProductGroup", "PageLanguage", "product_id"):
        assert c in msg


def test_path_and_model_name_helpers(spark):
    import os

    from shelfrank.functions.text import file_stem, parse_keywords_col, short_model_name

    paths = ["interactive_outputs/e5/blackdress.txt", "runs/model/a.b.json", "plain"]
    models = ["intfloat/multilingual-e5-base", "models" + chr(92) + "e5_finetuned/", "name"]
    df = spark.createDataFrame(list(zip(paths, models, [" Anvil, ,BOLT,", "x", ""])), "path string, model string, kws string")
    r = df.select(
        file_stem("path").alias("stem"),
        short_model_name("model").alias("m"),
        short_model_name("model", "search").alias("ms"),
        parse_keywords_col("kws").alias("k"),
    ).collect()
    assert [x["stem"] for x in r] == [os.path.splitext(os.path.basename(p))[0] for p in paths]
    assert [x["m"] for x in r] == [m.rstrip("/").split("/")[-1] for m in models]
    assert [x["ms"] for x in r] == [m.replace(chr(92), "/").split("/")[-1] for m in models]
    assert [x["k"] for x in r] == [["anvil", "bolt"], ["x"], []]
