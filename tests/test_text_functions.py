import urllib.parse

from pyspark.sql import functions as F

from textcluster.functions import text as tx


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(expr(F.col("v")).alias("r")).first()["r"]


def test_tokenize_lower_and_two_char_words(spark):
    got = one(spark, tx.tokenize, "A bb Ça va? x_y 12 é")
    assert got == ["bb", "ça", "va", "x_y", "12"]


def test_tokenize_null_is_empty(spark):
    assert one(spark, tx.tokenize, None) == []


def test_remove_words_keeps_order(spark):
    df = spark.createDataFrame([(["the", "cat", "and", "dog"],)], "t array<string>")
    assert df.select(tx.remove_words(F.col("t"), ["the", "and"]).alias("r")).first()["r"] == ["cat", "dog"]


def test_extract_id_needs_eight_digits(spark):
    assert one(spark, tx.extract_id, "PMID: 28111111  [Indexed]") == "28111111"
    assert one(spark, tx.extract_id, "PMID:   2811111 x") is None
    assert one(spark, tx.extract_id, "no id") is None


def test_url_quote_matches_python_quote(spark):
    for s in ["10000000 10000002", "a~b*c/d+e&f", "é ü"]:
        assert one(spark, tx.url_quote, s) == urllib.parse.quote(s)


def test_element_at_index_negative_and_out_of_range(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "a array<string>")
    row = df.select(
        tx.element_at_index(F.col("a"), 0).alias("first"),
        tx.element_at_index(F.col("a"), -2).alias("second_last"),
        tx.element_at_index(F.col("a"), 5).alias("none"),
    ).first()
    assert (row["first"], row["second_last"], row["none"]) == ("a", "b", None)


def test_collapse_blank_lines_runs_of_two_and_three(spark):
    rec = "\n\n1. J Foo.\n\nTitle\nline two\n\n\nAbs\n\n\n\nPMID: 12345678\n"
    got = one(spark, lambda c: tx.collapse_blank_lines(c, "|"), rec)
    assert got == "1. J Foo.|Title line two|Abs|PMID: 12345678"


def test_last_path_component_and_extension(spark):
    assert one(spark, tx.last_path_component, "C:\\data\\10000001") == "10000001"
    assert one(spark, lambda c: tx.has_extension(c), "A.XML", "string") is True
    assert one(spark, lambda c: tx.has_extension(c), "a.json", "string") is False


def test_collapse_ws(spark):
    assert one(spark, tx.collapse_ws, "  a \t b\r\n c  ") == "a b c"


def test_id_line_prefix(spark):
    assert one(spark, tx.starts_with_id_line, "PMID: 28111111") is True
    assert one(spark, tx.starts_with_id_line, " PMID: 28111111") is False
