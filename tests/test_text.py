import pytest
from pyspark.sql import functions as F

from leafscan.functions import text as t


@pytest.mark.parametrize("raw, want", [("あ…", "あ．．．"), ("a ・・b", "ａ．．ｂ"), ("x・y", "ｘ・ｙ"), ("　 \x1c ", ""), ("ｶﾞｱ｡", "ガア。"), ("", ""), (None, None)])
def test_normalised(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "r string").select(t.normalised(F.col("r"))).first()[0] == want


def test_second_pass_changes_nothing(spark):
    df = spark.createDataFrame([("a…・.b・c ﾊﾟ!",)], "r string").select(t.normalised(F.col("r")).alias("n"))
    first, second = df.select("n", t.normalised(F.col("n"))).first()
    assert first == second


def test_special_and_unknown_tokens_drop(spark):
    df = spark.createDataFrame([(["[CLS]", "a", None, "b", "[SEP]"],)], "t array<string>")
    assert df.select(t.detokenised(F.col("t"))).first()[0] == "ab"


@pytest.mark.parametrize("raw, want", [("a\nimport site\nb", "a\r\nX\r\nimport site\r\nb"), ("a\n\n", "a\r\nX\r\n\r\n"), ("a\n X \nb", "a\n X \nb"), ("a", "a\r\nX")])
def test_line_is_put_in(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "r string").select(t.with_line(F.col("r"), "X", "import site")).first()[0] == want
