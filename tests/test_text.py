import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnwise.functions import fixed, text

pytestmark = pytest.mark.usefixtures("spark")

ALL_BUT_SURROGATES = [chr(i) for i in range(0x11000) if not 0xD800 <= i < 0xE000]


def test_whitespace_is_pythons(column):
    assert sorted(fixed.WHITESPACE) == sorted(c for c in ALL_BUT_SURROGATES if c.isspace())
    assert column(ALL_BUT_SURROGATES, text.has_text) == [c.strip() != "" for c in ALL_BUT_SURROGATES]
    assert column(ALL_BUT_SURROGATES, text.strip) == [c.strip() for c in ALL_BUT_SURROGATES]
    between = [f"a{c}b" for c in ALL_BUT_SURROGATES]
    assert column(between, text.n_tokens) == [len(s.split()) for s in between]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t\xa0　\x1cé", max_size=40), min_size=40, max_size=40))
def test_tokens_strip_and_tail_agree_with_python(texts):
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    df = SparkSession.getActiveSession().createDataFrame(list(enumerate(texts)), "i int, x string")
    x = F.col("x")
    got = df.select("x", text.tokens(x), text.strip(x), text.tail_tokens(x, 2), text.capitalize(x)).collect()
    for x, tokens, stripped, tail, capital in got:
        assert tokens == x.split()
        assert stripped == x.strip()
        assert tail == (x if len(x.split()) <= 2 else " ".join(x.split()[-2:]))
        assert capital == x.capitalize()


def test_tail_keeps_a_short_text_as_it_is(column):
    assert column(["a b\n\nc", ""], lambda x: text.tail_tokens(x, 3)) == ["a b\n\nc", ""]
    assert column(["a b\n\nc", ""], lambda x: text.tail_tokens(x, 2)) == ["b c", ""]
    with pytest.raises(ValueError):
        text.tail_tokens(None, 0)


def test_words(column):
    assert column(["The Café's 2nd don't -- it's", "…", ""], text.words) == [
        ["the", "caf", "s", "2nd", "don't", "it's"],
        [],
        [],
    ]
    assert column(["A", "…", ""], text.has_words) == [True, False, False]


def test_rounding_is_pythons(spark):
    from pyspark.sql import functions as F

    from turnwise.functions.numbers import round_half_even

    pairs = spark.range(1, 300).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(1), "id")).alias("k"))
    rows = pairs.select("k", "n", round_half_even(F.col("k") / F.col("n"), 4).alias("r")).collect()
    assert all(round(r.k / r.n, 4) == r.r for r in rows)
    big = spark.range(1).select(round_half_even(F.lit(12345.67891), 4).alias("r")).first()
    assert big.r == 12345.6789
