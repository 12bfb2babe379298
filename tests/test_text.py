from pyspark.sql import functions as F

from paperlake.functions import text as tx
from paperlake.functions.vocab import LIFE_SCIENCE_STEMS, STOP_WORDS


def apply(spark, values, *columns):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *[c(F.col("t")) for c in columns]).orderBy("i").collect()]


KEYWORDS = {
    "": [],
    "the of": [],
    "  A  study of GENE  ": ["study", "gene"],
    "gene Gene a1 x 42": ["gene", "gene", "a1", "42"],
    "étude naïve Zell-Kern": ["tude", "na", "ve", "zell", "kern"],
    "PAPERS recent,learning(42": ["learning", "42"],
    "x1\tx\nx2\u3000x3": ["x1", "x2", "x3"],
    "deep_nets it's": ["deep", "nets"],
}
#: text: stripped, collapsed, words
SPACES = {
    "": ("", "", []),
    " \t\x1d\u3000": ("", "", []),
    "  a  b ": ("a  b", "a b", ["a", "b"]),
    "\x1ca\x85b\u2028c\xa0": ("a\x85b\u2028c", "a b c", ["a", "b", "c"]),
    "one\r\n\ttwo, three": ("one\r\n\ttwo, three", "one two, three", ["one", "two,", "three"]),
    "\u200bzero width stays": ("\u200bzero width stays", "\u200bzero width stays", ["\u200bzero", "width", "stays"]),
}


def test_keywords(spark):
    assert apply(spark, KEYWORDS, tx.keywords) == [(w,) for w in KEYWORDS.values()]


def test_white_space(spark):
    assert apply(spark, SPACES, tx.strip, tx.collapse, tx.split_words) == list(SPACES.values())


def test_filter_words_fall_back(spark):
    got = apply(spark, ["the über ça", "gene of", "a b", ""], tx.filter_words)
    # "über" leaves the keyword "ber"; only text without any keyword falls back
    assert got[0] == (["ber"],)
    assert got[1:] == [(["gene"],), ([],), ([],)]
    assert apply(spark, ["the of THAT à"], tx.filter_words) == [(["the", "that"],)]


EXPANDED = {
    "transformer architectures for medical image segmentation tasks today now": [
        "transformer architectures medical image", "transformer architectures medical recent",
        "architectures medical image segmentation"],
    "the of a an": ["", " recent", ""],
    "graph": ["graph", "graph recent", ""],
    "deep nets of cats": ["deep nets cats", "deep nets cats recent", "nets cats"],
    "\tGENE  drift\u3000in wild mice\n": ["GENE drift wild mice", "GENE drift wild recent", "drift wild mice"],
}


def test_query_expansion(spark):
    assert apply(spark, EXPANDED, tx.expand_queries) == [(q,) for q in EXPANDED.values()]


def test_topic_flag(spark):
    texts = ["Eugenes Fund", "a drugstore", "plain words", "NEUROnal", "", "cel l"]
    assert apply(spark, texts, tx.is_life_science) == [(True,), (True,), (False,), (True,), (False,), (False,)]


def test_dates_keys_and_dois(spark):
    assert apply(spark, ["2024-01-02T00:00:00Z", "2024", ""], tx.date_prefix) == [
        ("2024-01-02",), ("2024",), ("",)]
    assert apply(spark, [" Published-Date ", "A b"], tx.key_name) == [("published_date",), ("a_b",)]
    assert apply(spark, ["https://doi.org/10.1/AB", "10.1/ab", "http://a.b/1"], tx.doi_norm) == [
        ("10.1/ab",), ("10.1/ab",), ("",)]
    assert apply(spark, ["abcdef"], lambda c: tx.text_window(c, 4), lambda c: tx.text_window(c, None)) == [
        ("abcd", "abcdef")]


def test_word_lists():
    assert len(LIFE_SCIENCE_STEMS) == len(set(LIFE_SCIENCE_STEMS)) == 44
    assert len(STOP_WORDS) == len(set(STOP_WORDS))
    assert {"a", "recent", "papers", "use"} <= set(STOP_WORDS)
