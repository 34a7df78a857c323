import pytest
from pyspark.sql import functions as F

from goldweave.functions import jsontext as J
from goldweave.functions import numeric as N
from goldweave.functions import text as T

TEXTS = [
    ("  Adobe&amp;Co. <b>CS3</b> ", "adobe co cs3"),
    ("ＭＳ Office　2007", "ms office 2007"),
    ("Windows-XP (SP2) v1.5", "windows xp sp2 v1 5"),
    ("&lt;i&gt;Hidden&lt;/i&gt; tag", "hidden tag"),
    ("Café München", "café münchen"),
    ("O'Reilly_Media", "o reilly media"),
    ("5 < 6 > 4", "5 4"),
    (None, ""),
    ("", ""),
]


def test_normalize_text(spark):
    df = spark.createDataFrame([*TEXTS, ("ﬁne … caf&eacute; &copy;", "fine café ©")], "x string, want string")
    assert df.where(T.normalize_text(F.col("x")) != F.col("want")).count() == 0


def test_prices(spark):
    rows = [("$1,299.995", 1300.0), ("2.345", 2.34), ("2.355", 2.36), ("1.2.3", None), ("-5", 5.0), (".", None), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "x string, want double")
    assert df.where(~N.normalize_price(F.col("x")).eqNullSafe(F.col("want"))).count() == 0


def test_token_measures(spark):
    df = spark.createDataFrame([("quickbooks premier 2007", "quickbooks premier 2008"), ("", ""), ("a", "")], "l string, r string")
    l, r = T.tokens(F.col("l")), T.tokens(F.col("r"))
    out = df.select(T.jaccard(l, r), T.containment(l, r), T.jaccard(T.number_tokens(F.col("l")), T.number_tokens(F.col("r"))), T.exact_set(T.number_tokens(F.col("l")), T.number_tokens(F.col("r")))).collect()
    assert [tuple(x) for x in out] == [(0.5, 2 / 3, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0), (0.0, 0.0, 1.0, 1.0)]


def test_aliases_and_search_forms(spark):
    df = spark.createDataFrame([("Microsoft Corp.", "Sage Software, Inc", "Red-Widget 7")], "a string, b string, c string")
    got = df.select(T.normalize_brand(F.col("a")), T.normalize_manufacturer(F.col("b")), T.compact(F.col("c")), T.initials(F.col("c"))).first()
    assert tuple(got) == ("microsoft", "sage software", "redwidget7", "rw7")


def test_no_python_for_plain_text(spark):
    plan = spark.createDataFrame([("x",)], "x string").select(T.normalize_text(F.col("x"), ascii_only=True))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def unquoted(text):
    """By the rule, one layer after the other."""
    text = text.strip()
    while len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'":
        text = text[1:-1].strip()
    return text.replace('""', '"').strip()


def test_quotes_in_layers(spark):
    texts = ['"a"', '""a""', "'\"a b\"'", "\"a'", " \" 'x' \" ", '"', '""', "'''", 'a "" b', '"a"b"', '"""', '" "', "x", "", "'\"'", '"a" "b"', None]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r[0] for r in df.select(T.clean_quotes(F.col("x"))).collect()] == [unquoted(x or "") for x in texts]


def test_prices_and_numbers_of_prepared_tables(spark):
    df = spark.createDataFrame([("1.50", "1.5"), ("2", "2"), ("-1", ""), ("x", ""), ("1e3", "1000"), ("", "")], "x string, want string")
    assert df.where(N.clean_price(F.col("x")) != F.col("want")).count() == 0
    row = spark.createDataFrame([("NaN", "7", "x")], "a string, b string, c string").select(N.safe_float(F.col("a"), 0.5), N.safe_float(F.col("b")), N.is_number_like(F.col("c"))).first()
    assert tuple(row) == (0.5, 7.0, False)


def test_json_texts(spark):
    df = spark.createDataFrame([('{"title":"T"}', "T"), ('{"chosen_title":"C","title":"T"}', "C"), ('"q"', "q"), ("plain", "plain"), ("{bad", "{bad"), (None, "")], "x string, want string")
    assert df.where(J.chosen_title(F.col("x")) != F.col("want")).count() == 0
    one = spark.createDataFrame([('{"a.b":{"c":1}}', "{bad")], "x string, y string").select(J.json_value(F.col("x"), "a.b", "c"), J.json_value(F.col("y"), "c")).first()
    assert tuple(one) == ("1", None)
    assert J.mask_url("pg://u:pw@h/db") == "pg://u:***@h/db" and J.quote_identifier("a`b") == "`a``b`"


def test_field_names():
    assert [T.field_name(x) for x in ("table1.Title", "LTABLE_name", " right_id ", "price")] == ["Title", "name", "id", "price"]


def test_columns_that_are_normalised_together_share_a_python_worker(spark):
    from goldweave.functions.text import normalize_text

    rows = spark.createDataFrame([("ﬁne", "a&amp;b", None), ("x", "Ｙ", "z")], "a string, b string, c string")
    out = rows.select(*[normalize_text(rows[c]).alias(c) for c in rows.columns])
    assert [tuple(r) for r in out.collect()] == [("fine", "a b", ""), ("x", "y", "z")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("EvalPython") == 1
