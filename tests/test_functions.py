import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from colsift.functions import quantiles as Q
from colsift.functions import text as X
from colsift.functions.measures import four_bands, half_even_sql, pct, preview


def test_percentages_equal_float_rounding(spark):
    rng = random.Random(7)
    cases = [(rng.randint(0, d), d) for d in (rng.choice([7, 32, 208, 20_000, 15_600, 2_000_000]) for _ in range(4000))]
    cases += [(n, 20_000) for n in range(1, 400)] + [(1, 0), (1, 32)]
    df = spark.createDataFrame(cases, "n long, d long").select("n", "d", pct("n", "d").alias("p"))
    for r in df.collect():
        assert r.p == (round(r.n / r.d * 100.0, 2) if r.d else 0.0), r


def test_half_even_on_arbitrary_doubles(spark):
    rng = random.Random(3)
    values = [rng.uniform(0, 100) for _ in range(3000)] + [k / 1000 for k in range(0, 3000, 5)]
    for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", F.expr(half_even_sql("v", 2)).alias("r")).collect():
        assert r.r == round(r.v, 2)


def test_a_tiny_share_is_low_not_pass(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.0), (5, 5.0), (6, 5.01), (21, 20.5), (50, 41.0)], "n long, p double")
    got = [r[0] for r in df.select(four_bands(F.col("n"), F.col("p"), (5, 20, 40))).collect()]
    assert got == ["PASS", "LOW", "LOW", "MEDIUM", "HIGH", "CRITICAL"]


def test_preview(spark):
    got = spark.createDataFrame([("x" * 100,), ("y" * 101,), (None,)], "v string").select(preview(F.col("v"))).collect()
    assert [r[0] for r in got] == ["x" * 100, "y" * 97 + "...", None]


TEXTS = ["", " ", "Gold", "  gold\t ", "GOLD", "a b", "a  b", "\x1cx\x1f", "Straße", "STRASSE", "ΟΔΟΣ", "οδος", "ὀδός", "ıI",
         "n m", "É", "é", "\u0085q"]


def test_normalization_equals_unicode_rules(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", X.strip(F.col("t")).alias("s"), X.collapse(F.col("t")).alias("c"), X.category_key(F.col("t")).alias("k")).collect():
        assert r.s == r.t.strip()
        assert r.c == re.sub(r"\s+", " ", r.t.strip())
        assert r.k == re.sub(r"\s+", " ", r.t.strip()).casefold(), ascii(r.t)


@pytest.mark.parametrize("text, number, label", [
    ("1", True, None), ("-1.5e3", True, None), (".5", True, None), ("5.", True, None), ("inf", True, None), ("-Infinity", True, None),
    ("1d", False, None), ("nan", False, None), ("1e400", False, None), ("1,5", False, None), ("0x1", False, None),
    ("2024-01-02", False, "YYYY-MM-DD"), ("2024/01/02", False, "YYYY/MM/DD"), ("1/2/2024", False, "SLASH_DATE"),
    ("Jan 2, 2024", False, "MON_DD_YYYY"), ("2 January 2024", False, "DD_MON_YYYY"), ("2024-01-02 10:00", False, "ISO_DATETIME"),
    ("2024-01-02T10:00", False, "ISO_DATETIME"), ("2024-01-02 10:00:00", False, None), ("2024-99-99", False, "YYYY-MM-DD")])
def test_patterns(spark, text, number, label):
    row = spark.createDataFrame([(text,)], "t string").select(X.is_number(F.col("t")), X.date_label(F.col("t"))).first()
    assert tuple(row) == (number, label)


@pytest.mark.parametrize("name, hint", [("customer_id", True), ("Unnamed: 0", True), ("c_custkey", False), ("ORDER-KEY", True),
                                        ("zip code", True), ("idea", False), ("uuid4", False)])
def test_identifier_names(name, hint):
    assert X.has_identifier_name(name) is hint


@pytest.mark.parametrize("name, yes", [("Unnamed: 3", True), ("unnamed", True), (" UNNAMED 1", True), ("unnamed_1", False), ("name", False)])
def test_unnamed(name, yes):
    assert X.is_unnamed(name) is yes


def test_tokens_tell_short_from_long(spark):
    long = "word " * 40
    df = spark.createDataFrame([("a",), ("b" * 64,), (long,), (long + "!",), ("\x00" + "0" * 32,)], "t string")
    tokens = [r[0] for r in df.select(X.token(F.col("t"))).collect()]
    assert tokens[:2] == ["a", "b" * 64] and len(set(tokens)) == 5
    assert all(len(t) == 33 and t.startswith("\x00") for t in tokens[2:])


@pytest.mark.parametrize("kind", ["uniform", "hot", "heavy", "few", "wide", "close", "zeros"])
def test_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(5)
    n = 5001
    data = {"uniform": rng.uniform(-5, 5, n), "heavy": rng.standard_cauchy(n) * 1e6, "few": rng.integers(0, 4, n).astype(float),
            "hot": np.where(rng.uniform(size=n) < 0.4, 3.25, rng.normal(size=n)),
            "wide": np.exp2(rng.uniform(-1074, 1000, n)) * rng.choice([-1, 1], n), "close": 1.0 + rng.integers(0, 900, n) * 2.0**-52,
            "zeros": rng.choice([-0.0, 0.0, 5e-324, -5e-324], n)}[kind]
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(data)], "v double, i long").repartition(7, "i")
    got = Q.quantiles(df, {"v": F.col("v")}, {"v": n}, (0.25, 0.5, 0.75))
    assert got["v"] == [float(np.quantile(data, p)) for p in (0.25, 0.5, 0.75)]
    ranks = [0, 7, 2500, 4999, n - 1]
    assert Q.ranked(df, {"v": F.col("v")}, {"v": ranks}) == {("v", r): float(np.sort(data)[r]) for r in ranks}


def test_ranks_of_several_columns(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert Q.ranked(df, {"v": F.col("v"), "w": -F.col("v")}, {"v": [0, 500], "w": [0]}) == {("v", 0): 0.0, ("v", 500): 500.0, ("w", 0): -999.0}
    assert Q.ranked(df, {}, {}) == {}


def test_plain_texts_need_no_normalization(spark):
    texts = ["", "a", "Ref-1", "a b", " a", "a\t", "\x00a", "\x7f", "é", "ß", "İ", "a ", "~!", "12.5e3", "a\n", " "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = df.select("t", X.is_plain(t).alias("plain"), X.strip(t).alias("s"), X.collapse(t).alias("p"), X.category_key(t).alias("k"), F.lower(t).alias("low")).collect()
    assert [r["t"] for r in got if r["plain"]] == ["", "a", "Ref-1", "~!", "12.5e3"]
    assert all(r["s"] == r["p"] == r["t"] and r["k"] == r["low"] for r in got if r["plain"])
