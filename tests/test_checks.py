import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from colsift import AuditError, CheckConfig, TableProfile
from colsift.operators import checks as C
from colsift.operators.duplicates import _upto, duplicates, repeated_rows
from colsift.operators.overview import dataset_overview


def by_column(df):
    return {r["column"]: r.asDict() for r in df.collect()}


def test_missing_edges(spark):
    counts = dict(none=0, low=5, medium=20, high=40, critical=41)
    data = [tuple(None if i < n else float(i) for n in counts.values()) for i in range(100)]
    df = spark.createDataFrame(data, ", ".join(f"{k} double" for k in counts))
    got = by_column(C.missing_values(TableProfile(df)))
    assert {k: got[k]["severity"] for k in counts} == dict(none="PASS", low="LOW", medium="MEDIUM", high="HIGH", critical="CRITICAL")
    assert got["low"]["missing_percentage"] == 5.0 and got["none"]["status"] == "PASS"
    assert len(C.missing_values(TableProfile(df), include_complete=False).collect()) == 4


def test_nan_is_missing_and_infinity_is_not(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (1.0,)], "x double")
    assert by_column(C.missing_values(TableProfile(df)))["x"]["missing_count"] == 2


def test_constant(spark):
    df = spark.createDataFrame([(None, "x", 1, "y" * 150, 2.0), (None, "x", 2, "y" * 150, float("nan")), (None, None, 3, None, 2.0)],
                               "gone string, same string, varied int, long string, num double")
    got = by_column(C.constant_columns(TableProfile(df)))
    assert {k: (v["status"], v["severity"]) for k, v in got.items()} == {
        "gone": ("ALL_MISSING", "CRITICAL"), "same": ("CONSTANT", "HIGH"), "long": ("CONSTANT", "HIGH"), "num": ("CONSTANT", "HIGH")}
    assert got["same"]["constant_value"] == "x" and got["same"]["missing_count"] == 1
    assert got["long"]["constant_value"] == "y" * 97 + "..." and got["num"]["constant_value"] == "2.0"


def test_near_constant(spark):
    data = [("x", "x" if i else "y", "a" if i % 2 else "b", 7 if i else 8, i > 0, float("inf") if i else 1.0, 2**60 + (i == 0))
            for i in range(100)]
    df = spark.createDataFrame(data, "same string, near string, half string, num int, flag boolean, far double, big long")
    got = by_column(C.near_constant_columns(TableProfile(df)))
    assert set(got) == {"near", "num", "flag", "far", "big"}
    assert all(v["severity"] == "HIGH" and v["dominant_count"] == 99 and v["unique_non_null"] == 2 for v in got.values())
    assert got["near"]["dominant_value"] == "x" and got["num"]["dominant_value"] == "7" and got["big"]["dominant_value"] == str(2**60)


def test_near_constant_low_thresholds_count_every_value(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 1, 1, 2, 2, 3])], "i int, v int")
    cfg = CheckConfig(near_constant_share=40, near_constant_high_share=60)
    got = by_column(C.near_constant_columns(TableProfile(df, order_by="i", config=cfg)))
    assert (got["v"]["dominant_value"], got["v"]["dominant_count"], got["v"]["severity"]) == ("1", 3, "MEDIUM")


def test_near_constant_dates_and_long_text(spark):
    data = [("z" * 200 if i else "short", i > 0) for i in range(100)]
    df = spark.createDataFrame(data, "t string, b boolean").select(
        "t", F.when(F.col("b"), F.lit("2020-01-01").cast("date")).otherwise(F.lit("2024-01-01").cast("date")).alias("d"),
        F.when(F.col("b"), F.lit("2020-01-01 10:00:00").cast("timestamp_ntz")).otherwise(F.lit("2024-01-01").cast("timestamp_ntz")).alias("s"))
    got = by_column(C.near_constant_columns(TableProfile(df)))
    assert got["t"]["dominant_value"] == "z" * 97 + "..."
    assert got["d"]["dominant_value"] == "2020-01-01" and got["s"]["dominant_value"] == "2020-01-01 10:00:00"


def test_identifiers_need_a_name_or_text(spark):
    df = spark.createDataFrame([(i, i, f"n{i}", i % 50) for i in range(100)], "measurement int, record_id int, label string, half_code int")
    got = by_column(C.potential_identifiers(TableProfile(df)))
    assert {k: (v["severity"], v["detection_reason"]) for k, v in got.items()} == {
        "record_id": ("HIGH", "IDENTIFIER_NAME_PATTERN"), "label": ("MEDIUM", "HIGH_UNIQUENESS_CATEGORICAL")}


@pytest.mark.parametrize("share", [99.0, 95.0, 60.0, 40.0, 20.0, 8.0])
@pytest.mark.parametrize("order", [None, "id"])
def test_frequent_texts_equal_grouped_ones(spark, share, order):
    rng = random.Random(int(share))
    long = "word " * 40
    def value(kind, i):
        r = rng.random() * 100
        return {"heavy": "x" if r < 96 else f"v{i}", "half": "a" if r < 45 else "b" if r < 90 else f"v{i % 50}", "tied": "pq"[i % 2], "unique": f"u{i}", "long": long if r < 97 else long + str(i),
                "holes": None if i % 3 else ("é" if r < 98 else f"{i}"), "few": str(i % 11), "one": "same", "late": "z" if i > 150 else f"w{i}"}[kind]
    kinds = ["heavy", "half", "tied", "unique", "long", "holes", "few", "one", "late"]
    df = spark.createDataFrame([(i, *(value(k, i) for k in kinds)) for i in range(3000)], "id int, " + ", ".join(f"{k} string" for k in kinds)).repartition(23)
    config = CheckConfig(near_constant_share=share, near_constant_high_share=99.5)
    fast, grouped = TableProfile(df, config=config, order_by=order), TableProfile(df, config=config, order_by=order, reuse=True)
    rows = lambda p: sorted(map(str, C.near_constant_columns(p).collect()))
    assert rows(fast) == rows(grouped) and not fast._grouped
    assert (share > 50) == ("tied" not in by_column(C.near_constant_columns(fast)))


def test_sketches_rule_out_exact_distinct_counts(spark):
    shares = {"user_id": 25, "order_key": 60, "row_id": 100, "item_code": 79, "part_key": 81, "index": 80}
    n = 4000
    df = spark.range(n).select(*[((F.col("id") * 7919) % int(n * s / 100)).alias(c) for c, s in shares.items()])
    p = TableProfile(df)
    got = by_column(C.potential_identifiers(p))
    assert {c: v["unique_non_null"] for c, v in got.items()} == {c: n * s // 100 for c, s in shares.items() if s >= 80}
    by_ref = {c.ref: c.name for c in p.columns}
    # the value range alone settles these; sketches settle wide ones
    wide = TableProfile(df.select(*[(F.col(c) * 10**12).alias(c) for c in shares]))
    assert {c: v["unique_non_null"] for c, v in by_column(C.potential_identifiers(wide)).items()} == {c: v["unique_non_null"] for c, v in got.items()}
    assert {by_ref[r] for r in wide._distinct} == {"row_id", "item_code", "part_key", "index"}
    plan = wide.frame.agg(*[F.count_distinct(r) for r in wide._distinct])._jdf.queryExecution().optimizedPlan().toString()
    assert max(map(int, re.findall(r"gid#\d+ = (\d+)", plan))) == 4  # a row is copied once for each of these only


def test_sketched_quartiles_stay_within_their_rank_error(spark):
    from colsift.functions import quantiles as Q
    rng = random.Random(4)
    data = [(rng.gauss(0, 1), float(rng.randrange(5)), float("inf") if i % 50 == 0 else rng.random() ** 8, None if i % 3 else 7.5) for i in range(20000)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double").repartition(16)
    for size in (64, 1024):
        p = TableProfile(df, config=CheckConfig(approx_quartiles=size))
        for c, (q1, q3) in {c: p.sketched_quartiles[c.ref] for c in p.columns}.items():
            values = sorted(r[c.position] for r in data if r[c.position] is not None and math.isfinite(r[c.position]))
            for share, q in ((0.25, q1), (0.75, q3)):
                below, upto = sum(v < q for v in values) / len(values), sum(v <= q for v in values) / len(values)
                assert below - Q.rank_error(size) <= share <= upto + Q.rank_error(size)
        found = by_column(C.numeric_outliers(p))
        assert {v["method"] for v in found.values()} == {"IQR_APPROX"} and found["c"]["infinite_count"] == 400 and "quartiles" not in p.__dict__
        for c, v in found.items():
            values = [r["abcd".index(c)] for r in data]
            outside = lambda slack: sum(x is not None and not v["lower_bound"] - slack <= x <= v["upper_bound"] + slack for x in values)
            assert outside(1e-3) <= v["outlier_count"] <= outside(-1e-3)  # bounds are shown rounded
    with pytest.raises(ValueError):
        CheckConfig(approx_quartiles=4)


def test_cardinality_is_configurable(spark):
    df = spark.createDataFrame([(f"group-{i % 10}",) for i in range(100)], "category string")
    assert not C.high_cardinality_categories(TableProfile(df)).collect()
    cfg = CheckConfig(cardinality_count=10, cardinality_share=10.0)
    assert by_column(C.high_cardinality_categories(TableProfile(df, config=cfg)))["category"]["unique_percentage"] == 10.0


def test_outliers(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 100, -90, 80])], "i int, v double")
    got = by_column(C.numeric_outliers(TableProfile(df.select("v", "i"), order_by="i")))
    assert got["v"]["example_outlier_values"] == [100.0, -90.0, 80.0] and got["v"]["outlier_count"] == 3
    assert (got["v"]["q1"], got["v"]["q3"]) == (1.75, 23.75)
    clean = spark.createDataFrame([(float(i), "abcde"[i - 1]) for i in range(1, 6)], "clean double, label string")
    assert not C.numeric_outliers(TableProfile(clean)).collect()
    kept = by_column(C.numeric_outliers(TableProfile(clean), include_clean=True))
    assert kept["clean"]["status"] == "PASS" and (kept["clean"]["q1"], kept["clean"]["q3"]) == (2.0, 4.0)


def test_outlier_examples_follow_row_order(spark):
    values = [5.0] * 30 + [900.0, -800.0, 700.0, 600.0, 500.0, 400.0]
    values = values[:10] + values[30:] + values[10:30]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").repartition(5)
    got = by_column(C.numeric_outliers(TableProfile(df, row_id="i")))["v"]
    assert got["example_outlier_values"] == [900.0, -800.0, 700.0, 600.0, 500.0] and got["outlier_count"] == 6


def test_infinities_are_outliers(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0, inf), (2.0, -inf), (3.0, inf), (inf, None)], "some double, only double")
    got = by_column(C.numeric_outliers(TableProfile(df)))
    assert got["some"]["outlier_count"] == 1 and got["some"]["maximum_outlier"] == inf and got["some"]["finite_count"] == 3
    assert got["only"]["outlier_count"] == 3 and got["only"]["q1"] is None and got["only"]["severity"] == "CRITICAL"


def brute_categories(values):
    groups = defaultdict(Counter)
    for v in values:
        key = re.sub(r"\s+", " ", v.strip()).casefold()
        if key:
            groups[key][v] += 1
    out = {}
    for key, counts in groups.items():
        if len(counts) > 1:
            plain = {re.sub(r"\s+", " ", v.strip()) for v in counts}
            listed = sorted(counts, key=lambda v: (-counts[v], v.casefold(), v))[:10]
            out[key] = (len(counts), listed, sum(counts.values()), any(v not in plain for v in counts), len(plain) > 1)
    return out


def test_categories_equal_brute_force_with_long_texts(spark):
    rng = random.Random(11)
    words = ["Gold", "Straße", "jakarta city", "x" * 70, "lorem ipsum dolor " * 12, "", " ", "ΟΔΟΣ", "é" * 64]
    def vary(w):
        w = rng.choice([w, w.upper(), w.lower(), w.swapcase()])
        return rng.choice(["", " ", " "]) + w.replace(" ", rng.choice([" ", "  ", "\t"])) + rng.choice(["", " " * 50])
    values = [vary(rng.choice(words)) for _ in range(3000)]
    df = spark.createDataFrame([(v, "k") for v in values], "t string, u string").repartition(6)
    got = C.category_consistency(TableProfile(df)).collect()
    brute = brute_categories(values)
    assert {r.normalized_value for r in got} == set(brute)
    for r in got:
        count, listed, affected, spaced, cased = brute[r.normalized_value]
        shown = [v if len(v) <= 100 else v[:97] + "..." for v in listed]
        assert (r.variant_count, r.variants, r.affected_count, r.whitespace_variant_detected, r.case_variant_detected) == (
            count, shown, affected, spaced, cased)
        assert r.variant_frequencies == {v: values.count(v) for v in listed}


def test_whitespace_only_variant(spark):
    df = spark.createDataFrame([("Gold",), (" Gold ",), ("Gold",)], "t string")
    r = C.category_consistency(TableProfile(df)).first()
    assert r.whitespace_variant_detected and not r.case_variant_detected and r.severity == "HIGH" and r.variants == ["Gold", " Gold "]


def test_no_type_warning_for_native_types(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n long, s string").withColumn("t", F.lit("2024-01-01").cast("timestamp"))
    assert not C.data_type_warnings(TableProfile(df)).collect()


def test_numeric_text_threshold(spark):
    df = spark.createDataFrame([("1",), ("2",), ("3",), ("bad",), ("bad",)], "t string")
    assert not C.data_type_warnings(TableProfile(df)).collect()
    r = C.data_type_warnings(TableProfile(df, config=CheckConfig(numeric_text_share=60.0))).first()
    assert (r.status, r.invalid_count, r.example_invalid_values, r.parse_success_percentage) == ("NUMERIC_LIKE_TEXT", 2, ["bad"], 60.0)


def test_type_examples_are_distinct_stripped_and_in_row_order(spark):
    bad = ["zeta", " alpha ", "zeta", "alpha", "omega " + "o" * 90, "beta", "gamma", "delta"]
    values = [str(i) for i in range(100)] + bad
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string").repartition(4)
    r = C.data_type_warnings(TableProfile(df, row_id="i")).first()
    assert r.example_invalid_values == ["zeta", "alpha", "omega " + "o" * 90, "beta", "gamma"]
    assert r.invalid_count == 8 and r.severity == "MEDIUM"


def test_date_statuses(spark):
    data = [(f"2024-01-{i:02d}", f"2024-01-{i:02d}" if i % 2 else f"1/{i}/2024", str(i)) for i in range(1, 29)]
    df = spark.createDataFrame(data, "one string, two string, three string")
    got = by_column(C.data_type_warnings(TableProfile(df)))
    assert (got["one"]["status"], got["one"]["severity"]) == ("DATETIME_LIKE_TEXT", "LOW")
    assert (got["two"]["status"], got["two"]["severity"]) == ("MIXED_DATETIME_FORMATS", "HIGH")
    assert got["two"]["detected_formats"] == ["SLASH_DATE", "YYYY-MM-DD"] and got["three"]["status"] == "NUMERIC_LIKE_TEXT"


@pytest.fixture
def copies(spark):
    nan = float("nan")
    data = [(1, "a", nan), (1, "a", nan), (2, None, 0.0), (2, None, -0.0), (3, "c", 1.0), (1, "a", None), (4, "d", 2.0)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i long, a int, b string, c double").repartition(4)


@pytest.mark.parametrize("hash_first", [True, False])
def test_duplicates(copies, hash_first):
    r = duplicates(TableProfile(copies, row_id="i"), hash_first=hash_first).first()
    assert (r.duplicate_rows, r.rows_in_duplicate_groups, r.duplicate_group_count) == (3, 5, 2)
    assert r.example_duplicate_indices == ["1", "3", "5"] and r.severity == "CRITICAL"


@pytest.mark.parametrize("hash_first", [True, False])
def test_hot_duplicates_keep_every_copy(spark, hash_first):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.lit("x").alias("s"))
    p = TableProfile(df, order_by="k")
    r = duplicates(p, hash_first=hash_first).first()
    assert (r.duplicate_rows, r.duplicate_group_count, r.example_duplicate_indices) == (999, 1, ["-1"] * 10)
    assert repeated_rows(p, hash_first).first()["n"] == 1000


def test_duplicates_of_nested_cells(spark):
    df = spark.sql("SELECT map('a', 1) m, array(1, 2) l, named_struct('x', 1) s FROM range(3)")
    p = TableProfile(df)
    assert duplicates(p).first()["duplicate_rows"] == 2
    assert dataset_overview(p).first()["other_columns"] == ["m", "l", "s"]
    assert not C.constant_columns(p).collect()


def test_overview(spark):
    df = spark.sql("SELECT 1 a, 'x' b, true c, DATE'2024-01-01' d, CAST(NULL AS DOUBLE) e, CAST(1 AS DECIMAL(5,2)) f")
    r = dataset_overview(TableProfile(df)).first()
    assert (r.row_count, r.column_count, r.total_cells, r.missing_cells, r.missing_percentage) == (1, 6, 6, 1, 16.67)
    assert r.numeric_columns == ["a", "e", "f"] and r.boolean_columns == ["c"] and r.datetime_columns == ["d"]


def test_bad_tables(spark):
    with pytest.raises(AuditError) as e:
        TableProfile(spark.createDataFrame([], "a int, b int")).counts
    assert e.value.code == "no_rows"
    with pytest.raises(AuditError) as e:
        TableProfile(spark.createDataFrame([(1, 2)], "a int, ` A` int"))
    assert e.value.code == "duplicate_columns"


@pytest.mark.parametrize("bad", [dict(missing_bands=(5, 4, 40)), dict(near_constant_share=101.0), dict(iqr_multiplier=0),
                                 dict(near_constant_share=99.5), dict(cardinality_count=1), dict(mixed_date_formats=1)])
def test_config_is_checked(bad):
    with pytest.raises(ValueError):
        CheckConfig(**bad)


def test_wide_table_in_slices(spark):
    df = spark.range(50).select(*[(F.col("id") * i if i % 2 else F.concat(F.lit(f"v{i}-"), F.col("id"))).alias(f"col {i}.x") for i in range(190)])
    got = by_column(C.missing_values(TableProfile(df)))
    assert len(got) == 190 and all(r["non_missing_count"] == 50 for r in got.values())
    assert math.isclose(len(C.potential_identifiers(TableProfile(df)).collect()), 95)


def test_collated_text_is_compared_by_its_bytes(spark):
    df = spark.sql("SELECT collate(v, 'UTF8_LCASE') AS v, 'k' AS k FROM VALUES ('Gold'), ('GOLD'), ('gold ') AS t(v)")
    p = TableProfile(df)
    assert C.category_consistency(p).first()["variant_count"] == 3
    assert duplicates(p).first()["duplicate_rows"] == 0 and not by_column(C.constant_columns(p)).get("v")


def test_rows_without_an_order_key_still_count_once(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (None, "b")], "i long, v string")
    r = duplicates(TableProfile(df, row_id="i")).first()
    assert r.duplicate_rows == 2 and len(r.example_duplicate_indices) == 2


@pytest.mark.parametrize("key", ["int", "string", "date", "double"])
def test_duplicate_examples_look_at_the_first_keys_only(spark, key):
    rng = random.Random(11)
    # pairs all over the table, a hot group, rows without a key
    data = [(i, i // 2 if i % 4 < 2 else -i) for i in range(4000)] + [(rng.randrange(4000), 7_000_000) for _ in range(300)] + [(None, 8_000_000)] * 3
    as_key = {"int": "k", "string": "lpad(k, 5, '0')", "date": "date_add(date'2020-01-01', k)", "double": "k + 0.5D"}[key]
    df = spark.createDataFrame(data, "k int, v int").selectExpr(f"{as_key} AS k", "v").repartition(7)
    rows = TableProfile(df.select("v", F.col("k").alias("row")), row_id="row")
    groups: dict = {}
    for r in df.selectExpr("CAST(k AS STRING) AS s", "k", "v").collect():
        groups.setdefault(r["v"], []).append((r["k"] is not None, r["k"], r["s"]))
    extra = []
    for found in groups.values():
        least = min((x for x in found if x[0]), default=found[0])
        found.remove(least)
        extra += found
    extra.sort(key=lambda x: (x[0], x[1] if x[0] else 0))
    got = duplicates(rows).first()
    assert got["duplicate_rows"] == len(extra) and got["example_duplicate_indices"] == [x[2] for x in extra[:10]]
    refs = repeated_rows(rows, first=True)
    upto = _upto(refs, refs.count(), 10)
    assert (upto is None) == (key == "double")
    if upto is not None:
        assert rows.frame.filter(upto).count() < 100


def test_duplicates_by_a_telling_text_equal_those_by_row_hashes(spark):
    long = "word " * 30
    data = [(f"{long}{i % 950}" if i % 7 == 0 else f"r{i % 950}", i // 950 * (i % 3), None if i % 5 else "x") for i in range(1000)]
    df = spark.createDataFrame(data, "ref string, v int, note string").withColumn("row", F.monotonically_increasing_id()).repartition(5)
    plain, shared = TableProfile(df, row_id="row"), TableProfile(df, row_id="row", reuse=True)
    assert shared.telling_text().name == "ref" and plain.telling_text() is None
    assert duplicates(shared).first() == duplicates(plain).first()
    refs = [c.ref for c in plain.columns]
    assert 0 < duplicates(plain).first()["duplicate_rows"] < 50
    assert sorted(map(str, repeated_rows(shared, first=True).select(*refs, "n", "first").collect())) == sorted(map(str, repeated_rows(plain, first=True).select(*refs, "n", "first").collect()))
    # values that repeat too often, or are missing somewhere, tell nothing
    assert TableProfile(df.select("note", F.lit("a").alias("same")), reuse=True).telling_text() is None
