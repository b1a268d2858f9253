"""The column checks. Each takes a TableProfile and returns one row per finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.measures import four_bands, pct, preview, py_pct, severity_rank, three_bands
from ..functions.stage import TOKEN_ROW, local_table, small, stage
from .profile import ORD, ColumnInfo, TableProfile, slices

FACTS = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("ref", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("non_null_count", T.LongType()),
])

ADVICE = {
    "PASS": "Every row was counted and holds a value.",
    "LOW": "List the rows without a value and see whether they share a source or a day.",
    "MEDIUM": "Group the rows without a value by load or source before any fill.",
    "HIGH": "Trace the job that writes this column; too many rows arrive without it.",
    "CRITICAL": "Keep the column out of joins and aggregates until its feed is mended.",
    "ALL_MISSING": "The scan met nulls only: check how the load maps this column.",
    "CONSTANT": "Store the one value beside the table instead of in every row.",
    "NEAR_CONSTANT": "Select the few rows with another value and decide whether they belong here.",
    "POTENTIAL_IDENTIFIER": "Use it to join and to look rows up; aggregates over it say nothing.",
    "HIGH_CARDINALITY": "Handle it as a key with a lookup table rather than as a set of labels.",
    "OUTLIERS_DETECTED": "Select the rows with the listed extremes and compare them with what was sent.",
    "NO_OUTLIERS": "No value passes the fences computed from the exact quartiles.",
    "CATEGORY_INCONSISTENCY": "Write one mapping from the listed variants to the most frequent one.",
    "UNNAMED_COLUMN": "Name the column where it is written, or stop exporting the row number.",
    "NUMERIC_LIKE_TEXT": "Apply try_cast to double and settle the rows where that yields null.",
    "DATETIME_LIKE_TEXT": "Apply try_to_timestamp with the format that the values share.",
    "MIXED_DATETIME_FORMATS": "Apply try_to_timestamp once for each format and settle what none of them reads.",
}

STRINGS = T.ArrayType(T.StringType())
DOUBLES = T.ArrayType(T.DoubleType())


def advice(key: Column, *names: str) -> Column:
    out = None
    for name in names:
        out = F.when(key == name, ADVICE[name]) if out is None else out.when(key == name, ADVICE[name])
    return out


def _facts(p: TableProfile, columns: list[ColumnInfo], extra: dict[str, T.DataType] | None = None,
           values: dict[str, dict] | None = None) -> DataFrame:
    """One row per column of ``columns`` with the facts the check needs."""
    fields = [T.StructField(k, t) for k, t in (extra or {}).items()]
    rows = [dict(dataset=p.dataset, ref=c.ref, column=c.name, dtype=c.dtype, row_count=p.rows,
                 non_null_count=p.non_null(c), **((values or {}).get(c.ref, {}))) for c in columns]
    return local_table(p.spark, rows, T.StructType(FACTS.fields + fields))


def missing_values(p: TableProfile, include_complete: bool = True) -> DataFrame:
    """Missing cells per column."""
    missing = F.col("row_count") - F.col("non_null_count")
    out = (_facts(p, p.columns)
           .withColumn("missing_count", missing)
           .withColumn("missing_percentage", pct("missing_count", "row_count"))
           .withColumn("severity", four_bands(F.col("missing_count"), F.col("missing_percentage"),
                                              p.config.missing_bands)))
    if not include_complete:
        out = out.filter("missing_count > 0")
    return out.select(
        "dataset", "column", "dtype", "missing_count", "missing_percentage",
        F.col("non_null_count").alias("non_missing_count"), "severity",
        F.when(F.col("missing_count") == 0, "PASS").otherwise("ISSUE").alias("status"),
        advice(F.col("severity"), "PASS", "LOW", "MEDIUM", "HIGH", "CRITICAL").alias("recommendation"),
    ).orderBy(F.desc("missing_percentage"), "column")


def constant_columns(p: TableProfile) -> DataFrame:
    """Columns without any value, or with only one distinct value."""
    hits = [c for c in p.columns if p.non_null(c) == 0 or p.is_constant(c)]
    texts = [c for c in hits if c.group == "categorical" and p.non_null(c)]
    values = {c.ref: dict(unique_non_null=1 if p.non_null(c) else 0,
                          constant_value=p.counts.get(f"{c.ref}_text")) for c in hits}
    if texts:
        row = p.frame.agg(*[F.min(F.substring(c.ref, 1, 101)).alias(c.ref) for c in texts]).first()
        for c in texts:
            values[c.ref]["constant_value"] = row[c.ref]
    status = F.when(F.col("unique_non_null") == 0, "ALL_MISSING").otherwise("CONSTANT")
    return (_facts(p, hits, {"unique_non_null": T.LongType(), "constant_value": T.StringType()}, values)
            .withColumn("status", status)
            .withColumn("missing_count", F.col("row_count") - F.col("non_null_count"))
            .select("dataset", "column", "dtype", "status",
                    F.when(F.col("status") == "ALL_MISSING", "CRITICAL").otherwise("HIGH").alias("severity"),
                    "unique_non_null", "missing_count",
                    pct("missing_count", "row_count").alias("missing_percentage"),
                    preview(F.col("constant_value")).alias("constant_value"),
                    advice(F.col("status"), "ALL_MISSING", "CONSTANT").alias("recommendation"))
            .orderBy(severity_rank(F.col("severity")), "column"))


def near_constant_columns(p: TableProfile) -> DataFrame:
    """Columns that one value dominates."""
    share = p.config.near_constant_share
    top = p.dominant(share)
    hits = [c for c in p.columns if c.ref in top]
    unique = p.unique_counts(hits, group=False)
    values = {c.ref: dict(unique_non_null=unique[c.ref], dominant_value=top[c.ref][0],
                          dominant_count=top[c.ref][1]) for c in hits}
    return (_facts(p, hits, {"unique_non_null": T.LongType(), "dominant_value": T.StringType(),
                             "dominant_count": T.LongType()}, values)
            .withColumn("dominance_percentage", pct("dominant_count", "non_null_count"))
            .withColumn("missing_count", F.col("row_count") - F.col("non_null_count"))
            .select("dataset", "column", "dtype", F.lit("NEAR_CONSTANT").alias("status"),
                    F.when(F.col("dominance_percentage") >= p.config.near_constant_high_share, "HIGH")
                    .otherwise("MEDIUM").alias("severity"),
                    "non_null_count", "unique_non_null", preview(F.col("dominant_value")).alias("dominant_value"),
                    "dominant_count", "dominance_percentage", "missing_count",
                    pct("missing_count", "row_count").alias("missing_percentage"),
                    F.lit(ADVICE["NEAR_CONSTANT"]).alias("recommendation"))
            .orderBy(F.desc("dominance_percentage"), "column"))


def potential_identifiers(p: TableProfile) -> DataFrame:
    """Columns that may only label rows, by name or by uniqueness.

    A distinct count is taken only where it can matter: for text, and for
    columns with a telling name whose value range leaves room for the share
    and whose sketched count does not rule it out.
    """
    cfg = p.config
    some = [c for c in p.columns if p.non_null(c) and c.group != "other"]
    named = p.may_reach([c for c in some if c.name_hint and c.group != "categorical"], cfg.identifier_name_share)
    asked = [c for c in some if c.group == "categorical" or c in named]
    unique = p.unique_counts(asked)
    hits = [c for c in asked if unique[c.ref] > 1]
    values = {c.ref: dict(unique_non_null=unique[c.ref], name_hint=c.name_hint,
                          categorical=c.group == "categorical") for c in hits}
    by_name = F.col("name_hint") & (F.col("unique_percentage") >= cfg.identifier_name_share)
    by_share = F.col("categorical") & (F.col("unique_percentage") >= cfg.identifier_text_share)
    return (_facts(p, hits, {"unique_non_null": T.LongType(), "name_hint": T.BooleanType(),
                             "categorical": T.BooleanType()}, values)
            .withColumn("unique_percentage", pct("unique_non_null", "non_null_count"))
            .filter(by_name | by_share)
            .select("dataset", "column", "dtype", F.lit("POTENTIAL_IDENTIFIER").alias("status"),
                    F.when(F.col("name_hint"), "HIGH").otherwise("MEDIUM").alias("severity"),
                    "non_null_count", "unique_non_null", "unique_percentage", "name_hint",
                    F.when(by_name & by_share, "IDENTIFIER_NAME_AND_HIGH_UNIQUENESS")
                    .when(by_name, "IDENTIFIER_NAME_PATTERN")
                    .otherwise("HIGH_UNIQUENESS_CATEGORICAL").alias("detection_reason"),
                    F.lit(ADVICE["POTENTIAL_IDENTIFIER"]).alias("recommendation"))
            .orderBy(severity_rank(F.col("severity")), F.desc("unique_percentage"), "column"))


def high_cardinality_categories(p: TableProfile) -> DataFrame:
    """Text columns with many distinct values."""
    cfg = p.config
    asked = p.text_columns()
    unique = p.unique_counts(asked)
    values = {c.ref: dict(unique_non_null=unique[c.ref], potential_identifier_name=c.name_hint) for c in asked}
    return (_facts(p, asked, {"unique_non_null": T.LongType(), "potential_identifier_name": T.BooleanType()}, values)
            .withColumn("unique_percentage", pct("unique_non_null", "non_null_count"))
            .filter((F.col("unique_non_null") >= cfg.cardinality_count)
                    & (F.col("unique_percentage") >= cfg.cardinality_share))
            .select("dataset", "column", "dtype", F.lit("HIGH_CARDINALITY").alias("status"),
                    F.when(F.col("unique_percentage") >= cfg.cardinality_high_share, "HIGH")
                    .otherwise("MEDIUM").alias("severity"),
                    "non_null_count", "unique_non_null", "unique_percentage", "potential_identifier_name",
                    F.lit(ADVICE["HIGH_CARDINALITY"]).alias("recommendation"))
            .orderBy(F.desc("unique_percentage"), F.desc("unique_non_null"), "column"))


def numeric_outliers(p: TableProfile, include_clean: bool = False) -> DataFrame:
    """Values outside the interquartile bounds; infinities always count.

    With ``approx_quartiles`` the bounds come from sketches, and the method says so; what lies outside them is counted exactly.
    """
    cfg = p.config
    quartiles = p.sketched_quartiles if cfg.approx_quartiles else p.quartiles
    asked = [c for c in p.of_group("numeric") if p.non_null(c)]
    values: dict[str, dict] = {}
    outside: dict[str, Column] = {}
    for c in asked:
        value = F.col(c.ref).cast("double")
        if c.ref in quartiles:
            q1, q3 = quartiles[c.ref]
            low, high = q1 - cfg.iqr_multiplier * (q3 - q1), q3 + cfg.iqr_multiplier * (q3 - q1)
            values[c.ref] = dict(q1=q1, q3=q3, iqr=q3 - q1, lower_bound=low, upper_bound=high)
            outside[c.ref] = F.when((value < F.lit(low)) | (value > F.lit(high)), value)
        else:
            values[c.ref] = {}
            outside[c.ref] = value  # only infinities
        values[c.ref] |= dict(infinite_count=p.infinite(c), finite_count=p.non_null(c) - p.infinite(c))
    for part in slices(asked):
        row = p.frame.agg(*[f(outside[c.ref]).alias(f"{k}_{c.ref}") for c in part
                            for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
        for c in part:
            values[c.ref] |= dict(outlier_count=row[f"n_{c.ref}"], minimum_outlier=row[f"lo_{c.ref}"],
                                  maximum_outlier=row[f"hi_{c.ref}"])
    hits = [c for c in asked if include_clean or values[c.ref]["outlier_count"]]
    shown = {ref: {k: round(v, 4) if k in ("q1", "q3", "iqr", "lower_bound", "upper_bound") else v
                   for k, v in facts.items()} for ref, facts in values.items()}
    doubles = ("q1", "q3", "iqr", "lower_bound", "upper_bound", "minimum_outlier", "maximum_outlier")
    facts = _facts(p, hits, {k: T.DoubleType() for k in doubles}
                   | {k: T.LongType() for k in ("finite_count", "infinite_count", "outlier_count")}, shown)
    facts = facts.join(F.broadcast(_outlier_examples(p, hits, values, outside)), "ref", "left")
    count = F.col("outlier_count")
    return (facts.withColumn("outlier_percentage", pct("outlier_count", "non_null_count"))
            .select("dataset", "column", "dtype",
                    F.when(count == 0, "PASS").otherwise("OUTLIERS_DETECTED").alias("status"),
                    four_bands(count, F.col("outlier_percentage"), cfg.outlier_bands).alias("severity"),
                    F.lit("IQR_APPROX" if cfg.approx_quartiles else "IQR").alias("method"), F.lit(float(cfg.iqr_multiplier)).alias("iqr_multiplier"),
                    "non_null_count", "finite_count", "infinite_count",
                    *doubles[:5],
                    "outlier_count", "outlier_percentage", "minimum_outlier", "maximum_outlier",
                    F.coalesce("examples", F.array().cast(DOUBLES)).alias("example_outlier_values"),
                    F.when(count == 0, ADVICE["NO_OUTLIERS"]).otherwise(ADVICE["OUTLIERS_DETECTED"])
                    .alias("recommendation"))
            .orderBy(severity_rank(F.col("severity")), F.desc("outlier_percentage"), "column"))


def _outlier_examples(p: TableProfile, hits, values, outside) -> DataFrame:
    """The first outliers per column in row order; at most a handful each."""
    refs = [c.ref for c in hits if values[c.ref]["outlier_count"]]
    if not refs or not p.config.outlier_examples:
        return local_table(p.spark, [], T.StructType([T.StructField("ref", T.StringType()),
                                                      T.StructField("examples", DOUBLES)]))
    ids = [ORD] if p.ordered else []
    cells = (p.frame.select(*ids, *[outside[r].alias(r) for r in refs])
             .unpivot(ids, refs, "ref", "value").filter(F.col("value").isNotNull()))
    order = [*ids, "value"]
    place = F.row_number().over(W.partitionBy("ref").orderBy(*order))
    return (cells.withColumn("place", place).filter(F.col("place") <= p.config.outlier_examples)
            .groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("found"))
            .select("ref", F.col("found.value").alias("examples")))


CATEGORY_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField("column", T.StringType()),
    T.StructField("dtype", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("severity", T.StringType()), T.StructField("normalized_value", T.StringType()),
    T.StructField("variant_count", T.LongType()), T.StructField("variants", STRINGS),
    T.StructField("variant_frequencies", T.MapType(T.StringType(), T.LongType())),
    T.StructField("affected_count", T.LongType()), T.StructField("affected_percentage", T.DoubleType()),
    T.StructField("non_null_count", T.LongType()),
    T.StructField("whitespace_variant_detected", T.BooleanType()),
    T.StructField("case_variant_detected", T.BooleanType()), T.StructField("recommendation", T.StringType()),
])


def category_consistency(p: TableProfile) -> DataFrame:
    """Labels that differ only in case or spacing.

    Works on the distinct values. The keys with several variants are found from
    counts alone; only their variants are looked at further, and only the first
    few of each are ever listed.
    """
    cfg = p.config
    if p.values is None:
        return p.spark.createDataFrame([], CATEGORY_SCHEMA)
    # Each step is a column of its own, so that no expression is worked out twice.
    token, as_is = F.col("token"), F.col("as_is")
    kept = ["column", "token", "n", *(c for c in p.values.columns if c in ("long_plain", "long_key"))]
    cells = (p.values.select(*kept, X.is_plain(token).alias("as_is"))
             .select(*kept, "as_is", F.when(as_is, token).otherwise(X.collapse(token)).alias("p"))
             .select(*kept, "p", F.when(as_is, F.lower(token)).otherwise(X.casefold(F.col("p"))).alias("k"))
             .select("column", "token", "n", p.derived("plain", F.col("p")).alias("plain"),
                     p.derived("key", X.token(F.col("k"))).alias("key")))
    keys = stage(cells.groupBy("column", "key")
                 .agg(F.count(F.lit(1)).alias("variant_count"), F.sum("n").alias("affected_count"))
                 .filter(F.col("variant_count") > 1)).filter(F.col("key") != "")  # blank texts are no labels
    found = keys.count()
    if not found:
        return p.spark.createDataFrame([], CATEGORY_SCHEMA)
    wanted = small(keys.select(F.col("column").alias("_c"), F.col("key").alias("_k")), found, TOKEN_ROW)
    variants = stage(cells.join(wanted, F.col("column").eqNullSafe(F.col("_c")) & F.col("key").eqNullSafe(F.col("_k")),
                                "left_semi"))
    if p.has_long_text:
        variants = (variants.join(p.whole_text(variants), ["column", "token"], "left")
                    .withColumn("raw", F.coalesce("text", "token")))
    else:
        variants = variants.withColumn("raw", token)
    flags = variants.groupBy("column", "key").agg(
        F.bool_or(F.col("token") != F.col("plain")).alias("whitespace_variant_detected"),
        (F.min("plain") != F.max("plain")).alias("case_variant_detected"))
    order = [F.desc("n"), X.casefold(F.col("raw")), F.col("raw")]
    place = F.row_number().over(W.partitionBy("column", "key").orderBy(*order))
    listed = (variants.withColumn("place", place).filter(F.col("place") <= cfg.variant_examples)
              .groupBy("column", "key")
              .agg(F.array_sort(F.collect_list(F.struct("place", "raw", "n"))).alias("v")))
    infos = small(_facts(p, p.text_columns()).withColumnRenamed("column", "name"), len(p.columns), 1024)
    return (keys.join(flags, ["column", "key"]).join(listed, ["column", "key"])
            .join(infos, F.col("column") == F.col("ref"))
            .withColumn("affected_percentage", pct("affected_count", "non_null_count"))
            .select("dataset", F.col("name").alias("column"), "dtype",
                    F.lit("CATEGORY_INCONSISTENCY").alias("status"),
                    three_bands(F.col("affected_percentage"), cfg.category_bands).alias("severity"),
                    X.category_key(F.col("v")[0]["raw"]).alias("normalized_value"), "variant_count",
                    F.transform("v", lambda x: preview(x["raw"])).alias("variants"),
                    F.map_from_entries(F.transform("v", lambda x: F.struct(x["raw"], x["n"])))
                    .alias("variant_frequencies"),
                    "affected_count", "affected_percentage", "non_null_count",
                    "whitespace_variant_detected", "case_variant_detected",
                    F.lit(ADVICE["CATEGORY_INCONSISTENCY"]).alias("recommendation"))
            .orderBy(severity_rank(F.col("severity")), F.desc("affected_percentage"), "column", "normalized_value"))


WARNING_FIELDS = {
    "status": T.StringType(), "parse_success_count": T.LongType(), "filled": T.LongType(),
    "detected_formats": STRINGS,
}


def _warning_rows(p: TableProfile) -> list[tuple[ColumnInfo, dict]]:
    """Which warnings fire, decided from one row of facts per column."""
    cfg, rows = p.config, []
    for c in p.columns:
        if X.is_unnamed(c.name):
            rows.append((c, dict(status="UNNAMED_COLUMN", detected_formats=[])))
    for c in p.text_columns():
        facts = p.text_facts[c.ref]
        filled = facts["filled"]
        if not filled:
            continue
        if facts["numbers"] and py_pct(facts["numbers"], filled) >= cfg.numeric_text_share:
            rows.append((c, dict(status="NUMERIC_LIKE_TEXT", filled=filled, detected_formats=[],
                                 parse_success_count=facts["numbers"])))
        formats = sorted(k for k in X.DATE_PATTERNS if facts[k])
        dates = sum(facts[k] for k in formats)
        if dates and py_pct(dates, filled) >= cfg.date_text_share:
            mixed = len(formats) >= cfg.mixed_date_formats
            rows.append((c, dict(status="MIXED_DATETIME_FORMATS" if mixed else "DATETIME_LIKE_TEXT",
                                 filled=filled, detected_formats=formats, parse_success_count=dates)))
    return rows


def data_type_warnings(p: TableProfile, only: str | None = None) -> DataFrame:
    """Unnamed columns, and text that holds numbers or dates.

    ``only`` keeps one status.
    """
    rows = [(c, r) for c, r in _warning_rows(p) if only in (None, r["status"])]
    facts = local_table(
        p.spark,
        [dict(dataset=p.dataset, ref=c.ref, column=c.name, dtype=c.dtype, row_count=p.rows,
              non_null_count=p.non_null(c), **r) for c, r in rows],
        T.StructType(FACTS.fields + [T.StructField(k, t) for k, t in WARNING_FIELDS.items()]))
    facts = facts.join(F.broadcast(_invalid_examples(p, rows)), ["ref", "status"], "left")
    named = F.col("status") != "UNNAMED_COLUMN"
    date = F.col("status").contains("DATETIME")
    bad = F.col("filled") - F.col("parse_success_count")
    severity = (F.when(~named, "MEDIUM").when(F.col("status") == "MIXED_DATETIME_FORMATS", "HIGH")
                .when(bad > 0, "MEDIUM").otherwise("LOW"))
    return (facts.withColumn("invalid_count", bad)
            .select("dataset", "column", "dtype", "status", severity.alias("severity"),
                    F.when(~named, "INDEX_ARTIFACT").when(date, "DATETIME").otherwise("NUMERIC").alias("inferred_type"),
                    F.coalesce("filled", "non_null_count").alias("non_null_count"),
                    "parse_success_count",
                    F.when(named, pct("parse_success_count", "filled")).alias("parse_success_percentage"),
                    "invalid_count",
                    F.when(named, pct("invalid_count", "filled")).alias("invalid_percentage"),
                    F.when(date, F.size("detected_formats")).alias("detected_format_count"), "detected_formats",
                    F.coalesce("examples", F.array().cast(STRINGS)).alias("example_invalid_values"),
                    advice(F.col("status"), "UNNAMED_COLUMN", "NUMERIC_LIKE_TEXT", "DATETIME_LIKE_TEXT",
                           "MIXED_DATETIME_FORMATS").alias("recommendation"))
            .orderBy(severity_rank(F.col("severity")), "column", "status"))


def _invalid_examples(p: TableProfile, rows: list[tuple[ColumnInfo, dict]]) -> DataFrame:
    """The first distinct texts per warning that do not parse."""
    asked = {s: [c.ref for c, r in rows if r["status"] == s and r["filled"] > r["parse_success_count"]]
             for s in ("NUMERIC_LIKE_TEXT", "DATETIME_LIKE_TEXT", "MIXED_DATETIME_FORMATS")}
    asked = {s: refs for s, refs in asked.items() if refs}
    if not asked or not p.config.invalid_examples:
        return local_table(p.spark, [], T.StructType([
            T.StructField("ref", T.StringType()), T.StructField("status", T.StringType()),
            T.StructField("examples", STRINGS)]))
    bad_number, bad_date = ~F.col("number"), F.col("date").isNull()
    marks = F.array_compact(F.array(*[
        F.when(F.col("column").isin(refs) & (bad_number if s == "NUMERIC_LIKE_TEXT" else bad_date), F.lit(s))
        for s, refs in asked.items()]))
    first = [F.min("first_ord").alias("first_ord")] if p.ordered else []
    keep = ["token", *(["first_ord"] if p.ordered else [])]
    texts = (p.stripped_values().filter(F.col("column").isin(sorted({r for refs in asked.values() for r in refs})))
             .filter(F.col("strip") != "")
             .select("column", F.explode(marks).alias("status"), "strip", *keep)
             .groupBy("column", "status", "strip").agg(F.min("token").alias("token"), *first))
    place = F.row_number().over(W.partitionBy("column", "status").orderBy(*p.first_seen("strip")))
    texts = texts.withColumn("place", place).filter(F.col("place") <= p.config.invalid_examples)
    if p.has_long_text:
        texts = stage(texts)
        texts = (texts.join(p.whole_text(texts), ["column", "token"], "left")
                 .withColumn("shown", F.coalesce(X.strip(F.col("text")), F.col("strip"))))
    else:
        texts = texts.withColumn("shown", F.col("strip"))
    return (texts.groupBy(F.col("column").alias("ref"), "status")
            .agg(F.array_sort(F.collect_list(F.struct("place", preview(F.col("shown")).alias("shown")))).alias("v"))
            .select("ref", "status", F.col("v.shown").alias("examples")))
