"""DuckDB SQL for every registered query that SQL can express.

The statements are put together from the rules of the checks; nothing of the
engine is used but its fixed texts.
"""

from __future__ import annotations

from colsift.functions.text import DATE_PATTERNS, SPACE, has_identifier_name
from colsift.operators.checks import ADVICE
from colsift.operators.duplicates import ADVICE as COPY_ADVICE
from colsift.plans.issues import LIMITATION, METHOD
from colsift.plans.report import HEADLINES
from colsift.plans.score import CHECKS
from colsift.plans.views import ML_CATEGORIES, NOT_ASSESSED

from . import inputs

TYPES = {
    "documents": dict(doc_id="bigint", text="string", lang="string", source="string", n_chars="bigint"),
    "customer": dict(c_custkey="bigint", c_name="string", c_nationkey="int", c_acctbal="double", c_mktsegment="string"),
    "events": dict(event_id="bigint", ts="timestamp_ntz", user_id="bigint", event_type="string", value="double", props="string"),
    "lineitem": dict(l_orderkey="bigint", l_partkey="bigint", l_suppkey="bigint", l_linenumber="int", l_quantity="double",
                     l_extendedprice="double", l_discount="double", l_tax="double", l_returnflag="string",
                     l_linestatus="string", l_shipdate="timestamp_ntz"),
    "labels": dict(doc_id="bigint", quality="int", toxic="int"),
    inputs.NAME: inputs.DTYPES,
    inputs.DOCS_NAME: inputs.DOCS_COLUMNS,
}
NUMERIC = ("bigint", "int", "double")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rounded(x: str, places: int) -> str:
    """Rounding of a double by its exact binary value, as printf does it."""
    return f"CAST(printf('%.{places}f', CAST({x} AS DOUBLE)) AS DOUBLE)"


def pct(a: str, b: str) -> str:
    share = f"{a} / CAST({b} AS DOUBLE) * 100.0"
    return f"(CASE WHEN {b} = 0 THEN 0.0 ELSE {rounded(share, 2)} END)"


def bands4(n: str, p: str, b) -> str:
    return (f"(CASE WHEN {n} = 0 THEN 'PASS' WHEN {p} <= {b[0]} THEN 'LOW' WHEN {p} <= {b[1]} THEN 'MEDIUM' "
            f"WHEN {p} <= {b[2]} THEN 'HIGH' ELSE 'CRITICAL' END)")


def choose(key: str, texts: dict[str, str]) -> str:
    return f"(CASE {' '.join(f'WHEN {key} = {q(k)} THEN {q(v)}' for k, v in texts.items())} END)"


def advice(key: str, *names: str) -> str:
    return choose(key, {n: ADVICE[n] for n in names})


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({strip(x)}, '{SPACE}+', ' ', 'g')"


def fold(x: str) -> str:
    return f"replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"


def base(name: str, columns: dict[str, str] | None = None) -> str:
    """CTEs d (rows), f (facts per column) and v (value counts)."""
    columns = columns or TYPES[name]
    views = {inputs.NAME: inputs.DIRTY, inputs.DOCS_NAME: f"SELECT * REPLACE (nullif(size, 'NaN'::DOUBLE) AS size) FROM ({inputs.DOCS}) x"}
    source = views.get(name, f"SELECT {', '.join(columns)} FROM {name}")
    shown = {"row_no": inputs.DOCS_INDEX}
    types = " UNION ALL ".join(
        f"SELECT {i} AS pos, {q(shown.get(c, c))} AS col, {q(t)} AS dtype, {has_identifier_name(shown.get(c, c))} AS hint" for i, (c, t) in enumerate(columns.items()))
    values = " UNION ALL ".join(
        f"SELECT {q(shown.get(c, c))} AS col, CAST({c} AS VARCHAR) AS val, count(*) AS n FROM d WHERE {c} IS NOT NULL GROUP BY 2" for c in columns)
    return f"""
d AS ({source}),
t AS ({types}),
r AS (SELECT count(*) AS rows FROM d),
v AS MATERIALIZED ({values}),
f AS (SELECT t.*, r.rows, CAST(coalesce(sum(v.n), 0) AS BIGINT) AS nn, count(v.val) AS u, coalesce(max(v.n), 0) AS top, min(v.val) AS least
      FROM t CROSS JOIN r LEFT JOIN v ON v.col = t.col GROUP BY ALL)"""


def missing(name: str) -> str:
    p = pct("(rows - nn)", "rows")
    sev = bands4("(rows - nn)", p, (5, 20, 40))
    return f"""SELECT {q(name)} AS dataset, col AS "column", dtype, rows - nn AS missing_count, {p} AS missing_percentage,
 nn AS non_missing_count, {sev} AS severity, CASE WHEN rows = nn THEN 'PASS' ELSE 'ISSUE' END AS status,
 {advice(sev, 'PASS', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL')} AS recommendation FROM f"""


def copies(name: str, columns, examples: str | None) -> str:
    cols = ", ".join(columns)
    p = pct("dup", "rows")
    ids = (f"(SELECT string_agg(id, ',' ORDER BY k) FROM (SELECT CAST({examples} AS VARCHAR) AS id, {examples} AS k FROM "
           f"(SELECT *, row_number() OVER (PARTITION BY {cols}) AS i FROM d) WHERE i > 1 ORDER BY {examples} LIMIT 10))"
           if examples else "NULL")
    return f"""SELECT {q(name)} AS dataset, dup AS duplicate_rows, {p} AS duplicate_percentage, grouped AS rows_in_duplicate_groups,
 groups AS duplicate_group_count, {bands4('dup', p, (1, 5, 10))} AS severity,
 CASE WHEN dup > 0 THEN 'ISSUE' ELSE 'PASS' END AS status, coalesce({ids}, '') AS example_duplicate_indices,
 CASE WHEN dup > 0 THEN {q(COPY_ADVICE[True])} ELSE {q(COPY_ADVICE[False])} END AS recommendation
FROM (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS dup, CAST(coalesce(sum(n), 0) AS BIGINT) AS grouped, count(*) AS groups
      FROM (SELECT count(*) AS n FROM d GROUP BY {cols} HAVING count(*) > 1)) CROSS JOIN r"""


def constant(name: str) -> str:
    return f"""SELECT {q(name)} AS dataset, f.col AS "column", dtype, CASE WHEN u = 0 THEN 'ALL_MISSING' ELSE 'CONSTANT' END AS status,
 CASE WHEN u = 0 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, u AS unique_non_null, rows - nn AS missing_count,
 {pct('(rows - nn)', 'rows')} AS missing_percentage, f.least AS constant_value,
 CASE WHEN u = 0 THEN {q(ADVICE['ALL_MISSING'])} ELSE {q(ADVICE['CONSTANT'])} END AS recommendation
FROM f WHERE u <= 1"""


def near_constant(name: str) -> str:
    p = pct("top", "nn")
    return f"""SELECT {q(name)} AS dataset, col AS "column", dtype, 'NEAR_CONSTANT' AS status,
 CASE WHEN {p} >= 99 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, nn AS non_null_count, u AS unique_non_null,
 (SELECT min(v.val) FROM v WHERE v.col = f.col AND v.n = f.top) AS dominant_value, top AS dominant_count,
 {p} AS dominance_percentage, rows - nn AS missing_count, {pct('(rows - nn)', 'rows')} AS missing_percentage,
 {q(ADVICE['NEAR_CONSTANT'])} AS recommendation FROM f WHERE u > 1 AND {p} >= 95"""


def identifiers(name: str) -> str:
    p = pct("u", "nn")
    by_name, by_share = f"(hint AND {p} >= 80)", f"(dtype = 'string' AND {p} >= 95)"
    return f"""SELECT {q(name)} AS dataset, col AS "column", dtype, 'POTENTIAL_IDENTIFIER' AS status,
 CASE WHEN hint THEN 'HIGH' ELSE 'MEDIUM' END AS severity, nn AS non_null_count, u AS unique_non_null, {p} AS unique_percentage,
 hint AS name_hint, CASE WHEN {by_name} AND {by_share} THEN 'IDENTIFIER_NAME_AND_HIGH_UNIQUENESS'
 WHEN {by_name} THEN 'IDENTIFIER_NAME_PATTERN' ELSE 'HIGH_UNIQUENESS_CATEGORICAL' END AS detection_reason,
 {q(ADVICE['POTENTIAL_IDENTIFIER'])} AS recommendation FROM f WHERE u > 1 AND ({by_name} OR {by_share})"""


def cardinality(name: str) -> str:
    p = pct("u", "nn")
    return f"""SELECT {q(name)} AS dataset, col AS "column", dtype, 'HIGH_CARDINALITY' AS status,
 CASE WHEN {p} >= 80 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, nn AS non_null_count, u AS unique_non_null,
 {p} AS unique_percentage, hint AS potential_identifier_name, {q(ADVICE['HIGH_CARDINALITY'])} AS recommendation
FROM f WHERE dtype = 'string' AND u >= 20 AND {p} >= 20"""


def outliers(name: str, columns: dict[str, str]) -> str:
    parts = []
    far = "(isinf(x) OR x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))"
    for c, t in columns.items():
        if t not in NUMERIC:
            continue
        x = f"CAST({c} AS DOUBLE)"
        shown = inputs.DOCS_INDEX if c == "row_no" else c
        parts.append(f"""SELECT {q(shown)} AS col, q1, q3, count(x) AS n, count(*) FILTER (WHERE isinf(x)) AS infs,
 count(*) FILTER (WHERE {far}) AS outs, min(x) FILTER (WHERE {far}) AS lo, max(x) FILTER (WHERE {far}) AS hi
FROM (SELECT {x} AS x FROM d), (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM d WHERE NOT isinf({x})) GROUP BY q1, q3""")
    p = pct("outs", "n")
    return f"""SELECT {q(name)} AS dataset, o.col AS "column", dtype, 'OUTLIERS_DETECTED' AS status,
 {bands4('outs', p, (1, 5, 10))} AS severity, 'IQR' AS method, CAST(1.5 AS DOUBLE) AS iqr_multiplier, n AS non_null_count, n - infs AS finite_count,
 infs AS infinite_count, {rounded('q1', 4)} AS q1, {rounded('q3', 4)} AS q3, {rounded('q3 - q1', 4)} AS iqr,
 {rounded('q1 - 1.5 * (q3 - q1)', 4)} AS lower_bound, {rounded('q3 + 1.5 * (q3 - q1)', 4)} AS upper_bound,
 outs AS outlier_count, {p} AS outlier_percentage, lo AS minimum_outlier, hi AS maximum_outlier,
 {q(ADVICE['OUTLIERS_DETECTED'])} AS recommendation
FROM ({' UNION ALL '.join(parts)}) o JOIN t ON t.col = o.col WHERE outs > 0"""


def category(name: str, brief: bool = False, keyed: bool = False) -> str:
    p = pct("affected", "nn")
    lists = "" if brief else """ key AS normalized_value, variants, freq AS variant_frequencies,"""
    if keyed:
        lists = " key AS normalized_value,"
    ranked = "" if brief or keyed else """,
 string_agg(CASE WHEN i <= 10 THEN val END, ',' ORDER BY i) AS variants,
 string_agg(CASE WHEN i <= 10 THEN concat(val, '=', n) END, ',' ORDER BY i) AS freq"""
    return f"""SELECT {q(name)} AS dataset, f.col AS "column", dtype, 'CATEGORY_INCONSISTENCY' AS status,
 CASE WHEN {p} <= 5 THEN 'LOW' WHEN {p} <= 20 THEN 'MEDIUM' ELSE 'HIGH' END AS severity, variant_count,{lists}
 affected AS affected_count, {p} AS affected_percentage, nn AS non_null_count, spaced AS whitespace_variant_detected,
 cased AS case_variant_detected, {q(ADVICE['CATEGORY_INCONSISTENCY'])} AS recommendation
FROM (SELECT col, key, count(*) AS variant_count, CAST(sum(n) AS BIGINT) AS affected, bool_or(val <> plain) AS spaced,
      count(DISTINCT plain) > 1 AS cased{ranked}
 FROM (SELECT *, row_number() OVER (PARTITION BY col, key ORDER BY n DESC, {fold('val')}, val) AS i
       FROM (SELECT col, val, n, plain, {fold('plain')} AS key FROM (SELECT v.*, {collapse('val')} AS plain FROM v JOIN t ON t.col = v.col AND dtype = 'string')))
 WHERE key <> '' GROUP BY col, key HAVING count(*) > 1) g JOIN f ON f.col = g.col"""


NUMBER_SQL = r"'[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?'"


def warnings(name: str) -> str:
    label = "CASE " + " ".join(f"WHEN regexp_full_match(s, {q(p)}) THEN {q(k)}" for k, p in DATE_PATTERNS.items()) + " END"
    number = (f"(regexp_full_match(s, '[+-]?(inf|infinity)', 'i') OR (regexp_full_match(s, {NUMBER_SQL}) "
              f"AND coalesce(isfinite(try_cast(s AS DOUBLE)), false)))")
    sev = "(CASE WHEN status = 'MIXED_DATETIME_FORMATS' THEN 'HIGH' WHEN filled > good THEN 'MEDIUM' ELSE 'LOW' END)"
    bad = ("(SELECT string_agg(s, ',' ORDER BY o) FROM (SELECT s, min(o) AS o FROM z WHERE z.col = w.col AND "
           "(CASE WHEN w.status = 'NUMERIC_LIKE_TEXT' THEN NOT num ELSE lab IS NULL END) GROUP BY s ORDER BY o, s LIMIT 5))")
    first = " UNION ALL ".join(f"SELECT {q(c)} AS col, {c} AS val, order_id AS o FROM d WHERE {c} IS NOT NULL" for c in inputs.TEXT)
    return f"""SELECT {q(name)} AS dataset, w.col AS "column", dtype, status, {sev} AS severity,
 CASE WHEN status = 'NUMERIC_LIKE_TEXT' THEN 'NUMERIC' ELSE 'DATETIME' END AS inferred_type, filled AS non_null_count,
 good AS parse_success_count, {pct('good', 'filled')} AS parse_success_percentage, filled - good AS invalid_count,
 {pct('(filled - good)', 'filled')} AS invalid_percentage,
 CAST(CASE WHEN status <> 'NUMERIC_LIKE_TEXT' THEN formats END AS INTEGER) AS detected_format_count,
 CASE WHEN status <> 'NUMERIC_LIKE_TEXT' THEN names ELSE '' END AS detected_formats, coalesce({bad}, '') AS example_invalid_values,
 {advice('status', 'NUMERIC_LIKE_TEXT', 'DATETIME_LIKE_TEXT', 'MIXED_DATETIME_FORMATS')} AS recommendation
FROM (SELECT col, 'NUMERIC_LIKE_TEXT' AS status, filled, nums AS good, formats, names FROM y WHERE nums > 0 AND {pct('nums', 'filled')} >= 90
 UNION ALL SELECT col, CASE WHEN formats >= 2 THEN 'MIXED_DATETIME_FORMATS' ELSE 'DATETIME_LIKE_TEXT' END, filled, dates, formats, names
 FROM y WHERE dates > 0 AND {pct('dates', 'filled')} >= 80) w JOIN t ON t.col = w.col""", f"""
z AS (SELECT *, {number} AS num, {label} AS lab FROM (SELECT col, {strip('val')} AS s, o FROM ({first})) WHERE s <> ''),
y AS (SELECT col, count(*) AS filled, count(*) FILTER (WHERE num) AS nums, count(lab) AS dates, count(DISTINCT lab) AS formats,
      string_agg(DISTINCT lab, ',' ORDER BY lab) AS names FROM z GROUP BY col)"""


WARN, WARN_CTES = warnings(inputs.NAME)
N = inputs.NAME
CHECK_SQL = {
    "missing_values": missing(N),
    "duplicates": copies(N, inputs.COLUMNS, "order_id"),
    "constant_columns": constant(N),
    "near_constant_columns": near_constant(N),
    "potential_identifiers": identifiers(N),
    "high_cardinality_categories": cardinality(N),
    "numeric_outliers": outliers(N, inputs.DTYPES),
    "category_consistency": category(N),
    "data_type_warnings": WARN,
}


def with_base(sql: str, name: str = N, columns=None) -> str:
    extra = "," + WARN_CTES if name == N else ""
    return f"WITH {base(name, columns).strip()}{extra} {sql}"


RANK = "(CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END)"
TWO = lambda x: f"printf('%.2f', {x})"

IMPACT = """(CASE status WHEN 'UNNAMED_COLUMN' THEN 100.0 WHEN 'MIXED_DATETIME_FORMATS' THEN parse_success_percentage
 ELSE coalesce(invalid_percentage, parse_success_percentage) END)"""

# check: issue type, count, percentage, evidence, filter
RECORDS = {
    "missing_values": ("'MISSING_VALUES'", "missing_count", "missing_percentage",
                       f"concat(missing_count, ' of ', missing_count + non_missing_count, ' cells are missing (', {TWO('missing_percentage')}, '%).')", "status <> 'PASS'"),
    "duplicates": ("'EXACT_DUPLICATE_ROWS'", "duplicate_rows", "duplicate_percentage",
                   f"concat(duplicate_rows, ' rows repeat an earlier row (', {TWO('duplicate_percentage')}, '%).')", "status <> 'PASS'"),
    "constant_columns": ("status", "unique_non_null", "CAST(100.0 AS DOUBLE)",
                         "CASE WHEN status = 'CONSTANT' THEN concat('Every value present is ''', constant_value, '''.') ELSE 'The column holds no value.' END", "true"),
    "near_constant_columns": ("'NEAR_CONSTANT_COLUMN'", "dominant_count", "dominance_percentage",
                              f"concat('''', dominant_value, ''' makes up ', {TWO('dominance_percentage')}, '% of the values present.')", "true"),
    "potential_identifiers": ("'POTENTIAL_IDENTIFIER'", "unique_non_null", "unique_percentage",
                              f"concat({TWO('unique_percentage')}, '% distinct values (', detection_reason, ').')", "true"),
    "high_cardinality_categories": ("'HIGH_CARDINALITY_CATEGORY'", "unique_non_null", "unique_percentage",
                                    f"concat(unique_non_null, ' distinct values (', {TWO('unique_percentage')}, '%).')", "true"),
    "numeric_outliers": ("'NUMERIC_OUTLIERS'", "outlier_count", "outlier_percentage",
                         f"concat(outlier_count, ' values lie outside [', printf('%.4f', lower_bound), ', ', printf('%.4f', upper_bound), '] (', {TWO('outlier_percentage')}, '%).')", "true"),
    "category_consistency": ("'CATEGORY_LABEL_INCONSISTENCY'", "affected_count", "affected_percentage",
                             f"concat(variant_count, ' spellings of ''', normalized_value, ''' cover ', {TWO('affected_percentage')}, '% of the values present.')", "true"),
    "data_type_warnings": ("status", "invalid_count", IMPACT, f"""CASE status
 WHEN 'NUMERIC_LIKE_TEXT' THEN concat({TWO('parse_success_percentage')}, '% of the texts are numbers; ', invalid_count, ' are not.')
 WHEN 'MIXED_DATETIME_FORMATS' THEN concat(detected_format_count, ' date formats cover ', {TWO('parse_success_percentage')}, '% of the texts.')
 ELSE concat({TWO('parse_success_percentage')}, '% of the texts are dates; ', invalid_count, ' are not.') END""", "true"),
}
ISSUE = ("dataset", "check_name", "issue_type", '"column"', "severity", "priority_level", "status", '"count"', "percentage",
         "evidence", "recommendation", "method", "limitation")


def record(check: str, tie: bool = False) -> str:
    kind, count, share, evidence, where = RECORDS[check]
    column = "CAST(NULL AS VARCHAR)" if check == "duplicates" else '"column"'
    label = (", " + ("normalized_value" if check == "category_consistency" else "''") + " AS tie") if tie else ""
    return f"""SELECT dataset, {q(check)} AS check_name, {kind} AS issue_type, {column} AS "column", severity,
 concat('P', {RANK}) AS priority_level, status, CAST({count} AS BIGINT) AS "count", {share} AS percentage, {evidence} AS evidence,
 recommendation, {q(METHOD[check])} AS method, {q(LIMITATION[check])} AS limitation{label} FROM ({CHECK_SQL[check]}) x WHERE {where}"""


def _chain() -> str:
    order = choose("check_name", {c: str(i) for i, c in enumerate(CHECKS)})
    union = " UNION ALL ".join(record(c, True) for c in CHECKS)
    ranked = (f"SELECT * EXCLUDE (tie), CAST(row_number() OVER (ORDER BY {RANK}, percentage DESC NULLS LAST, \"count\" DESC NULLS LAST, "
              f"{order}, coalesce(\"column\", ''), issue_type, tie) AS INTEGER) AS priority_rank FROM issues0")
    penalty = ("(CASE severity WHEN 'CRITICAL' THEN 100.0 WHEN 'HIGH' THEN 50.0 WHEN 'MEDIUM' THEN 25.0 WHEN 'LOW' THEN 10.0 ELSE 0.0 END)")
    schema = " UNION ALL ".join(f'SELECT "column", {penalty} AS p FROM ({CHECK_SQL[c]}) x' for c in
                                ("constant_columns", "near_constant_columns", "potential_identifiers", "high_cardinality_categories",
                                 "data_type_warnings"))
    clamp = lambda x: rounded(f"greatest(0.0, least(100.0, {x}))", 2)
    return f"""issues0 AS ({union}),
issues1 AS ({ranked}),
issues AS (SELECT *, printf('ISSUE-%03d', priority_rank) AS issue_id FROM issues1),
sp AS (SELECT "column", CAST(max(p) AS DOUBLE) AS schema_penalty FROM ({schema}) GROUP BY 1),
cb AS (SELECT "column", least(100.0, CAST(sum(CAST(affected_percentage AS DECIMAL(18,2))) AS DOUBLE)) AS category_affected_percentage
       FROM ({CHECK_SQL['category_consistency']}) x GROUP BY 1),
ob AS (SELECT "column", least(100.0, max(outlier_percentage)) AS outlier_percentage FROM ({CHECK_SQL['numeric_outliers']}) x GROUP BY 1),
ov AS (SELECT {q(N)} AS dataset, rows AS row_count, CAST({len(inputs.COLUMNS)} AS BIGINT) AS column_count, rows * {len(inputs.COLUMNS)} AS total_cells,
       (SELECT CAST(sum(rows - nn) AS BIGINT) FROM f) AS missing_cells, {pct('(SELECT sum(rows - nn) FROM f)', f'(rows * {len(inputs.COLUMNS)})')} AS missing_percentage,
       c.duplicate_rows, c.duplicate_percentage FROM r CROSS JOIN ({CHECK_SQL['duplicates']}) c),
parts AS (SELECT dataset, {clamp('100 - missing_percentage')} AS completeness, {clamp('100 - duplicate_percentage')} AS duplicate_free,
       {clamp(f'100 - (SELECT coalesce(sum(schema_penalty), 0) FROM sp) / {len(inputs.COLUMNS)}')} AS schema_usability,
       {clamp(f'100 - (SELECT coalesce(sum(category_affected_percentage), 0) FROM cb) / {len(inputs.TEXT)}')} AS categorical_consistency,
       {clamp(f'100 - (SELECT coalesce(sum(outlier_percentage), 0) FROM ob) / {len(inputs.NUMERIC)}')} AS outlier_risk FROM ov),
contrib AS (SELECT *, {', '.join(f'{rounded(f'{c} * CAST({w} AS DOUBLE)', 4)} AS {c}_contribution' for c, w in WEIGHTS.items())} FROM parts),
counts AS (SELECT count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high,
       count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low, count(*) AS issue_count_total FROM issues0),
score0 AS (SELECT *, {clamp(' + '.join(f'{c}_contribution' for c in WEIGHTS))} AS overall_score FROM contrib CROSS JOIN counts),
score1 AS (SELECT *, CASE WHEN overall_score >= 85 THEN 'READY_WITH_MINOR_REVIEW' WHEN overall_score >= 70 THEN 'NEEDS_CLEANING'
       WHEN overall_score >= 50 THEN 'SIGNIFICANT_QUALITY_ISSUES' ELSE 'NOT_READY' END AS score_band_status FROM score0),
score2 AS (SELECT *, CASE WHEN critical > 0 THEN 'NOT_READY' WHEN high > 0 AND score_band_status = 'READY_WITH_MINOR_REVIEW'
       THEN 'NEEDS_CLEANING' ELSE score_band_status END AS readiness_status FROM score1),
score AS (SELECT *, readiness_status <> score_band_status AS status_adjusted_by_gates FROM score2),
rec0 AS (SELECT dataset, "column", recommendation AS action, count(*) AS related_issue_count, min(priority_rank) AS first_rank,
       string_agg(issue_id, ',' ORDER BY priority_rank) AS ids, string_agg(DISTINCT check_name, ',') AS checks FROM issues GROUP BY ALL),
rec AS (SELECT r.dataset, printf('REC-%03d', row_number() OVER (ORDER BY first_rank)) AS recommendation_id,
       CAST(row_number() OVER (ORDER BY first_rank) AS INTEGER) AS priority_rank, i.priority_level, i.severity, r."column", i.issue_type, r.action,
       i.evidence AS rationale, related_issue_count, ids AS related_issue_ids, checks AS source_checks
       FROM rec0 r JOIN issues i ON i.priority_rank = r.first_rank ORDER BY first_rank LIMIT 10)"""


WEIGHTS = dict(completeness=0.35, duplicate_free=0.20, schema_usability=0.15, categorical_consistency=0.15, outlier_risk=0.15)
GROUP_LISTS = {"numeric": inputs.NUMERIC, "categorical": inputs.TEXT, "datetime": [], "boolean": [], "other": []}
CHAIN = _chain()


def of_chain(sql: str) -> str:
    return f"WITH {base(N).strip()},{WARN_CTES},\n{CHAIN}\n{sql}"


def first_ranked(where: str, limit: int, source: str = "issues", extra: str = "") -> str:
    return f"""SELECT *, least(total_matching_count, {limit}) AS returned_count, total_matching_count > {limit} AS truncated FROM
 (SELECT *{extra}, count(*) OVER () AS total_matching_count FROM {source} WHERE {where} ORDER BY priority_rank LIMIT {limit})"""


def _findings(names) -> str:
    return " UNION ALL ".join(
        f"""SELECT dataset, {q(n)} AS check_name, {'CAST(NULL AS VARCHAR)' if n == 'duplicates' else '"column"'} AS "column", status, severity
 FROM ({CHECK_SQL[n]}) x""" for n in names)


def _folder() -> str:
    """The columns of each file that FOLDER makes; a text that stands for a missing value is none."""
    parts = []
    for (name, key, columns, sep, encoding), types in zip(inputs.FOLDER, inputs.FOLDER_TYPES):
        kind = "cp1252" if encoding == "ISO-8859-1" else "utf-8-sig"
        names = [c.rsplit(" AS ", 1) for c in columns]
        notes = ([] if kind == "utf-8-sig" else ["fallback_encoding"]) + ["empty_columns"] * ("note" in [n for _, n in names])
        for i, ((sql, shown), dtype) in enumerate(zip(names, types)):
            count = f"count(CASE WHEN CAST({sql} AS VARCHAR) NOT IN ('n/a') THEN 1 END)"
            parts.append(f"""SELECT concat('{name}/k=', {key}) AS part, count(*) AS row_count, CAST({len(columns)} AS BIGINT) AS column_count, '{kind}' AS encoding,
 {q(sep)} AS delimiter, CAST(NULL AS VARCHAR) AS code, '{",".join(notes)}' AS warnings, CAST({i} AS INTEGER) AS position, '{shown}' AS name, '{dtype}' AS dtype, {count} AS non_null_count
FROM {name} GROUP BY {key}""")
    return " UNION ALL ".join(parts)


def _several() -> str:
    """The findings of four tables: the checks' own SQL over each."""
    def of(check: str, sql: str) -> str:
        return f"""SELECT dataset, {q(check)} AS check_name, {'CAST(NULL AS VARCHAR)' if check == 'duplicates' else '"column"'} AS "column", status, severity FROM ({sql}) x"""
    parts = [with_base(_findings(CHECKS))]
    for name in (inputs.DOCS_NAME, "customer", "labels"):
        columns = TYPES[name]
        checks = {"missing_values": missing(name), "duplicates": copies(name, list(columns), None), "constant_columns": constant(name), "near_constant_columns": near_constant(name),
                  "potential_identifiers": identifiers(name), "high_cardinality_categories": cardinality(name), "numeric_outliers": outliers(name, columns),
                  "category_consistency": category(name, brief=True)}
        if name == inputs.DOCS_NAME:
            checks["data_type_warnings"] = (
                f"""SELECT {q(name)} AS dataset, col AS "column", 'UNNAMED_COLUMN' AS status, 'MEDIUM' AS severity FROM f WHERE lower(col) LIKE 'unnamed:%'
 UNION ALL SELECT {q(name)}, 'seen', 'DATETIME_LIKE_TEXT', 'MEDIUM'""")
        parts.append(with_base(" UNION ALL ".join(of(c, sql) for c, sql in checks.items()), name))
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


def _approximate() -> str:
    columns = [c for c, t in TYPES["lineitem"].items() if t in NUMERIC]
    return " UNION ALL ".join(f"""SELECT 'lineitem' AS dataset, {q(c)} AS "column", 'IQR_APPROX' AS method, count({c}) AS non_null_count, count({c}) AS finite_count,
 true AS q1_within, true AS q3_within FROM lineitem""" for c in columns)


GROUP_SQL = ", ".join(f"CAST({len(c)} AS INTEGER) AS {g}_column_count, {q(','.join(c))} AS {g}_columns" for g, c in GROUP_LISTS.items())
FILE_SQL = """{name} AS file_name, CAST(NULL AS BIGINT) AS file_size_bytes, CAST(NULL AS VARCHAR) AS encoding,
 CAST(NULL AS VARCHAR) AS delimiter, CAST(NULL AS VARCHAR) AS fingerprint_sha256, '' AS loader_warnings"""
HIGHEST = "CASE WHEN critical > 0 THEN 'CRITICAL' WHEN high > 0 THEN 'HIGH' WHEN medium > 0 THEN 'MEDIUM' WHEN low > 0 THEN 'LOW' ELSE 'PASS' END"
SUMMARY = f"""SELECT dataset, {choose('readiness_status', HEADLINES)} AS headline, overall_score, score_band_status, readiness_status,
 status_adjusted_by_gates, issue_count_total, critical, high, medium, low,
 (SELECT count(*) FROM rec) AS prioritized_recommendation_count, {HIGHEST} AS highest_severity FROM score"""
CONTRIBUTIONS = ", ".join(f"{c}_contribution" for c in WEIGHTS)
ML = choose("check_name", ML_CATEGORIES)
FILES = f"({inputs.FILES}) x"
BAD_KIND = "CASE kind WHEN 'empty' THEN 'empty_file' WHEN 'blank' THEN 'empty_file' {rest} END"
HAS_TEXT = "kind NOT IN ('empty', 'blank')"


def chain_queries() -> dict[str, str]:
    out = {f"issues_{k}": with_base(record(c)) for k, c in zip(
        ("missing", "duplicate", "constant", "near_constant", "identifier", "cardinality", "outlier", "category", "type"), CHECKS)}
    components = " UNION ALL ".join(
        f"SELECT dataset, {q(c)} AS component, {c} AS score, CAST({w} AS DOUBLE) AS weight, {c}_contribution AS weighted_contribution FROM score"
        for c, w in WEIGHTS.items())
    out |= {k: of_chain(v) for k, v in {
        "score_completeness": "SELECT dataset, completeness FROM score",
        "score_duplicate_free": "SELECT dataset, duplicate_free FROM score",
        "score_schema": "SELECT dataset, schema_usability FROM score",
        "score_category": "SELECT dataset, categorical_consistency FROM score",
        "score_outlier": "SELECT dataset, outlier_risk FROM score",
        "quality_score": "SELECT * FROM score",
        "issue_counts": f"SELECT {q(N)} AS dataset, * FROM counts",
        "score_band": "SELECT dataset, overall_score, score_band_status FROM score",
        "readiness_gate": """SELECT dataset, score_band_status, readiness_status, status_adjusted_by_gates,
 CAST(CASE WHEN critical > 0 OR (high > 0 AND score_band_status = 'READY_WITH_MINOR_REVIEW') THEN 1 ELSE 0 END AS INTEGER) AS gate_count FROM score""",
        "score_diagnostics": f"""SELECT {q(N)} AS dataset, "column", schema_penalty, category_affected_percentage, outlier_percentage
 FROM sp FULL JOIN cb USING ("column") FULL JOIN ob USING ("column")""",
        "score_table": "SELECT dataset, overall_score, readiness_status, issue_count_total FROM score",
        "ranked_issues": "SELECT * FROM issues",
        "recommendations": "SELECT * FROM rec",
        "recommendation_ranges": """SELECT dataset, recommendation_id, CAST(min(r) AS INTEGER) AS first, CAST(max(r) AS INTEGER) AS last FROM
 (SELECT i.dataset, recommendation_id, i.priority_rank AS r, i.priority_rank - row_number() OVER (PARTITION BY recommendation_id ORDER BY i.priority_rank) AS run
  FROM issues i JOIN rec r ON r."column" IS NOT DISTINCT FROM i."column" AND r.action = i.recommendation) GROUP BY dataset, recommendation_id, run""",
        "recommendation_links": """SELECT i.dataset, recommendation_id, issue_id, i.priority_rank AS issue_rank, check_name, related_issue_count
 FROM issues i JOIN rec r ON r."column" IS NOT DISTINCT FROM i."column" AND r.action = i.recommendation""",
        "report_summary": SUMMARY,
        "report_reconcile": """SELECT dataset, critical, high, medium, low, issue_count_total, critical AS table_critical, high AS table_high,
 medium AS table_medium, low AS table_low, issue_count_total AS table_issue_count_total FROM score WHERE false""",
        "audit_report": f"""SELECT dataset, '1.0' AS report_version,
 concat('AUD-', substr(sha256(concat('|uploaded.csv|{inputs.STAMP}|', {TWO('overall_score')})), 1, 12)) AS report_id,
 {q(inputs.STAMP)} AS generated_at_utc, overall_score, issue_count_total AS issue_count, (SELECT count(*) FROM rec) AS recommendation_count,
 (SELECT issue_type FROM issues WHERE priority_rank = 1) AS first_issue_type FROM score""",
        "write_report_json": """SELECT i.dataset, priority_rank AS place, priority_rank, issue_id, check_name, issue_type, "column", severity, "count", percentage, evidence,
 recommendation, overall_score, readiness_status, row_count FROM issues i JOIN score s ON s.dataset = i.dataset JOIN ov ON ov.dataset = i.dataset""",
        "file_metadata": f"""SELECT dataset, {FILE_SQL.format(name="'orders.csv'")}, row_count, column_count,
 'metadata_column_count_mismatch' AS code FROM ov""",
        "dataset_overview": f"SELECT ov.*, {GROUP_SQL} FROM ov",
        "overview_view": f"SELECT ov.*, {GROUP_SQL}, {FILE_SQL.format(name=repr('uploaded.csv'))} FROM ov",
        "summary_view": f"""SELECT s.* EXCLUDE (prioritized_recommendation_count), {', '.join(WEIGHTS)}, {CONTRIBUTIONS},
 {', '.join(f'CAST({w} AS DOUBLE) AS {c}_weight' for c, w in WEIGHTS.items())} FROM ({SUMMARY}) s JOIN contrib USING (dataset)""",
        "missing_view": first_ranked("check_name = 'missing_values' AND percentage >= 3.0", 2),
        "duplicate_view": """SELECT ov.dataset, duplicate_rows > 0 AS has_exact_duplicates, duplicate_rows, duplicate_percentage, issue_id,
 priority_rank, severity, evidence, recommendation FROM ov LEFT JOIN issues i ON check_name = 'duplicates'""",
        "column_view": first_ranked("\"column\" = 'priority'", 3),
        "column_summary": f"""SELECT {q(N)} AS dataset, 'priority' AS "column", 'categorical' AS column_type, count(*) = 0 AS is_clean,
 count(*) AS issue_count, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high,
 count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low,
 (SELECT schema_penalty FROM sp WHERE "column" = 'priority') AS schema_penalty,
 (SELECT category_affected_percentage FROM cb WHERE "column" = 'priority') AS category_affected_percentage,
 (SELECT outlier_percentage FROM ob WHERE "column" = 'priority') AS outlier_percentage FROM issues WHERE "column" = 'priority'""",
        "column_recommendations": first_ranked("\"column\" = 'ref_code'", 10, "rec"),
        "priority_view": first_ranked("severity IN ('CRITICAL', 'HIGH') AND check_name = 'category_consistency'", 5),
        "ml_view": first_ranked("true", 10, extra=f", {ML} AS ml_category"),
        "ml_summary": f"""SELECT i.dataset, {ML} AS ml_category, count(*) AS issue_count,
 count(*) FILTER (WHERE i.severity IN ('CRITICAL', 'HIGH')) AS high_or_critical_count, overall_score, readiness_status,
 'GENERIC_FEATURE_QUALITY_ONLY' AS assessment_scope, {', '.join(f'false AS {n}_assessed' for n in NOT_ASSESSED)}
 FROM issues i JOIN score s ON s.dataset = i.dataset GROUP BY ALL""",
        "component_scores": components,
        "issues_table": """SELECT dataset, priority_rank AS rank, severity, check_name AS "check", issue_type, "column", "count", percentage,
 evidence, recommendation, limitation FROM issues""",
        "write_issues_csv": """SELECT dataset, priority_rank AS rank, severity, check_name AS "check", issue_type, "column", "count", percentage,
 evidence, recommendation, limitation FROM issues""",
        "recommendations_table": """SELECT dataset, priority_rank AS rank, priority_level AS priority, severity, "column", issue_type, action,
 rationale, source_checks, replace(related_issue_ids, ',', ', ') AS related_issues FROM rec""",
        "filter_issues": "SELECT * FROM issues WHERE severity IN ('HIGH', 'CRITICAL') AND \"column\" = 'ref_code'",
    }.items()}
    return out


def oracle_sql() -> dict[str, str]:
    line3 = {"l_partkey": "bigint", "l_suppkey": "bigint", "l_quantity": "double"}
    warn = lambda s: with_base(f"SELECT * FROM ({WARN}) x WHERE status = {q(s)}")
    out = {k: with_base(v) for k, v in CHECK_SQL.items()}
    out |= {
        "file_manifest": f"""SELECT path, regexp_extract(path, '[^/]+$') AS file_name, CAST(CASE WHEN kind = 'latin' THEN strlen(txt) - 1 ELSE strlen(txt) END AS BIGINT) AS file_size_bytes,
 CASE WHEN NOT lower(path) LIKE '%.csv' THEN 'invalid_extension' ELSE {BAD_KIND.format(rest="WHEN 'nul' THEN 'binary_content' WHEN 'twice' THEN 'duplicate_columns'")} END AS code,
 CASE WHEN {HAS_TEXT} THEN delim END AS delimiter, CAST(CASE WHEN {HAS_TEXT} THEN 4 END AS INTEGER) AS column_count,
 CAST(CASE WHEN {HAS_TEXT} THEN 1 END AS INTEGER) AS blank_names FROM ({inputs.FILE_TEXT.format(files=inputs.FILES)}) x""",
        "file_fingerprint": r"""SELECT url AS path, regexp_extract(url, '[^/\\]*$') AS file_name, sha256(html) AS fingerprint_sha256,
 sha256(encode(regexp_extract(url, '[^/\\]*$')) || '\x00'::BLOB || encode(html)) AS file_key FROM pages""",
        "file_encoding": f"SELECT path, CASE WHEN kind = 'latin' THEN 'cp1252' ELSE 'utf-8-sig' END AS encoding, CAST(NULL AS VARCHAR) AS code FROM {FILES}",
        "detect_delimiter": f"""SELECT path, CASE WHEN {HAS_TEXT} THEN delim END AS delimiter,
 CASE WHEN NOT ({HAS_TEXT}) THEN 'empty_file' END AS code FROM {FILES}""",
        "validate_header": f"""SELECT path, CASE WHEN {HAS_TEXT} THEN delim END AS delimiter,
 CASE WHEN {HAS_TEXT} THEN concat('name,', CASE WHEN kind = 'twice' THEN ' NAME' ELSE 'nation' END, ',a ', delim, ' b,') ELSE '' END AS names,
 CAST(CASE WHEN {HAS_TEXT} THEN 4 END AS INTEGER) AS column_count, CAST(CASE WHEN {HAS_TEXT} THEN 1 END AS INTEGER) AS blank_names,
 CASE WHEN kind = 'twice' THEN 'name' ELSE '' END AS repeated_names,
 CASE WHEN NOT ({HAS_TEXT}) THEN 'missing_columns' WHEN kind = 'twice' THEN 'duplicate_columns' END AS code FROM {FILES}""",
        "scan_csv": f"SELECT * EXCLUDE (notes), CAST(notes AS DOUBLE) AS notes FROM ({inputs.DIRTY}) x",
        "load_warnings": f"""SELECT * FROM (SELECT 'empty_columns' AS code, {' + '.join(f'CAST(count({c}) = 0 AS BIGINT)' for c in inputs.COLUMNS)} AS n
 FROM ({inputs.DIRTY}) x) WHERE n > 0""",
        "scan_csv_multi_line": """SELECT page_id, url, length(h)::BIGINT AS chars, sha256(h) AS html_sha256
 FROM (SELECT page_id, url, nullif(html, '') AS h FROM pages)""",
        "folder_columns": _folder(),
        "audit_several": _several(),
        "outliers_lineitem_approx": _approximate(),
        "preview_rows": f"SELECT * FROM ({inputs.DIRTY}) x ORDER BY order_id LIMIT 25",
        "value_frequencies": with_base(f"SELECT {q(N)} AS dataset, v.col AS \"column\", val AS value, n FROM v JOIN t ON t.col = v.col AND dtype = 'string'"),
        "numeric_like_text": warn("NUMERIC_LIKE_TEXT"),
        "mixed_datetime_formats": warn("MIXED_DATETIME_FORMATS"),
        "basic_checks": with_base(_findings(CHECKS[:3])),
        "advanced_checks": with_base(_findings(CHECKS[3:])),
        "all_checks": with_base(_findings(CHECKS)),
        "duplicates_lineitem": with_base(copies("lineitem", line3, None), "lineitem", line3),
        "identifiers_documents": with_base(identifiers("documents"), "documents"),
        "identifiers_customer": with_base(identifiers("customer"), "customer"),
        "cardinality_documents": with_base(cardinality("documents"), "documents"),
        "category_documents": with_base(category("documents", brief=True), "documents"),
        "outliers_events": with_base(outliers("events", TYPES["events"]), "events"),
        "outliers_documents": with_base(outliers("documents", TYPES["documents"]), "documents"),
        "outliers_lineitem": with_base(outliers("lineitem", TYPES["lineitem"]), "lineitem"),
        "near_constant_labels": with_base(near_constant("labels"), "labels"),
        "issue_type_impact": with_base(f'SELECT dataset, "column", status, {IMPACT} AS impact_percentage FROM ({WARN}) x'),
        "missing_values_documents_dirty": with_base(missing(inputs.DOCS_NAME), inputs.DOCS_NAME),
        "near_constant_documents_dirty": with_base(near_constant(inputs.DOCS_NAME), inputs.DOCS_NAME),
        "outliers_documents_dirty": with_base(outliers(inputs.DOCS_NAME, inputs.DOCS_COLUMNS), inputs.DOCS_NAME),
        "category_documents_dirty": with_base(category(inputs.DOCS_NAME, keyed=True), inputs.DOCS_NAME),
        "unnamed_columns": with_base(f"""SELECT {q(inputs.DOCS_NAME)} AS dataset, col AS "column", dtype, 'UNNAMED_COLUMN' AS status,
 'MEDIUM' AS severity, 'INDEX_ARTIFACT' AS inferred_type, nn AS non_null_count, CAST(NULL AS BIGINT) AS parse_success_count,
 CAST(NULL AS DOUBLE) AS parse_success_percentage, CAST(NULL AS BIGINT) AS invalid_count, CAST(NULL AS DOUBLE) AS invalid_percentage,
 CAST(NULL AS INTEGER) AS detected_format_count, '' AS detected_formats, '' AS example_invalid_values,
 {q(ADVICE['UNNAMED_COLUMN'])} AS recommendation FROM f WHERE lower(col) LIKE 'unnamed:%'""", inputs.DOCS_NAME),
        "datetime_like_text": with_base(f"""SELECT {q(inputs.DOCS_NAME)} AS dataset, 'seen' AS "column", 'string' AS dtype,
 'DATETIME_LIKE_TEXT' AS status, 'MEDIUM' AS severity, 'DATETIME' AS inferred_type, count(*) AS non_null_count, count(*) FILTER (WHERE ok) AS parse_success_count,
 {pct('count(*) FILTER (WHERE ok)', 'count(*)')} AS parse_success_percentage, count(*) FILTER (WHERE NOT ok) AS invalid_count,
 {pct('count(*) FILTER (WHERE NOT ok)', 'count(*)')} AS invalid_percentage, CAST(1 AS INTEGER) AS detected_format_count,
 'YYYY/MM/DD' AS detected_formats, 'soon' AS example_invalid_values, {q(ADVICE['DATETIME_LIKE_TEXT'])} AS recommendation
FROM (SELECT regexp_full_match(seen, '[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}') AS ok FROM d)""", inputs.DOCS_NAME),
        "trim_conversations": """SELECT conv_id, turn, role, text FROM (SELECT *, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS s
 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i FROM conversations) WHERE i <= 3) WHERE turn >= s""",
    }
    return out | chain_queries()
