"""CSV intake: file rules, format detection, header rules and the typed scan.

The file operators take a frame with one row per file and return one row per
file: facts of a folder's files (``read_files``), or files that are rows of a
table (``path``, ``length``, ``content``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..config import AuditError, IntakeConfig
from ..functions import text as X
from ..functions.stage import small, stage
from ..operators.profile import SLICE, check_names, quoted
from .records import Formats, read_records
from .streams import content_facts, file_name, path_facts

# Texts that a CSV cell may hold for a missing value.
MISSING_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                 "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# Windows-1252 characters of the bytes 0x80 to 0x9F, and its unused bytes.
CP1252_UNUSED = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
CP1252_CHARS = "".join(bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in CP1252_UNUSED)
CP1252_BYTES = "".join(chr(b) for b in range(0x80, 0xA0) if b not in CP1252_UNUSED)

# Encodings that Spark's own CSV reader is used for, as long as no quoted field holds a line end.
DIRECT = ("utf-8-sig", "utf-8", "cp1252", "latin-1")


def read_files(spark: SparkSession, path: str, config: IntakeConfig = IntakeConfig()) -> DataFrame:
    """The facts of every file below ``path``, of any length, each streamed once. Spark does not list files without bytes."""
    return path_facts(spark, path, config)


def _facts(files: DataFrame, config: IntakeConfig) -> DataFrame:
    return files if "lines" in files.columns else content_facts(files, config)


def file_fingerprint(files: DataFrame) -> DataFrame:
    """SHA-256 of the bytes, and of name and bytes together."""
    return _facts(files, IntakeConfig()).select("path", file_name(F.col("path")).alias("file_name"), "fingerprint_sha256", "file_key")


def file_encoding(files: DataFrame, config: IntakeConfig = IntakeConfig()) -> DataFrame:
    """The first of the encodings that reads all bytes; a name that is no text encoding reads none."""
    return _facts(files, config).select(
        "path", "encoding", F.when(F.col("nul").isNotNull() & F.col("encoding").isNull(), "unsupported_encoding").alias("code"))


def delimiter_of(lines: Column, delimiters=IntakeConfig.delimiters) -> Column:
    """The delimiter that splits the lines most evenly.

    Delimiters outside quotes are counted per line. One that occurs as often as
    in the header in the most lines wins, then the one with the higher count.
    A head without any falls back to the first delimiter.
    """
    bare = F.transform(lines, lambda x: F.regexp_replace(x, '"[^"]*"', ""))

    def score(place: int, delimiter: str) -> Column:
        counts = F.transform(bare, lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit(delimiter), F.lit(""))))
        header = F.get(counts, F.lit(0))
        even = F.size(F.filter(counts, lambda n: (n > 0) & (n == header)))
        return F.struct(even.alias("even"), header.alias("header"), F.lit(-place).alias("place"), F.lit(delimiter).alias("delimiter"))

    scores = [score(i, d) for i, d in enumerate(delimiters)]
    return F.when(F.size(lines) > 0, F.array_max(F.array(*scores))["delimiter"])


def header_names(line: Column, delimiter: Column) -> Column:
    """Names of a header line; quoted names may hold the delimiter."""
    split = F.regexp_extract_all(
        F.concat(delimiter, line),
        F.concat(F.lit(r"\Q"), delimiter, F.lit(r'\E("(?:[^"]|"")*"|[^"\Q'), delimiter, F.lit(r"\E]*)")), F.lit(1))
    return F.transform(split, lambda x: F.when(
        x.startswith('"') & (F.char_length(x) > 1),
        F.replace(F.substring(x, F.lit(2), F.char_length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def _with_head(files: DataFrame, config: IntakeConfig) -> DataFrame:
    """File facts with delimiter and names, from the first lines; all null where the content is."""
    step = _facts(files, config).withColumn("delimiter", delimiter_of(F.col("lines"), config.delimiters))
    return step.withColumn("names", header_names(F.get("lines", F.lit(0)), F.col("delimiter")))


def bag_digest(digests: Column) -> Column:
    """One digest of many hexadecimal ones, whatever their order: SHA-256 over the sums of their 60-bit pieces."""
    pieces = [F.conv(F.substring(digests, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    return F.sha2(F.concat_ws(",", *[F.sum(p).cast("string") for p in pieces]), 256)


def detect_delimiter(files: DataFrame, config: IntakeConfig = IntakeConfig()) -> DataFrame:
    return _with_head(files, config).select("path", "delimiter", F.when(F.size("lines") == 0, "empty_file").alias("code"))


def _header(heads: DataFrame, config: IntakeConfig) -> DataFrame:
    folded = F.transform("names", lambda x: X.casefold(X.strip(x)))
    repeated = F.filter(F.array_distinct("folded"), lambda x: (x != "") & (
        F.size(F.filter("folded", lambda y: y == x)) > 1))
    out = (heads.withColumn("folded", folded)
           .withColumn("column_count", F.when(F.col("names").isNotNull(), F.size("names")))
           .withColumn("blank_names", F.when(F.col("names").isNotNull(), F.size(F.filter("folded", lambda x: x == ""))))
           .withColumn("repeated_names", F.array_sort(repeated)))
    too_many = F.lit(False) if config.max_columns is None else F.col("column_count") > config.max_columns
    return out.withColumn("header_code", F.when(F.size("lines") == 0, "missing_columns")
                          .when(F.size("repeated_names") > 0, "duplicate_columns")
                          .when(too_many, "too_many_columns"))


def validate_header(files: DataFrame, config: IntakeConfig = IntakeConfig()) -> DataFrame:
    """Header names, blank names and repeated names of every file.

    The raw line is looked at, because a CSV reader renames repeated columns.
    """
    return _header(_with_head(files, config), config).select(
        "path", "delimiter", "names", "column_count", "blank_names", "repeated_names", F.col("header_code").alias("code"))


def _judged(facts: DataFrame, config: IntakeConfig) -> DataFrame:
    heads = _header(facts, config)
    name, length = file_name(F.col("path")), F.col("length")
    too_large = F.lit(False) if config.max_bytes is None else length > config.max_bytes
    code = (F.when(~F.lower(name).rlike(r"(?s).\.csv\z"), "invalid_extension")
            .when(length == 0, "empty_file")
            .when(too_large, "file_too_large")
            .when(F.col("nul"), "binary_content")
            .when(F.col("nul").isNotNull() & F.col("encoding").isNull(), "unsupported_encoding")
            .when(F.size("lines") == 0, "empty_file")
            .otherwise(F.col("header_code")))
    return heads.select("path", name.alias("file_name"), length.alias("file_size_bytes"), "encoding",
                        "fingerprint_sha256", code.alias("code"), "delimiter", "column_count",
                        "blank_names", "names")


def file_manifest(files: DataFrame, config: IntakeConfig = IntakeConfig()) -> DataFrame:
    """One row per file: its facts and the code of the first rule it breaks."""
    return _judged(_with_head(files, config), config).drop("names")


# ---- typed scan ------------------------------------------------------------

_ROW_END = "\x01end"
# Where a row comes from: its file and the start of the block of it that was read.
PLACE = ("_file", "_block")


@dataclass(frozen=True)
class CsvFormat:
    names: tuple[str, ...]
    delimiter: str
    encoding: str


def detect_format(spark: SparkSession, path: str, config: IntakeConfig = IntakeConfig()) -> CsvFormat:
    """The common format of the files below ``path``; raises on the first broken rule."""
    return common_format(manifest_of(spark, path, config), path)


def manifest_of(spark: SparkSession, path: str, config: IntakeConfig = IntakeConfig()) -> DataFrame:
    """The staged manifest of the files below ``path``, with their ``names``."""
    return stage(_judged(_with_head(read_files(spark, path, config), config), config))


def common_format(manifest: DataFrame, path: str) -> CsvFormat:
    """The one format of all files of a manifest."""
    broken = manifest.filter("code IS NOT NULL").orderBy("path").select("file_name", "code").first()
    if broken:
        raise AuditError(f"{broken['file_name']}: {broken['code']}", broken["code"])
    known = manifest.filter("names IS NOT NULL")
    heads = known.select("names", "delimiter").distinct().limit(2).collect()  # at most two header lines
    if not heads:
        raise AuditError(f"no file below {path} shows its header", "empty_file")
    if len(heads) > 1:
        raise AuditError("the files do not share one header", "header_mismatch")
    kinds = [r["encoding"] for r in known.select("encoding").distinct().limit(2).collect()]
    if len(kinds) > 1:
        raise AuditError("the files do not share one encoding", "encoding_mismatch")
    names = [n if n.strip() else f"Unnamed: {i}" for i, n in enumerate(heads[0]["names"])]
    return CsvFormat(tuple(names), heads[0]["delimiter"], kinds[0])


def read_text_columns(spark: SparkSession, path: str, fmt: CsvFormat, multi_line: bool = False) -> DataFrame:
    """All cells as text, missing texts as null, with ``_ord`` and ``_overflow``.

    ``_overflow`` marks rows with more fields than the header has. With
    ``multi_line``, and for encodings other than DIRECT, records are cut first,
    blocks of files side by side, and staged.
    """
    refs = [f"c{i}" for i in range(len(fmt.names))]
    schema = T.StructType([T.StructField(r, T.StringType()) for r in [*refs, "_bad"]])
    if multi_line or fmt.encoding not in DIRECT:
        options = {"sep": fmt.delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "multiLine": "true"}
        records = read_records(spark, path, Formats.one(fmt.delimiter, fmt.encoding))
        raw = records.withColumn("row", F.from_csv("record", schema.toDDL(), options)).select(
            "row.*", F.lit("").alias(PLACE[0]), F.col("rank").alias(PLACE[1]), "n")
        order = F.shiftleft(PLACE[1], 32) + F.col("n")
    else:
        raw, order = _read_lines(spark, path, fmt, schema), F.monotonically_increasing_id()
    # A row that does not fit is parsed once more with a mark behind its last
    # field: within the header's width the mark stays visible.
    probe = ", ".join(f"{r} STRING" for r in refs)
    marked = F.from_csv(F.concat("_bad", F.lit(fmt.delimiter + _ROW_END)), probe,
                        {"sep": fmt.delimiter, "quote": '"', "escape": '"', "multiLine": "true"})
    shown = F.array_contains(F.array(*[marked[r] for r in refs]), _ROW_END)
    overflow = F.col("_bad").isNotNull() & ~F.coalesce(shown, F.lit(False))
    cells = [F.when(~F.col(r).isin(*MISSING_TEXTS), F.col(r)).alias(r) for r in refs]
    return raw.select(*cells, overflow.alias("_overflow"), order.alias("_ord"), *PLACE)


def _read_lines(spark: SparkSession, path: str, fmt: CsvFormat, schema: T.StructType) -> DataFrame:
    """Cells of files in which every line is a record, by Spark's own reader."""
    place = ["_metadata.file_path", "_metadata.file_block_start"]
    raw = (spark.read.schema(schema).option("header", True).option("sep", fmt.delimiter)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
           .option("quote", '"').option("escape", '"')
           .option("encoding", "UTF-8" if fmt.encoding.startswith("utf-8") else "ISO-8859-1")
           .option("recursiveFileLookup", "true").csv(path)
           .select("*", *[F.col(c).alias(a) for c, a in zip(place, PLACE)]))
    if fmt.encoding == "cp1252":
        raw = raw.select(*[F.translate(c, CP1252_BYTES, CP1252_CHARS).alias(c) for c in schema.fieldNames()], *PLACE)
    return raw


def with_positions(rows: DataFrame) -> DataFrame:
    """``rows`` of a staged scan with ``_ord`` as the position of a row from 0: files by path, rows as they stand in them.

    The rows of a block of a file are numbered without gaps already, so only one row a block is summed up.
    """
    blocks = stage(rows.groupBy(*PLACE).agg(F.min("_ord").alias("_first"), F.count(F.lit(1)).alias("_rows")))
    before = F.sum("_rows").over(W.orderBy(*PLACE).rowsBetween(W.unboundedPreceding, -1))
    starts = blocks.select(*PLACE, "_first", F.coalesce(before, F.lit(0)).alias("_start"))
    placed = rows.join(small(starts, blocks.count(), 1024), list(PLACE))
    kept = [quoted(c) for c in rows.columns if c not in ("_ord", *PLACE)]
    return placed.select(*kept, (F.col("_start") + F.col("_ord") - F.col("_first")).alias("_ord"))


def quoted_line_ends(spark: SparkSession, path: str) -> bool:
    """Whether some line has an odd number of quotes, by a split scan."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not lines.filter(quotes % 2 == 1).isEmpty()


def type_counts(ref: str) -> list[Column]:
    """How many values a text column has, and how many of them read as whole numbers, numbers and truth values."""
    text = F.col(ref)
    bare = X.strip(text)
    whole = bare.rlike(r"^[+-]?\d+\z") & bare.try_cast("long").isNotNull()
    return [F.count(text).alias(f"{ref}_n"), F.count_if(whole).alias(f"{ref}_int"),
            F.count_if(X.is_number(bare)).alias(f"{ref}_num"),
            F.count_if(text.isin("true", "false", "TRUE", "FALSE", "True", "False")).alias(f"{ref}_bool")]


def number_value(text: Column, kind: str) -> Column:
    """A text as a value of the type its column was found to have."""
    bare = X.strip(text)
    if kind == "long":
        return bare.cast("long")
    if kind == "double":
        return (F.when(bare.rlike(X.INFINITY), F.when(bare.startswith("-"), F.lit(float("-inf")))
                       .otherwise(F.lit(float("inf")))).otherwise(bare.try_cast("double")))
    return F.lower(text) == "true" if kind == "boolean" else text


@dataclass(frozen=True)
class CsvTable:
    """A typed table with ``_ord`` as its row order, and the facts of its scan."""

    table: DataFrame
    format: CsvFormat
    row_count: int
    empty_columns: tuple[str, ...]
    placed: DataFrame

    def warnings(self) -> DataFrame:
        return load_warnings(self.table.sparkSession, self)

    def facts(self, manifest: DataFrame, path: str, dataset: str) -> DataFrame:
        """One row of what a report says of the files: the file's own facts, or those of a folder as a whole.

        A folder's fingerprint is a digest of its files' names and fingerprints.
        """
        prints = F.when(F.count(F.lit(1)) == 1, F.max("fingerprint_sha256")).otherwise(
            bag_digest(F.sha2(F.concat_ws("|", "file_name", "fingerprint_sha256"), 256)))
        folder = path.rstrip("/").replace("\\", "/").rsplit("/", 1)[-1]
        name = F.when(F.count(F.lit(1)) == 1, F.max("file_name")).otherwise(F.lit(folder))
        codes = F.array(*[F.lit(code) for code, _ in warning_counts(self)]).cast("array<string>")
        return manifest.agg(
            F.lit(dataset).alias("dataset"), name.alias("file_name"), F.sum("file_size_bytes").alias("file_size_bytes"),
            F.lit(self.format.encoding).alias("encoding"), F.lit(self.format.delimiter).alias("delimiter"),
            prints.alias("fingerprint_sha256"), codes.alias("warnings"), F.lit(self.row_count).cast("long").alias("row_count"),
            F.lit(len(self.format.names)).cast("long").alias("column_count"))


def scan_csv(spark: SparkSession, path: str, config: IntakeConfig = IntakeConfig(), *,
             fmt: CsvFormat | None = None, multi_line: bool | None = None) -> CsvTable:
    """Read one table of CSV files with types inferred over all its rows.

    Where some line has an odd number of quotes, a quoted field may hold a line
    end, and blocks are cut at true record ends; ``multi_line`` skips this look
    at the lines. Either way a file is read by as many tasks as it has blocks.
    """
    fmt = fmt or detect_format(spark, path, config)
    check_names(list(fmt.names))
    if multi_line is None:
        multi_line = fmt.encoding not in DIRECT or quoted_line_ends(spark, path)
    text = read_text_columns(spark, path, fmt, multi_line)
    refs = [f"c{i}" for i in range(len(fmt.names))]
    facts: dict = {}
    for i in range(0, len(refs), SLICE):
        row = text.agg(F.count(F.lit(1)).alias("rows"), F.count_if("_overflow").alias("overflow"),
                       *[a for r in refs[i:i + SLICE] for a in type_counts(r)]).first()
        facts.update(row.asDict())
    if facts["overflow"]:
        raise AuditError(f"{facts['overflow']} rows have more fields than the header", "parser_error")
    if config.max_rows is not None and facts["rows"] > config.max_rows:
        raise AuditError(f"more than {config.max_rows} rows", "too_many_rows")
    if not facts["rows"]:
        raise AuditError("the files hold a header but no rows", "no_data_rows")
    if not any(facts[f"{r}_n"] for r in refs):
        raise AuditError("every row is empty", "all_rows_empty")

    columns = []
    for r, name in zip(refs, fmt.names):
        n = facts[f"{r}_n"]
        kind = ("double" if n == 0 else "long" if facts[f"{r}_int"] == n else "double" if facts[f"{r}_num"] == n
                else "boolean" if facts[f"{r}_bool"] == n else "string")
        columns.append(number_value(F.col(r), kind).alias(name))
    placed = text.select(*columns, "_ord", *PLACE)
    empty = tuple(name for r, name in zip(refs, fmt.names) if not facts[f"{r}_n"])
    return CsvTable(placed.drop(*PLACE), fmt, facts["rows"], empty, placed)


WARNING_SCHEMA = "code string, n long"


def warning_counts(scan: CsvTable) -> list[tuple[str, int]]:
    """What the scan noticed: the kinds of warning with their counts."""
    unnamed = [n for n in scan.format.names if n.strip().casefold().startswith("unnamed:")]
    blank = [n for i, n in enumerate(scan.format.names) if n == f"Unnamed: {i}"]
    found = [("blank_header_names", len(blank)),
             ("fallback_encoding", int(not scan.format.encoding.startswith("utf-8"))),
             ("unnamed_columns", len(unnamed)),
             ("single_column", int(len(scan.format.names) == 1)),
             ("empty_columns", len(scan.empty_columns))]
    return [f for f in found if f[1]]


def load_warnings(spark: SparkSession, scan: CsvTable) -> DataFrame:
    """One row per kind of warning with its count."""
    return spark.createDataFrame(warning_counts(scan), WARNING_SCHEMA)


def table_warnings(df: DataFrame, hidden: tuple[str, ...] = ("_ord",)) -> DataFrame:
    """The same warnings for a table that is already loaded, by one aggregate."""
    names = [c for c in df.columns if c not in hidden]
    unnamed = sum(n.strip().casefold().startswith("unnamed:") for n in names)
    empty = sum((F.count(quoted(n)) == 0).cast("long") for n in names)
    rows = F.array(F.struct(F.lit("unnamed_columns").alias("code"), F.lit(unnamed).cast("long").alias("n")),
                   F.struct(F.lit("single_column").alias("code"), F.lit(int(len(names) == 1)).cast("long").alias("n")),
                   F.struct(F.lit("empty_columns").alias("code"), empty.alias("n")))
    return df.agg(rows.alias("w")).select(F.inline("w")).filter("n > 0")

