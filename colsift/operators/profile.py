"""The profile of one table: facts that several checks share.

Facts are one row per column. They come from aggregates over the whole table,
are read once and steer what the later passes have to look at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from threading import Lock

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import AuditError, CheckConfig
from ..functions import quantiles as Q
from ..functions import text as X
from ..functions.measures import py_pct
from ..functions.stage import TOKEN_ROW, small, stage

# columns per aggregate; wider tables are profiled in several column slices
SLICE = 80
# columns per multi-distinct aggregate, which copies a row once per column
DISTINCT_SLICE = 12
# relative standard error of sketched distinct counts, and how many of them an exact count is taken to be away at most
HLL_ERROR = 0.01
SIGMAS = 6
# a frequent-item summary has at most the inverse of this many counters a column
LEAST_SUPPORT = 0.002
# a text column whose values repeat in at most this share of the rows tells which rows may be duplicates
REPEATED_SHARE = 0.2
# share from which the dominant value must be the median
MEDIAN_SHARE = 51.0
# share from which the dominant value must be both quartiles
QUARTILE_SHARE = 80.0
ORD = "_ord"


def column_group(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "categorical"
    return "other"


@dataclass(frozen=True)
class ColumnInfo:
    position: int
    name: str
    kind: T.DataType

    @property
    def ref(self) -> str:
        return f"c{self.position}"

    @property
    def dtype(self) -> str:
        return self.kind.simpleString()

    @property
    def group(self) -> str:
        return column_group(self.kind)

    @property
    def name_hint(self) -> bool:
        return X.has_identifier_name(self.name)


def slices(columns: list, size: int = SLICE) -> list[list]:
    return [columns[i:i + size] for i in range(0, len(columns), size)]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def check_names(names: list[str]) -> None:
    if not names:
        raise AuditError("the table has no columns", "no_columns")
    folded = [n.strip().casefold() for n in names]
    twice = sorted({n for n in folded if folded.count(n) > 1})
    if twice:
        raise AuditError(f"column names repeat: {', '.join(twice)}", "duplicate_columns")


def column_types(df: DataFrame, hidden: tuple[str, ...] = ()) -> list[ColumnInfo]:
    fields = [f for f in df.schema.fields if f.name not in hidden]
    return [ColumnInfo(i, f.name, f.dataType) for i, f in enumerate(fields)]


class TableProfile:
    """Facts about ``df``, computed on first use.

    ``order_by`` names the columns that define row order for "first" examples;
    ``row_id`` names one column with that role which is not itself audited.
    Without either, examples come in value order. ``reuse`` says that several
    checks will follow, so that all text checks read one staged table.
    """

    def __init__(self, df: DataFrame, dataset: str = "table", *, order_by=None,
                 row_id: str | None = None, config: CheckConfig | None = None,
                 reuse: bool = False) -> None:
        self.spark = df.sparkSession
        self.dataset = dataset
        self.config = config or CheckConfig()
        self.reuse = reuse
        self._lock = Lock()
        self._facts_lock = Lock()
        self._distinct: dict[str, int] = {}
        self._staged: DataFrame | None = None
        self.columns = column_types(df, (row_id,) if row_id else ())
        check_names([c.name for c in self.columns])
        keys = [row_id] if row_id else ([order_by] if isinstance(order_by, str) else list(order_by or ()))
        self.ordered = bool(keys)
        order = []
        if keys:
            cols = [quoted(k) for k in keys]
            order = [(cols[0] if len(cols) == 1 else F.struct(*cols)).alias(ORD)]
        self.frame = df.select(*[self._clean(c).alias(c.ref) for c in self.columns], *order)

    @staticmethod
    def _clean(c: ColumnInfo) -> Column:
        """The column with NaN turned into a missing value."""
        col = quoted(c.name)
        if isinstance(c.kind, (T.FloatType, T.DoubleType)):
            return F.when(~F.isnan(col), col)
        if isinstance(c.kind, (T.CharType, T.VarcharType)):
            return col.cast("string")
        if isinstance(c.kind, T.StringType) and c.kind.collation != "UTF8_BINARY":
            return F.collate(col, "UTF8_BINARY")  # values are told apart by their bytes
        return col

    def of_group(self, *groups: str) -> list[ColumnInfo]:
        return [c for c in self.columns if c.group in groups]

    # ---- pass 1: counts and extremes ------------------------------------

    def _count_aggregates(self, c: ColumnInfo) -> list[str]:
        ref = c.ref
        out = [f"count({ref}) AS {ref}_n"]
        if c.group in ("numeric", "datetime", "boolean"):
            out += [f"min({ref}) <=> max({ref}) AS {ref}_same", f"CAST(min({ref}) AS STRING) AS {ref}_text"]
        if c.group == "numeric":
            out += [f"min({self.finite_sql(c)}) AS {ref}_min", f"max({self.finite_sql(c)}) AS {ref}_max"]
            if isinstance(c.kind, T.IntegralType):
                out.append(f"CAST(max({ref}) AS DECIMAL(20,0)) - CAST(min({ref}) AS DECIMAL(20,0)) + 1 AS {ref}_range")
            if isinstance(c.kind, (T.FloatType, T.DoubleType)):
                out += [f"count_if({ref} = double('inf')) AS {ref}_pinf", f"count_if({ref} = double('-inf')) AS {ref}_ninf"]
        elif c.group == "boolean":
            out.append(f"count_if({ref}) AS {ref}_true")
        return out

    @cached_property
    def counts(self) -> dict:
        facts: dict = {}
        for part in slices(self.columns):
            texts = [F.max(X.is_long(F.col(c.ref))).alias(f"{c.ref}_long") for c in part if c.group == "categorical"]
            row = self.frame.agg(F.count(F.lit(1)).alias("rows"),
                                 *[F.expr(a) for c in part for a in self._count_aggregates(c)], *texts).first()
            facts.update(row.asDict())
        if facts["rows"] == 0:
            raise AuditError("the table has no rows", "no_rows")
        return facts

    @property
    def rows(self) -> int:
        return self.counts["rows"]

    def non_null(self, c: ColumnInfo) -> int:
        return self.counts[f"{c.ref}_n"]

    def infinite(self, c: ColumnInfo) -> int:
        return (self.counts.get(f"{c.ref}_pinf") or 0) + (self.counts.get(f"{c.ref}_ninf") or 0)

    @staticmethod
    def finite_sql(c: ColumnInfo) -> str:
        value = f"CAST({c.ref} AS DOUBLE)"
        if isinstance(c.kind, (T.FloatType, T.DoubleType)):
            return f"IF(abs({value}) < double('inf'), {value}, NULL)"
        return value

    @classmethod
    def finite(cls, c: ColumnInfo) -> Column:
        return F.expr(cls.finite_sql(c))

    def is_constant(self, c: ColumnInfo) -> bool:
        """One distinct value, for every group but ``other``."""
        if c.group == "categorical":
            return bool(self.non_null(c)) and self.text_counts[c.ref]["unique"] == 1
        return self.non_null(c) > 0 and bool(self.counts.get(f"{c.ref}_same"))

    # ---- distinct values of text columns --------------------------------

    def text_columns(self) -> list[ColumnInfo]:
        return [c for c in self.of_group("categorical") if self.non_null(c)]

    @property
    def values(self) -> DataFrame | None:
        """Distinct values of all text columns with their row counts.

        Columns: column, token, n, first_ord when rows are ordered. Long values
        are digests, so what depends on their whole text is worked out before
        grouping and kept beside the token.
        """
        with self._lock:  # checks may run side by side
            if self._staged is None and self.text_columns():
                self._staged = stage(self._distinct_values(whole=True))
        return self._staged

    @cached_property
    def tokens(self) -> DataFrame | None:
        """``values`` without the properties of long text, unless those are kept anyway."""
        return self.values if self.reuse else self._distinct_values(whole=False)

    def _distinct_values(self, whole: bool) -> DataFrame | None:
        text = self.text_columns()
        if not text:
            return None
        refs = [c.ref for c in text]
        ids = [ORD] if self.ordered else []
        # grouped by the column's place, which is cheaper to hash than its name
        cells = (self.frame.select(*ids, F.posexplode(F.array(*refs)).alias("at", "value"))
                 .filter(F.col("value").isNotNull()))
        keys = ["at", "token"]
        value = F.col("value")
        has_long = any(self.counts[f"{r}_long"] for r in refs)
        if has_long and not whole:
            cells = cells.select(*ids, "at", X.token(value).alias("token"))
        elif has_long:
            long_text = F.when(X.is_long(value), value)
            shown = F.col("value_like")
            cells = (cells.select(*ids, "at", "value", X.strip(long_text).alias("s"))
                     .select(*ids, "at", "value", "s", X.squeeze(F.col("s")).alias("p"),
                             X.may_be_value(F.col("s")).alias("value_like"))
                     .select(*ids, "at", "value", "s", "p", X.casefold(F.col("p")).alias("k"), "value_like")
                     .select(*ids, "at", X.token(value).alias("token"),
                             X.token(F.col("s")).alias("long_strip"),
                             X.token(F.col("p")).alias("long_plain"),
                             X.token(F.col("k")).alias("long_key"),
                             (shown & X.is_number(F.col("s"))).alias("long_number"),
                             F.when(shown, X.date_label(F.col("s"))).alias("long_date")))
            keys += ["long_strip", "long_plain", "long_key", "long_number", "long_date"]
        else:
            cells = cells.withColumnRenamed("value", "token")
        first = [F.min(ORD).alias("first_ord")] if self.ordered else []
        found = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *first)
        return found.select(F.element_at(F.array(*[F.lit(r) for r in refs]), F.col("at") + 1).alias("column"), *found.columns[1:])

    @property
    def has_long_text(self) -> bool:
        return "long_key" in self.values.columns

    def derived(self, name: str, from_token: Column) -> Column:
        """A property of the value: kept from before grouping for long text,
        worked out on the distinct token otherwise."""
        if not self.has_long_text:
            return from_token
        return F.when(X.is_digest(F.col("token")), F.col(f"long_{name}")).otherwise(from_token)

    def stripped_values(self) -> DataFrame:
        """``values`` with the stripped text, whether it is a number, and its date format. Each step is a column, so that it is
        worked out once; most values are settled by two patterns."""
        token, strip = F.col("token"), F.col("strip")
        stripped = self.values.withColumn("strip", self.derived("strip", F.when(X.is_plain(token), token).otherwise(X.strip(token))))
        return (stripped.withColumn("value_like", X.may_be_value(strip))
                .withColumn("number", self.derived("number", F.col("value_like") & X.is_number(strip)))
                .withColumn("date", self.derived("date", F.when(F.col("value_like"), X.date_label(strip)))))

    def first_seen(self, other: str = "token") -> list[Column]:
        return [F.col("first_ord"), F.col(other)] if self.ordered else [F.col(other)]

    @property
    def text_facts(self) -> dict[str, dict]:
        """Per text column: distinct values, top count, number and date counts."""
        with self._facts_lock:  # checks may run side by side
            if "_text_facts" not in self.__dict__:
                self._text_facts = self._count_texts()
        return self._text_facts

    def _count_texts(self) -> dict[str, dict]:
        if self.values is None:
            return {}
        seen = self.stripped_values().select("column", "n", (F.col("strip") == "").alias("blank"), "number", "date")
        labels = [F.sum(F.when(F.col("date") == name, F.col("n"))).alias(name) for name in X.DATE_PATTERNS]
        facts = seen.groupBy("column").agg(
            F.count(F.lit(1)).alias("unique"), F.count_if(F.col("n") == 1).alias("single"), F.max("n").alias("top"),
            F.sum(F.when(~F.col("blank"), F.col("n")).otherwise(0)).alias("filled"),
            F.sum(F.when(F.col("number"), F.col("n")).otherwise(0)).alias("numbers"), *labels)
        return {r["column"]: r.asDict() for r in facts.collect()}  # one row per column

    @cached_property
    def text_counts(self) -> dict[str, dict]:
        """Per text column: number of distinct values and count of the top one."""
        if self.reuse or "_text_facts" in self.__dict__ or self.tokens is None:
            return self.text_facts
        found = self.tokens.groupBy("column").agg(F.count(F.lit(1)).alias("unique"), F.max("n").alias("top"))
        return {r["column"]: r.asDict() for r in found.collect()}  # one row per column

    def telling_text(self) -> ColumnInfo | None:
        """The text column without missing values whose values repeat in the fewest rows, if these are few; only where values are grouped anyway."""
        if not self.reuse:
            return None
        repeats = {c: self.rows - self.text_facts[c.ref]["single"] for c in self.text_columns() if self.non_null(c) == self.rows}
        best = min(repeats, key=repeats.get, default=None)
        return best if best and repeats[best] <= REPEATED_SHARE * self.rows else None

    def whole_text(self, needed: DataFrame) -> DataFrame:
        """Full text for ``needed`` (column, token) pairs that are digests."""
        refs = [c.ref for c in self.text_columns() if self.counts[f"{c.ref}_long"]]
        needed = needed.filter(X.is_digest(F.col("token"))).select("column", "token").distinct()
        cells = (self.frame.select(*refs).unpivot([], refs, "column", "text")
                 .filter(X.is_long(F.col("text"))).withColumn("token", X.token(F.col("text"))))
        needed = stage(needed)
        return (cells.join(small(needed, needed.count(), TOKEN_ROW), ["column", "token"], "left_semi")
                .groupBy("column", "token").agg(F.any_value("text").alias("text")))

    # ---- distinct counts -------------------------------------------------

    def unique_counts(self, columns: list[ColumnInfo], group: bool = True) -> dict[str, int]:
        """Exact number of distinct non-missing values; with ``group`` off, values of text columns are not grouped for it."""
        out, ask = {}, []
        for c in columns:
            if not self.non_null(c):
                out[c.ref] = 0
            elif c.group == "categorical" and (group or self._grouped):
                out[c.ref] = self.text_counts[c.ref]["unique"]
            elif c.group == "boolean" or (c.group != "categorical" and self.is_constant(c)):
                out[c.ref] = 1 if self.is_constant(c) else 2
            elif c.ref in self._distinct:
                out[c.ref] = self._distinct[c.ref]
            else:
                ask.append(c)
        for part in slices([c for c in ask if c.ref not in self._distinct], DISTINCT_SLICE):
            row = self.frame.agg(*[F.count_distinct(c.ref).alias(c.ref) for c in part]).first()
            self._distinct.update(row.asDict())
        return out | {c.ref: self._distinct[c.ref] for c in ask}

    def most_unique(self, c: ColumnInfo) -> int:
        """An upper bound on the distinct count that needs no pass of its own."""
        bound = self.non_null(c)
        width = self.counts.get(f"{c.ref}_range")
        return bound if width is None else min(bound, int(width))

    def may_reach(self, columns: list[ColumnInfo], share: float) -> list[ColumnInfo]:
        """The columns whose distinct values may be ``share`` per cent of their non-missing ones.

        Sketches of one pass settle those that are ``SIGMAS`` standard errors below it; only the others need an exact count, which
        copies a row once per column and shuffles every value.
        """
        room = [c for c in columns if self.most_unique(c) / self.non_null(c) * 100 >= share - 0.01]
        if len(room) < 2:
            return room  # one exact count costs no more than its sketch
        kept = []
        for part in slices(room):
            near = self.frame.agg(*[F.approx_count_distinct(c.ref, HLL_ERROR).alias(c.ref) for c in part]).first()
            kept += [c for c in part if near[c.ref] * (1 + SIGMAS * HLL_ERROR) / self.non_null(c) * 100 >= share - 0.01]
        return kept

    # ---- quartiles and dominant values of other columns -------------------

    @cached_property
    def quartiles(self) -> dict[str, list[float]]:
        """First and third quartile of the finite values of numeric columns."""
        asked = [c for c in self.of_group("numeric") if self.non_null(c) > self.infinite(c)]
        same = {c.ref: [self.counts[f"{c.ref}_min"]] * 2 for c in asked
                if self.counts[f"{c.ref}_min"] == self.counts[f"{c.ref}_max"]}
        asked = [c for c in asked if c.ref not in same]
        for part in slices(asked):
            same |= Q.quantiles(
                self.frame, {c.ref: self.finite(c) for c in part},
                {c.ref: self.non_null(c) - self.infinite(c) for c in part})
        return same

    @cached_property
    def sketched_quartiles(self) -> dict[str, list[float]]:
        """The same within the rank error of the sketch size that the configuration asks for."""
        asked = [c for c in self.of_group("numeric") if self.non_null(c) > self.infinite(c)]
        found: dict[str, list[float]] = {}
        for part in slices(asked):
            found |= Q.sketched(self.frame, {c.ref: self.finite(c) for c in part}, self.config.approx_quartiles)
        return found

    @staticmethod
    def ordinal(c: ColumnInfo) -> Column:
        """A datetime as a long that keeps equality and order."""
        if isinstance(c.kind, T.DateType):
            return F.unix_date(c.ref).cast("long")
        if isinstance(c.kind, T.TimestampNTZType):
            return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c.ref})")
        return F.unix_micros(c.ref)

    def _candidates(self, columns: list[ColumnInfo], share: float) -> dict[str, list]:
        """Values that alone can reach ``share``: a value with that many rows
        is the median, whatever the others are."""
        medians, out = [], {}
        for c in columns:
            out[c.ref] = [float("inf"), float("-inf")] if self.infinite(c) else []
            if "quartiles" in self.__dict__ and c.ref in self.quartiles and share >= QUARTILE_SHARE:
                q1, q3 = self.quartiles[c.ref]
                out[c.ref] += [q1] if q1 == q3 else []
            else:
                medians.append(c)
        finite = {c.ref: self.non_null(c) - (self.infinite(c) if c.group == "numeric" else 0) for c in medians}
        for part in slices([c for c in medians if finite[c.ref]]):
            found = Q.ranked(self.frame, {c.ref: self.finite(c) if c.group == "numeric" else self.ordinal(c) for c in part},
                             {c.ref: [(finite[c.ref] - 1) // 2] for c in part})
            for (ref, _), value in found.items():
                out[ref].append(value)
        return out

    def dominant(self, share: float) -> dict[str, tuple[str, int]]:
        """Most frequent value and its count, for the columns where its share of
        the non-missing values reaches ``share`` and other values exist."""
        found: dict[str, tuple[str, int]] = {}
        for c in self.of_group("boolean"):
            yes = self.counts[f"{c.ref}_true"]
            no = self.non_null(c) - yes
            if yes and no:
                found[c.ref] = ("true", yes) if yes >= no else ("false", no)
        others = [c for c in self.of_group("numeric", "datetime")
                  if self.non_null(c) and not self.is_constant(c)]
        if share < MEDIAN_SHARE:
            found |= self._most_frequent(others)
        elif others:
            candidates = self._candidates(others, share)
            # beyond 2^53 a double no longer tells neighbouring integers apart
            vague = [c for c in others if not isinstance(c.kind, (T.FloatType, T.DoubleType))
                     and any(abs(v) >= 2 ** 53 for v in candidates[c.ref])]
            found |= self._most_frequent(vague)
            tests, aggregates = {}, []
            for c in others:
                if c in vague:
                    continue
                value = F.col(c.ref).cast("double") if c.group == "numeric" else self.ordinal(c)
                for j, candidate in enumerate(candidates[c.ref]):
                    hit = value == F.lit(candidate)
                    tests[f"{c.ref}_{j}"] = c.ref
                    aggregates += [F.count_if(hit).alias(f"n_{c.ref}_{j}"),
                                   F.min(F.when(hit, F.col(c.ref))).cast("string").alias(f"v_{c.ref}_{j}")]
            if aggregates:
                row = self.frame.agg(*aggregates).first()
                for key, ref in tests.items():
                    if row[f"n_{key}"] > found.get(ref, ("", 0))[1]:
                        found[ref] = (row[f"v_{key}"], row[f"n_{key}"])
        kept = {c.ref: found[c.ref] for c in self.columns
                if c.ref in found and py_pct(found[c.ref][1], self.non_null(c)) >= share}
        return kept | self._dominant_text(share)

    def _most_frequent(self, columns: list[ColumnInfo]) -> dict[str, tuple[str, int]]:
        """Most frequent value by full counts; ties go to the first seen."""
        out = {}
        for c in columns:
            first = F.min(ORD) if self.ordered else F.min(c.ref)
            top = (self.frame.filter(F.col(c.ref).isNotNull()).groupBy(c.ref)
                   .agg(F.count(F.lit(1)).alias("n"), first.alias("seen"))
                   .orderBy(F.desc("n"), "seen", c.ref).select(F.col(c.ref).cast("string").alias("v"), "n").first())
            out[c.ref] = (top["v"], top["n"])
        return out

    @property
    def _grouped(self) -> bool:
        """Whether the values of text columns are grouped anyway."""
        return self.reuse or self._staged is not None or bool({"tokens", "_text_facts", "text_counts"} & self.__dict__.keys())

    def _frequent_text(self, share: float) -> dict[str, tuple[str, int]]:
        """The same from frequent-item summaries: a few counters a column and task hold every value that can reach the share, and an
        exact recount decides. No value is shuffled. Columns that are almost empty ask for too many counters and are grouped."""
        support = {c.ref: 0.999 * share / 100 * self.non_null(c) / self.rows for c in self.text_columns()}
        sparse = [ref for ref, s in support.items() if s < LEAST_SUPPORT]
        if sparse:
            return self._grouped_text(share)
        found: dict[str, tuple[str, int]] = {}
        for part in slices([c for c in self.text_columns()]):
            refs = [c.ref for c in part]
            tokens = {ref: X.token(F.col(ref)) for ref in refs}
            items = self.frame.select(*[t.alias(ref) for ref, t in tokens.items()]).freqItems(refs, min(support[r] for r in refs)).first()
            candidates = [(ref, v) for ref in refs for v in items[f"{ref}_freqItems"] if v is not None]
            parts = []
            for i, (ref, v) in enumerate(candidates):
                hit = tokens[ref] == F.lit(v)
                parts += [F.count_if(hit).alias(f"n{i}"), F.min(F.when(hit, F.substring(ref, 1, 101))).alias(f"v{i}")]
                parts += [F.min(F.when(hit, F.col(ORD))).alias(f"o{i}")] if self.ordered else []
            if not parts:
                continue
            row = self.frame.agg(*parts).first()
            for c in part:
                mine = [i for i, (ref, _) in enumerate(candidates) if ref == c.ref]
                if not mine:
                    continue
                top = max(row[f"n{i}"] for i in mine)
                first = min((i for i in mine if row[f"n{i}"] == top), key=lambda i: ((row[f"o{i}"],) if self.ordered else (), candidates[i][1].encode()))
                if top < self.non_null(c) and py_pct(top, self.non_null(c)) >= share:
                    found[c.ref] = (row[f"v{first}"], top)
        return found

    def _dominant_text(self, share: float) -> dict[str, tuple[str, int]]:
        if not self.text_columns():
            return {}
        return self._grouped_text(share) if self._grouped else self._frequent_text(share)

    def _grouped_text(self, share: float) -> dict[str, tuple[str, int]]:
        hits = {c.ref: self.text_counts[c.ref]["top"] for c in self.text_columns()
                if self.text_counts[c.ref]["unique"] > 1
                and py_pct(self.text_counts[c.ref]["top"], self.non_null(c)) >= share}
        if not hits:
            return {}
        test = F.lit(False)
        for ref, top in hits.items():
            test = test | ((F.col("column") == ref) & (F.col("n") == F.lit(top)))
        tied = self.tokens.filter(test)
        best = tied.groupBy("column").agg(F.min_by("token", F.struct(*self.first_seen())).alias("token"))
        rows = {r["column"]: r["token"] for r in best.collect()}  # one row per column
        if any(t.startswith("\x00") for t in rows.values()):
            texts = self.whole_text(best).select("column", F.substring("text", 1, 101).alias("text"))
            rows |= {r["column"]: r["text"] for r in texts.collect()}
        return {ref: (rows[ref], hits[ref]) for ref in rows}
