"""Token counts by source, language and tokenizer version, kept up by signed deltas."""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsift.llm.staging import staged

KEYS = ("source", "lang", "version")
MEASURES = ("documents", "tokens")
TOTALS = "source string, lang string, version string, documents long, tokens long"


class Rollup:
    """Additive totals in a folder: Parquet folders of deltas, and a log of generations that says which of them count.

    A generation is one small JSON file: its data folders and the ids of all batches in them. Data goes to a folder of its own first; then the
    next generation is written aside and renamed to its number, which fails if another writer was faster. So a crash leaves a
    folder nobody names, never a state in between, and of two writers of one batch a single one commits it. Compaction is a generation
    as well: it names one folder in place of many and keeps all batch ids.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        root = self._path(self.folder)
        self._files = root.getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri() if root.toUri().getScheme() else self._files.getUri(), conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def generation(self) -> dict:
        """The last generation: number, folders, batches."""
        log = self._path(f"{self.folder}/log")
        names = [s.getPath().getName() for s in self._files.listStatus(log)] if self._files.exists(log) else []
        last = max((n for n in names if re.fullmatch(r"[0-9]{12}[.]json", n)), default=None)
        if last is None:
            return {"number": 0, "folders": [], "batches": []}
        stream = self._files.open(self._path(f"{self.folder}/log/{last}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _advance(self, following: dict) -> bool:
        """Make ``following`` the next generation, if no other writer has made it."""
        aside, target = f"{self.folder}/aside/{uuid.uuid4().hex}", f"{self.folder}/log/{following['number']:012d}.json"
        for name in ("aside", "log"):
            self._files.mkdirs(self._path(f"{self.folder}/{name}"))
        stream = self._files.create(self._path(aside), True)
        stream.write(json.dumps(following).encode())
        stream.close()
        never = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._context.rename(self._path(aside), self._path(target), never)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception):
                raise
            return False
        return True

    def _written(self, sums: DataFrame) -> str:
        name = f"data-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.folder}/{name}")
        return name

    def batches(self) -> list[str]:
        """Ids of the batches that count."""
        return self.generation()["batches"]

    def apply(self, batch: str, deltas: DataFrame) -> bool:
        """Commit ``deltas`` (KEYS, documents, tokens: signed; other columns are ignored) as ``batch``; False if that was done before."""
        if batch in self.batches():
            return False
        data = self._written(deltas.groupBy(*KEYS).agg(*(F.sum(m).cast("long").alias(m) for m in MEASURES)))
        while True:
            now = self.generation()
            if batch in now["batches"]:
                return False
            if self._advance({"number": now["number"] + 1, "folders": [*now["folders"], data], "batches": [*now["batches"], batch]}):
                return True

    def _sums(self, folders: list[str]) -> DataFrame:
        rows = self.spark.read.schema(TOTALS).parquet(*(f"{self.folder}/{n}" for n in folders)) if folders else self.spark.createDataFrame([], TOTALS)
        return rows.groupBy(*KEYS).agg(*(F.sum(m).cast("long").alias(m) for m in MEASURES)).where("documents != 0 or tokens != 0")

    def totals(self) -> DataFrame:
        """Current totals; keys whose documents have all been deleted are gone."""
        return self._sums(self.generation()["folders"])

    def compact(self) -> bool:
        """Fold all folders into one; False if another writer committed meanwhile, whose generation then stands."""
        now = self.generation()
        if len(now["folders"]) < 2:
            return False
        data = self._written(self._sums(now["folders"]))
        return self._advance({"number": now["number"] + 1, "folders": [data], "batches": now["batches"]})

    def forgotten(self) -> list[str]:
        """Data folders that no generation names: left by crashes or by writers that came too late. They may be deleted when no writer is at work."""
        root, log = self._path(self.folder), self._path(f"{self.folder}/log")
        named: set[str] = set()
        for s in self._files.listStatus(log) if self._files.exists(log) else []:
            stream = self._files.open(s.getPath())
            named |= set(json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["folders"])
            stream.close()
        found = [s.getPath().getName() for s in self._files.listStatus(root)] if self._files.exists(root) else []
        return sorted(n for n in found if n.startswith("data-") and n not in named)


def signed(rows: DataFrame, version: str, tokens: str, sign: int = 1) -> DataFrame:
    """Deltas that insert (1) or delete (-1) the documents of ``rows`` (source, lang and a count column; null counts are 0)."""
    count = F.coalesce(F.col(tokens), F.lit(0)).cast("long")
    return rows.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(version).alias("version"),
                       F.lit(sign).cast("long").alias("documents"), (count * sign).alias("tokens"))


def revised(rows: DataFrame, version: str, before: str, after: str) -> DataFrame:
    """Deltas that take back one count of each document and put another in its place."""
    return signed(rows, version, before, -1).unionByName(signed(rows, version, after))


WORD = "[^\\x20\\x09-\\x0D]+"


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang and three counts: declared (a sixth of n_chars), words, and pieces (runs of letters or digits, other signs)."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.floor(F.coalesce("n_chars", F.lit(0)) / 6).alias("declared"),
                       F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).alias("words"),
                       F.coalesce(F.regexp_count(text, F.lit("[A-Za-z]+|[0-9]+|[^\\x20\\x09-\\x0DA-Za-z0-9]")), F.lit(0)).alias("pieces"))


def maintained(docs: DataFrame, labels: DataFrame, store: Rollup) -> DataFrame:
    """Totals after five commits: all documents by declared size as version words-1, the same documents as pieces-1, the
    words-1 counts revised to true ones, labelled toxic documents deleted from both, and the revision sent a second time, which changes nothing.

    Null counts are 0, null sources and languages are keys of their own; a repeated row counts again. Labels are reduced to their
    distinct toxic ids, so a document is deleted once however many labels it has. Other columns are ignored. An empty table has no totals.
    """
    rows = staged(counted(docs), "counts")
    bad = labels.where("toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    gone = rows.join(bad, "doc_id", "left_semi")
    steps = [("1-insert", signed(rows, "words-1", "declared")), ("2-insert", signed(rows, "pieces-1", "pieces")), ("3-revise", revised(rows, "words-1", "declared", "words")),
             ("4-delete", signed(gone, "words-1", "words", -1).unionByName(signed(gone, "pieces-1", "pieces", -1)))]
    for name, deltas in [*steps, steps[2]]:
        store.apply(name, deltas)
    return store.totals()
