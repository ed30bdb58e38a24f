"""Lines that many documents share, found through an index of levelled sorted runs.

The index counts for every line key in how many documents it stands. It is a set of runs: tables
of (h1, h2, docs), bucketed by the key's two hashes and sorted, in the shared folder. A new batch of
documents is reduced to its own keys and anti-joined with the keys of the runs that are known to be
frequent, for these need no more counting; the rest is written as a run of level 0. Two runs of
one level are merged into one of the next, counts added, so there are few runs, and a key is
rewritten once per level. Runs share one bucketing, by which they are joined with a batch and merged
with each other: only the batch is shuffled, never a run. A list of the runs is written after each
change; what a failed batch has left beside it is not read.

A key is a line without ``[\\x20\\x09-\\x0D]`` at both ends, A to Z in lower case, told apart by 128
bits of hash. Frequent keys then go back to the texts: which lines of a text fall is decided once
per distinct text (128 bits of hash as well), and texts are rebuilt from what lies between.

Edge cases: a null or empty text is one empty line, and empty in the result. Empty keys are never counted or dropped. Every
row is a document of its own: rows repeated under one doc_id, or with null doc_id, count one by
one. A line repeated in a document counts once. A text may have any number of lines: they are rows,
gathered again only as the places of those that fall. Empty tables give empty tables. Other columns are
passed through, those named n_lines or n_dropped excepted, which are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import sha256_hex, shared_folder, table, written

#: Documents that make a key frequent, and code points that make a line a key.
LEAST, CHARS = 10, 1
#: Batches that the registered query adds one after the other.
BATCHES = 5
#: Lines put out at once.
ROWS = 1 << 16

_SEED = 42
#: The seed of the second hash: that of the text "line" by the first.
_OTHER = xxhash.xxh64_intdigest(b"line", _SEED)
_RUN = "h1 long, h2 long, docs long"


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # of bytes: ASCII white space, A to Z


def content(text: Column) -> list[Column]:
    """Two hashes of a whole text."""
    return [F.xxhash64(text).alias("c1"), F.xxhash64(F.lit("line"), text).alias("c2")]


def _lines(chars: int):
    names = ["batch", "c1", "c2", "at", "h1", "h2", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            texts = batch.column("text").cast(pa.binary())
            own = zip(*(batch.column(c).to_pylist() for c in ("batch", "c1", "c2")), strict=True)
            for (number, c1, c2), text in zip(own, texts, strict=True):
                seen = set()
                for at, line in enumerate(text.as_py().split(b"\n")):
                    key = line_key(line)
                    if len(key) < chars or chars > 1 and len(key.decode()) < chars:
                        continue
                    marks = xxhash.xxh64_intdigest(key, _SEED), xxhash.xxh64_intdigest(key, _OTHER)
                    held.append((number, c1, c2, at, *marks, marks not in seen))
                    seen.add(marks)
                    if len(held) >= ROWS:
                        yield _rows(held, names)
                        held = []
            if held:
                yield _rows(held, names)

    return run


def _rows(held: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*held, strict=True))
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), None, None, pa.bool_()]
    arrays = [
        pa.array(np.array(c, np.uint64).view(np.int64)) if kind is None else pa.array(c, kind)
        for c, kind in zip(columns, kinds, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def lines(documents: DataFrame, batches: int = 1, chars: int = CHARS) -> DataFrame:
    """(batch, c1, c2, at, h1, h2, first) of every line with a key; ``at`` counts from 0.

    ``first`` tells the first line of a key in its document.
    """
    text = F.coalesce("text", F.lit(""))
    marked = documents.select(text.alias("text"), *content(text)).select(
        F.pmod("c1", F.lit(batches)).cast("int").alias("batch"), "c1", "c2", "text"
    )
    return marked.mapInArrow(
        _lines(chars), "batch int, c1 long, c2 long, at long, h1 long, h2 long, first boolean"
    )


class Runs:
    """The index in a folder; a new one, or that which the folder holds."""

    def __init__(self, spark: SparkSession, folder: str, least: int = LEAST, buckets: int | None = None):
        self.spark, self.folder, self.least = spark, folder.rstrip("/"), least
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.runs = 0, []  # of runs: (level, name), oldest first

    @classmethod
    def reopened(cls, spark: SparkSession, folder: str, **options) -> Runs:
        """The index as of its newest list of runs."""
        listed = spark.read.parquet(f"{folder.rstrip('/')}/list")
        version = listed.agg(F.max("version")).first()[0]
        rows = listed.where(F.col("version") == version).orderBy("place").collect()
        index = cls(spark, folder, buckets=rows[0].buckets, **options)
        index.version = version
        index.runs = [(r.level, r.name) for r in rows]
        for _, name in index.runs:
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} ({_RUN.replace(' long', ' BIGINT')}) USING parquet "
                f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {index.buckets} BUCKETS LOCATION '{index._path(name)}'"
            )
        return index

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _put(self, rows: DataFrame, level: int) -> tuple[int, str]:
        """Writes rows that lie in the partitions of their buckets."""
        name = f"run_{uuid.uuid4().hex}"
        (
            rows.select("h1", "h2", "docs")
            .write.bucketBy(self.buckets, "h1", "h2")
            .sortBy("h1", "h2")
            .option("path", self._path(name))
            .saveAsTable(name)
        )
        return level, name

    def _list(self, runs: list[tuple[int, str]]) -> None:
        rows = [(place, level, name, self.buckets) for place, (level, name) in enumerate(runs)]
        listed = self.spark.createDataFrame(rows, "place int, level int, name string, buckets int")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/list/version={self.version + 1}")
        self.version, self.runs = self.version + 1, runs

    def run(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def unsettled(self, keys: DataFrame) -> DataFrame:
        """(h1, h2, docs) of the batch's keys that no run knows to be frequent.

        ``keys`` has a row per key and document.
        """
        own = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"))
        for _, name in self.runs:
            settled = self.run(name).where(F.col("docs") >= self.least).select("h1", "h2")
            own = own.join(settled, ["h1", "h2"], "left_anti")
        return own

    def add(self, keys: DataFrame) -> None:
        own = self.unsettled(keys).repartition(self.buckets, "h1", "h2")
        runs = [*self.runs, self._put(own, 0)]
        while len(runs) > 1 and runs[-1][0] == runs[-2][0]:
            runs = [*runs[:-2], self._merged(*runs[-2:])]
        self._list(runs)

    def _merged(self, older: tuple[int, str], newer: tuple[int, str]) -> tuple[int, str]:
        a, b = (self.run(name) for _, name in (older, newer))
        both = a.join(b.withColumnRenamed("docs", "more"), ["h1", "h2"], "full")
        docs = F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))
        return self._put(both.select("h1", "h2", docs.alias("docs")), older[0] + 1)

    def frequent(self) -> DataFrame:
        """(h1, h2) of the keys found in at least ``least`` documents; merges all runs into one."""
        if not self.runs:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        if len(self.runs) > 1:
            runs = self.runs
            while len(runs) > 1:  # the newest are the smallest
                runs = [*runs[:-2], self._merged(*runs[-2:])]
            self._list(runs)
        return self.run(self.runs[0][1]).where(F.col("docs") >= self.least).select("h1", "h2")


def falling(found: DataFrame, frequent: DataFrame) -> DataFrame:
    """(c1, c2, places): per distinct text the sorted places of the lines that fall."""
    hit = found.select("c1", "c2", "at", "h1", "h2").join(frequent, ["h1", "h2"], "left_semi")
    return hit.groupBy("c1", "c2").agg(F.sort_array(F.collect_set("at")).alias("places"))


def _rebuilt(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, places in zip(batch.column("found_text").cast(pa.binary()), batch.column("found_places"), strict=True):
                split = text.as_py().split(b"\n")
                falls = set(places.as_py() or ())
                kept = [line for at, line in enumerate(split) if at not in falls] if falls else split
                texts.append(b"\n".join(kept))
                n_lines.append(len(split))
                n_dropped.append(len(falls))
            row = batch.column("row")
            own = [pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else row.field(c) for c in names]
            counts = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(own + counts, names=[*names, "n_lines", "n_dropped"])

    return run


def deduplicated(documents: DataFrame, index: Runs, batches: int = 1, chars: int = CHARS) -> DataFrame:
    """``documents`` without frequent lines, and with n_lines and n_dropped.

    The documents are added to the index in batches; frequent is what is so in the end.
    """
    path = shared_folder(documents.sparkSession, "lines")
    found = lines(documents, batches, chars)
    found.write.partitionBy("batch").parquet(path)
    found = documents.sparkSession.read.schema(found.schema).parquet(path)
    for number in range(batches):
        index.add(found.where((F.col("batch") == number) & F.col("first")).select("h1", "h2"))
    places = written(falling(found, written(index.frequent(), "frequent-lines")), "falling-lines")
    text = F.coalesce("text", F.lit(""))
    marked = documents.select(F.struct("*").alias("row"), text.alias("text"), *content(text))
    joined = marked.join(places, ["c1", "c2"], "left").select(
        "row", F.col("text").alias("found_text"), F.col("places").alias("found_places")
    )
    fields = [f for f in documents.schema.fields if f.name not in ("n_lines", "n_dropped")]
    added = [T.StructField(c, T.LongType()) for c in ("n_lines", "n_dropped")]
    return joined.mapInArrow(_rebuilt([f.name for f in fields]), T.StructType(fields + added))


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("text")).alias("kept_sha256"))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: all documents through a new index."""
    index = Runs(spark, shared_folder(spark, "line-runs"))
    return digest(deduplicated(table(spark, sf_dir, "documents"), index, BATCHES))


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE = f"""
WITH texts AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc, doc_id, string_split(text, chr(10)) AS lines FROM texts),
lined AS (SELECT doc, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM split),
keyed AS (
    SELECT doc, line, place, translate(trim(line, {_WHITE}),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lined),
frequent AS (SELECT key FROM keyed WHERE length(key) >= {CHARS} GROUP BY key HAVING count(DISTINCT doc) >= {LEAST}),
judged AS (SELECT k.*, f.key IS NOT NULL AS drops FROM keyed k LEFT JOIN frequent f ON k.key = f.key),
kept AS (
    SELECT doc, count(*) AS n_lines, count(*) FILTER (drops) AS n_dropped,
           coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT drops), '') AS kept
    FROM judged GROUP BY doc)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM kept JOIN texts USING (doc)
"""
