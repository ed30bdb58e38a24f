"""Benchmark decontamination through a distributed positional inverted index.

Three passes, DataFrame operations only:

1. ``term_counts`` counts the benchmark's words over the whole corpus.
2. ``anchors`` picks the rarest word of every benchmark window. Every occurrence of a
   picked word inside an item becomes an anchor, with the item's words on both sides.
   Each window therefore holds at least one anchor.
3. ``postings`` are stored in the shared folder: for the picked words, where they stand in the
   corpus and the words around them. A posting and an anchor of one word fix an offset between document and
   item; the lists of the other words are intersected at that offset by comparing the two
   surroundings outwards. A run of equal words as long as a window is an exact phrase.

Only the rarest words are posted, so frequent words cost a set lookup and no row. What is
broadcast are anchors, in blocks of bounded bytes; further blocks take further passes.

Edge cases: null or empty text has no words and matches nothing. An item without words has
no window. Repeated items all count; an item whose id is null makes hits but is not listed.
Rows that share doc_id and text are one document. Columns besides those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import ascii_lower, sha256_hex, written

WINDOW = 13
#: Bytes of anchors (words with surroundings) or of terms sent to executors at once.
BLOCK_BYTES = 8 << 20
#: What stands between words of a text in lower case, with A to Z still in words.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def index_words(text: Column) -> Column:
    """Words of digits, a to z and everything beyond ASCII, after lower-casing A to Z."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN)
    # only the first and the last part can be empty
    return F.filter(parts, lambda w: w != "")


def _blocks(table: DataFrame, key: str, size: Column) -> list[DataFrame]:
    """``table`` cut by its key into parts of about BLOCK_BYTES."""
    total = table.agg(F.sum(size)).first()[0] or 0
    n = int(total // BLOCK_BYTES) + 1
    if n == 1:
        return [table]
    return [table.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, words) of the items that have words."""
    return items.select("item_id", index_words(F.col("text")).alias("words")).where(
        F.size("words") > 0
    )


def term_counts(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of ``terms`` stands in the whole corpus."""
    found = None
    for block in _blocks(terms, "term", F.octet_length("term") + 16):
        counted = (
            documents.select(F.explode(index_words(F.col("text"))).alias("term"))
            .join(F.broadcast(block), "term")
            .groupBy("term")
            .agg(F.count("*").alias("n"))
        )
        found = counted if found is None else found.unionByName(counted)
    return terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(term, item_id, before, after, need): picked words with their surroundings in items.

    ``before`` runs away from the word, so both sides are compared from their start.
    """
    reach = window - 1
    worded = item_words(items).withColumn("item", F.xxhash64("item_id", F.to_json("words")))
    spots = worded.select("item", F.size("words").alias("size"), F.posexplode("words").alias("at", "term"))
    rated = spots.join(counts, "term")
    first = F.greatest(F.lit(0), F.col("at") - reach)
    last = F.least(F.col("at"), F.greatest(F.lit(0), F.col("size") - window))
    rarest = (
        rated.select("item", "n", "term", F.explode(F.sequence(first, last)).alias("start"))
        .groupBy("item", "start")
        .agg(F.min(F.struct("n", "term")).alias("pick"))
        .select("item", F.col("pick.term").alias("term"))
        .distinct()
    )
    words, at = F.col("words"), F.col("at")
    left = F.greatest(F.lit(0), at - reach)
    return (
        spots.join(rarest, ["item", "term"], "left_semi")
        .drop("size")
        .join(worded, "item")
        .select(
            "term",
            "item_id",
            F.reverse(F.slice(words, left + 1, at - left)).alias("before"),
            F.slice(words, at + 2, F.lit(reach)).alias("after"),
            F.least(F.lit(window), F.size("words")).alias("need"),
        )
        .distinct()
    )


def postings(documents: DataFrame, terms: list[str], window: int = WINDOW) -> DataFrame:
    """(doc_id, doc_key, n_words, at, term, before, after): where ``terms`` stand.

    A document without any of the terms has one row, its ``at`` null.
    """
    reach = window - 1
    words = F.col("words")
    left = lambda p: F.greatest(F.lit(0), p - reach)
    spots = F.filter(
        F.sequence(F.lit(0), F.col("n_words") - 1), lambda p: F.get(words, p).isin(*terms)
    )
    entry = lambda p: F.struct(
        p.alias("at"),
        F.get(words, p).alias("term"),
        F.reverse(F.slice(words, left(p) + 1, p - left(p))).alias("before"),
        F.slice(words, p + 2, F.lit(reach)).alias("after"),
    )
    return (
        documents.select("doc_id", F.xxhash64("text").alias("doc_key"), index_words(F.col("text")).alias("words"))
        .withColumn("n_words", F.size("words"))
        .withColumn("spots", F.when(F.col("n_words") > 0, spots))
        .select("doc_id", "doc_key", "n_words", F.explode_outer(F.transform("spots", entry)).alias("p"))
        .select("doc_id", "doc_key", "n_words", "p.*")
    )


def _equal_run(ours: Column, theirs: Column) -> Column:
    """How many leading elements of two arrays agree."""
    same = F.zip_with(ours, theirs, lambda a, b: F.coalesce(a == b, F.lit(False)))
    stop = F.array_position(same, F.lit(False))
    return F.when(stop == 0, F.size(same)).otherwise(stop - 1).cast("int")


def matches(documents: DataFrame, items: DataFrame, window: int = WINDOW, near: bool = False) -> DataFrame:
    """(doc_id, doc_key, n_words, item_id, start, stop, kind): at least one row per document.

    ``kind`` is ``phrase`` for a run of at least a window's words, start and stop its first
    and last word; with ``near``, ``near`` where every word of the surroundings of an item's
    anchor stands around the document's, in any order. A document without matches has a row
    of nulls.
    """
    spark = documents.sparkSession
    terms = item_words(items).select(F.explode("words").alias("term")).distinct()
    counts = written(term_counts(documents, terms), "term-counts")
    picked = written(anchors(items, counts, window), "anchors")
    size = F.octet_length(F.array_join(F.concat("before", "after"), " ")) + 64
    found = None
    for block in _blocks(picked, "term", size):
        names = [r.term for r in block.select("term").distinct().collect()]
        posted = written(postings(documents, names or [""], window), "postings")
        theirs = block.select(
            F.col("term").alias("their_term"),
            "item_id",
            F.col("before").alias("their_before"),
            F.col("after").alias("their_after"),
            "need",
        )
        left = _equal_run(F.col("before"), F.col("their_before"))
        right = _equal_run(F.col("after"), F.col("their_after"))
        around = F.concat("before", "after")
        close = F.size(F.array_except(F.concat("their_before", "their_after"), around)) == 0
        phrase = F.col("left") + F.col("right") + 1 >= F.col("need")
        kind = F.when(phrase, F.lit("phrase"))
        kind = kind.when(close, F.lit("near")) if near else kind
        rows = (
            posted.join(F.broadcast(theirs), posted.term == theirs.their_term, "left")
            .withColumn("left", left)
            .withColumn("right", right)
            .withColumn("kind", kind)
        )
        hit = F.col("kind").isNotNull()
        rows = rows.select(
            "doc_id",
            "doc_key",
            "n_words",
            F.when(hit, F.col("item_id")).alias("item_id"),
            F.when(hit, F.col("at") - F.col("left")).alias("start"),
            F.when(hit, F.col("at") + F.col("right")).alias("stop"),
            "kind",
        )
        found = rows if found is None else found.unionByName(rows)
    return found if found is not None else spark.createDataFrame([], "doc_id long")


def contamination(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, doc_key, n_words, n_hit, items, contaminated) per document.

    ``n_hit`` counts words inside any phrase match once; ``items`` are the matching ids as
    sorted strings. A document is contaminated if it has a hit and hits are at least a
    twentieth of its words.
    """
    spans = F.array_sort(F.collect_set(F.when(F.col("kind") == "phrase", F.struct("start", "stop"))))
    ids = F.sort_array(F.collect_set(F.when(F.col("kind") == "phrase", F.col("item_id").cast("string"))))
    start = F.struct(F.lit(-1).alias("stop"), F.lit(0).alias("n"))
    merged = lambda a, s: F.struct(
        F.greatest(a["stop"], s["stop"]).alias("stop"),
        (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["stop"] + 1, s["start"]) + 1)).alias("n"),
    )
    return (
        matches(documents, items, window)
        .groupBy("doc_id", "doc_key", "n_words")
        .agg(spans.alias("spans"), ids.alias("items"))
        .select(
            "doc_id",
            "doc_key",
            F.col("n_words").cast("long").alias("n_words"),
            F.aggregate("spans", start, merged)["n"].cast("long").alias("n_hit"),
            "items",
        )
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        sha256_hex(F.array_join("items", ",")).alias("items_sha256"),
        "contaminated",
    )


ORACLE = r"""
WITH low AS (SELECT doc_id, text, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
it AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS s
  FROM it, unnest(range(1, greatest(2, len(w) - 11))) AS t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k
  FROM win),
dw AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
  FROM low, ks, unnest(range(1, len(w) - k + 2)) AS t(i)),
hit AS (SELECT doc_id, item_id, i, k
  FROM dw JOIN win USING (k, s)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM hit, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS ids
  FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
  FROM low LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)
"""
