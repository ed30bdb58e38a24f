"""Collocations: phrases of two or three words whose parts seldom stand without each other.

Texts are read in slices; a slice's tokens are coded by Arrow, phrases are numbers until they are
counted, and a task puts out one row per phrase and slice for Spark to sum.

The search grows phrases from the left. With a = f(x y z), the cut after x gives

    score <= a a / (f(x) f(y z)) <= a / f(x) <= f(x y) / f(x)

because a is at most f(y z) and f(x y). So the counts of a prefix bound the scores of all that
grows from it, and prefixes are expanded best bound first: a round takes, in every language,
all prefixes whose bound reaches a level, and with them all pairs of words whose own score
reaches it, since what may drop such a pair is a longer phrase that ends in it. What these grow into
is counted over the whole table. All phrases with scores from the level up are then known, and
which of them survive; if a language has as many as are asked for, ties included, it is
settled. The others go on at a lower level, at last at 0, where everything is expanded.

Words found fewer than ``LEAST`` times are in no candidate, and a pair less frequent than that
begins and ends none. Tasks are told so by bit tables of a fixed size (``BITS``): a word or pair
whose bit is not set is not counted. Two that share a bit cost work and change no count.

Edge cases: a null text is empty, a null lang is ``und``. Rows are counted one by one, repeats
included. A text of any length is read in slices of about ``SLICE`` bytes, each of which begins
with the last two tokens of the one before; one word of any length stays whole. Ties are
broken by count and phrase, so the result is the same on every run. An empty table has no
phrases. Columns besides text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.llm.common import written

UNKNOWN = "und"
LEAST = 10
#: A phrase is dropped if so many hundredths of its occurrences lie within one longer candidate.
COVERED = 50
LIMIT = 2000
SCALE = 1_000_000
#: Bits of a table of words or pairs; its size (4 MB) does not depend on the data.
BITS = 1 << 25
#: Bytes of text whose tokens are coded at once.
SLICE = 2 << 20
#: The first level lies where so many pairs of a language reach it; then it is cut by STEP.
AHEAD, STEP = 2 * LIMIT, 32
#: Pieces end at these bytes; white space within a piece parts words.
ENDS = b".,;:!?\n\x0b\x0c\r"

_BREAK = b"\xff"  # in no UTF-8 text
_FOLD = bytes.maketrans(
    ENDS + bytes(range(65, 91)), _BREAK * len(ENDS) + bytes(range(97, 123))
)
_SEED, _MASK = 42, (1 << 64) - 1


# Tokens of slices.


def cut(data: bytes, size: int = SLICE) -> Iterator[tuple[list[bytes], int]]:
    """Tokens of folded text, and how many of them the slice before has counted.

    Breaks are tokens of their own. Slices end between tokens.
    """
    carried: list[bytes] = []
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            gaps = [p for p in (data.find(b" ", end), data.find(b"\t", end), data.find(_BREAK, end)) if p >= 0]
            end = min(gaps, default=len(data))
        own = data[at:end].replace(_BREAK, b" \xff ").split()
        yield carried + own, len(carried)
        carried, at = (carried + own)[-2:], end


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], int]]:
    """(lang, tokens, counted before) over all rows of a task; texts of a language go together."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def out() -> Iterator[tuple[str, list[bytes], int]]:
        for lang, texts in held.items():
            for tokens, lead in cut(_BREAK.join(texts).translate(_FOLD)):
                yield lang, tokens, lead
        held.clear()

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
            data = text.as_py()
            if not data:
                continue
            held.setdefault(lang, []).append(data)
            size += len(data)
            if size >= SLICE:
                yield from out()
                size = 0
    yield from out()


class Coded:
    """A slice's tokens as codes; ``hashes`` and ``real`` (no break) are by code."""

    def __init__(self, lang: str, tokens: list[bytes], lead: int):
        coded = pa.array(tokens, pa.binary()).dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.lead = lead
        self.real = np.array([w != _BREAK for w in self.words], bool)
        seed = xxhash.xxh64_intdigest(lang.encode(), _SEED)
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))

    def phrases(self, size: int, wanted: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Phrases that start at the wanted places and end in this slice, with their counts."""
        starts = np.flatnonzero(wanted)
        starts = starts[starts + size > self.lead]
        key, n = self.codes[starts], len(self.words)
        # numbers of pairs are made dense again, so that no product leaves 64 bits
        for k in range(1, size):
            key = np.unique(key, return_inverse=True)[1] * n + self.codes[starts + k]
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        parts = [[self.words[c] for c in self.codes[starts[first] + k]] for k in range(size)]
        return [b" ".join(p) for p in zip(*parts, strict=True)], counts


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a << np.uint64(21)) | (a >> np.uint64(43))) ^ b


def _counting(count: Callable[[Coded], tuple[list[bytes | None], np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, tokens, lead in slices(batches):
            if len(tokens) > lead:
                found, counts = count(Coded(lang, tokens, lead))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(found, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())],
                    names=["lang", "phrase", "f"],
                )

    return run


def _counts(documents: DataFrame, count: Callable[[Coded], tuple[list[bytes | None], np.ndarray]]) -> DataFrame:
    """(lang, phrase, f) summed over all texts."""
    texts = documents.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    rows = texts.mapInArrow(_counting(count), "lang string, phrase string, f long")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _words(slice_: Coded) -> tuple[list[bytes | None], np.ndarray]:
    """Counts of words, and of all words together under null."""
    own = np.bincount(slice_.codes[slice_.lead :], minlength=len(slice_.words))
    seen = np.flatnonzero(slice_.real & (own > 0))
    return [*(slice_.words[c] for c in seen), None], np.append(own[seen], own[seen].sum())


def _pairs(words: np.ndarray):
    def count(slice_: Coded) -> tuple[list[bytes], np.ndarray]:
        usable = (slice_.real & holds(words, slice_.hashes))[slice_.codes]
        return slice_.phrases(2, usable[:-1] & usable[1:])

    return count


def _triples(pairs: np.ndarray, heads: np.ndarray, tails: np.ndarray):
    def count(slice_: Coded) -> tuple[list[bytes], np.ndarray]:
        of, real = slice_.hashes[slice_.codes], slice_.real[slice_.codes]
        marks = pair_hash(of[:-1], of[1:])
        usable = real[:-1] & real[1:] & holds(pairs, marks)
        asked = holds(heads, marks[:-1]) | holds(tails, marks[1:])
        return slice_.phrases(3, usable[:-1] & usable[1:] & asked)

    return count


# Bit tables.


def holds(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(BITS - 1)
    return (table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bit_table(keys: DataFrame, key: Column) -> np.ndarray:
    """The bits of all keys: built in Spark by blocks, of which there are BITS / 32768 at most."""
    place = key.bitwiseAND(F.lit(BITS - 1)) + 1
    blocks = (
        keys.select(place.alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    )
    table = np.zeros(BITS // 8, np.uint8)
    for row in blocks.collect():
        bits = np.frombuffer(row.bits, np.uint8)
        at = (row.block - 1) * 4096
        table[at : at + len(bits)] = bits
    return table


def _pair_key() -> Column:
    a, b = F.xxhash64("lang", "x"), F.xxhash64("lang", "y")
    return F.shiftleft(a, 21).bitwiseOR(F.shiftrightunsigned(a, 43)).bitwiseXOR(b)


# Scores.


def ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """floor(SCALE a b / (c d)) in decimals of 38 digits: exact for counts below 10^15."""
    wide = lambda x: x.cast("decimal(18,0)")
    whole = lambda x, y: (wide(x) * wide(y)).cast("decimal(38,0)")
    return F.call_function("div", (whole(a, b) * F.lit(SCALE).cast("decimal(7,0)")).cast("decimal(38,0)"), whole(c, d))


def scored_pairs(documents: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """(lang, x, y, phrase, a, l, r, score, bound) of the pairs found often enough."""
    usable = bit_table(words, F.xxhash64("lang", "word"))
    found = _counts(documents, _pairs(usable)).where(F.col("f") >= least)
    parts = F.split("phrase", " ")
    named = found.select("lang", parts[0].alias("x"), parts[1].alias("y"), "phrase", F.col("f").alias("a"))
    left = words.select("lang", F.col("word").alias("x"), F.col("f").alias("l"))
    right = words.select("lang", F.col("word").alias("y"), F.col("f").alias("r"))
    one = F.lit(1)
    return (
        named.join(left, ["lang", "x"])
        .join(right, ["lang", "y"])
        .withColumn("score", ratio(F.col("a"), F.col("a"), F.col("l"), F.col("r")))
        .withColumn("bound", ratio(F.col("a"), one, F.col("l"), one))
        .select("lang", "x", "y", "phrase", "a", "l", "r", "score", "bound")
    )


def scored_triples(documents: DataFrame, pairs: DataFrame, usable: np.ndarray, levels: DataFrame, least: int) -> DataFrame:
    """(lang, head, tail, phrase, a, l, r, score): what grows from the prefixes at or above the
    levels, or ends in a pair whose score is."""
    open_ = pairs.join(levels, "lang")
    heads = bit_table(open_.where("bound >= level"), _pair_key())
    tails = bit_table(open_.where("score >= level"), _pair_key())
    found = _counts(documents, _triples(usable, heads, tails)).where(F.col("f") >= least)
    parts = F.split("phrase", " ")
    named = found.select(
        "lang",
        F.concat_ws(" ", parts[0], parts[1]).alias("head"),
        F.concat_ws(" ", parts[1], parts[2]).alias("tail"),
        "phrase",
        F.col("f").alias("a"),
    )
    head = pairs.select("lang", F.col("phrase").alias("head"), F.col("a").alias("f_xy"), F.col("l").alias("f_x"))
    tail = pairs.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("f_yz"), F.col("r").alias("f_z"))
    a = F.col("a")
    after_one = ratio(a, a, F.col("f_x"), F.col("f_yz"))
    after_two = ratio(a, a, F.col("f_xy"), F.col("f_z"))
    later = after_two < after_one
    return named.join(head, ["lang", "head"]).join(tail, ["lang", "tail"]).select(
        "lang",
        "head",
        "tail",
        "phrase",
        "a",
        F.when(later, F.col("f_xy")).otherwise(F.col("f_x")).alias("l"),
        F.when(later, F.col("f_z")).otherwise(F.col("f_yz")).alias("r"),
        F.least(after_one, after_two).alias("score"),
    )


# The search.


def _best_first() -> list[Column]:
    return [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]


def first_levels(pairs: DataFrame, ahead: int = AHEAD) -> DataFrame:
    """(lang, level): the score of the ``ahead``-th pair of a language, 0 where there are fewer."""
    place = Window.partitionBy("lang").orderBy(F.col("score").desc())
    near = pairs.select("lang", "score", F.row_number().over(place).alias("place")).where(F.col("place") <= ahead)
    return near.groupBy("lang").agg(F.max(F.when(F.col("place") == ahead, F.col("score"))).alias("level")).select(
        "lang", F.coalesce("level", F.lit(0)).cast("long").alias("level")
    )


def survivors(pairs: DataFrame, triples: DataFrame, levels: DataFrame, covered: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) from the level up that no longer candidate covers."""
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    inside = triples.select("lang", F.explode(F.array("head", "tail")).alias("phrase"), F.col("a").alias("longer"))
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    reach = lambda of: of.join(levels, "lang").where("score >= level")
    kept = (
        reach(pairs)
        .join(most, ["lang", "phrase"], "left")
        .where(F.coalesce(F.col("longer") * 100 < F.col("a") * covered, F.lit(True)))
    )
    return kept.select(columns).unionByName(reach(triples).select(columns))


def collocations(
    documents: DataFrame, limit: int = LIMIT, least: int = LEAST, covered: int = COVERED, ahead: int = AHEAD
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``limit`` phrases of every language."""
    counted = _counts(documents, _words)
    counted = written(counted.where((F.col("f") >= least) | F.col("phrase").isNull()), "word-counts")
    totals = counted.where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))
    words = counted.where(F.col("phrase").isNotNull()).withColumnRenamed("phrase", "word")
    pairs = written(scored_pairs(documents, words, least), "pairs")
    usable = bit_table(pairs, _pair_key())
    levels = written(first_levels(pairs, ahead), "levels")
    place = Window.partitionBy("lang").orderBy(*_best_first())
    done = None
    while not levels.isEmpty():
        triples = written(scored_triples(documents, pairs, usable, levels, least), "triples")
        known = survivors(pairs, triples, levels, covered).withColumn("rank", F.row_number().over(place).cast("long"))
        best = written(known.where(F.col("rank") <= limit), "survivors")
        enough = best.where(F.col("rank") == limit).select("lang")
        settled = levels.join(enough, "lang", "left_semi").unionByName(levels.where("level = 0")).distinct()
        settled = written(settled.select("lang"), "settled")
        found = best.join(settled, "lang", "left_semi")
        done = found if done is None else done.unionByName(found)
        rest = levels.join(settled, "lang", "left_anti")
        levels = written(rest.select("lang", F.expr(f"level div {STEP}").alias("level")), "levels")
    if done is None:
        done = pairs.select("lang", "phrase", "a", "l", "r", "score", F.col("a").alias("rank"))
    return done.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""
WITH pieces AS (
    SELECT coalesce(lang, '{UNKNOWN}') AS lang, row_number() OVER () AS doc,
           unnest(string_split_regex(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents),
numbered AS (SELECT lang, row_number() OVER () AS piece_no, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
spots AS (SELECT lang, piece_no, unnest(w) AS x, unnest(range(len(w))) AS i FROM numbered),
runs AS (
    SELECT lang, x, lead(x, 1) OVER p AS y, lead(x, 2) OVER p AS z
    FROM spots WINDOW p AS (PARTITION BY piece_no ORDER BY i)),
counts AS MATERIALIZED (
    SELECT lang, 1 AS size, x AS phrase, count(*) AS f FROM runs GROUP BY ALL
    UNION ALL SELECT lang, 2, x || ' ' || y, count(*) FROM runs WHERE y IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z, count(*) FROM runs WHERE z IS NOT NULL GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (
    SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w
    FROM counts WHERE size > 1 AND f >= {LEAST}),
split AS (
    SELECT lang, size, phrase, a, 1 AS k, w[1] AS first, array_to_string(w[2:], ' ') AS rest FROM candidates
    UNION ALL SELECT lang, size, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM candidates WHERE size = 3),
known AS MATERIALIZED (SELECT lang, phrase, f FROM counts WHERE f >= {LEAST}),
cuts AS (
    SELECT c.lang, c.size, c.phrase, c.a, k, l.f AS l, r.f AS r,
           ({SCALE}::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
    FROM split c
    JOIN known l ON l.lang = c.lang AND l.phrase = c.first
    JOIN known r ON r.lang = c.lang AND r.phrase = c.rest),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
covered AS (
    SELECT lang, part, max(a) AS longer
    FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM candidates WHERE size = 3)
    GROUP BY lang, part),
kept AS (
    SELECT s.* FROM worst s LEFT JOIN covered c ON c.lang = s.lang AND c.part = s.phrase
    WHERE c.longer IS NULL OR 100 * c.longer < {COVERED} * s.a),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= {LIMIT}
"""
