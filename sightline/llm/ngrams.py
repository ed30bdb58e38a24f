"""Interpolated modified Kneser-Ney bigram model: counted in Spark, scored from mapped files.

Words are XXH64 hashes of their bytes. Counting tasks turn texts into (word before, word)
pairs, sum equal pairs of about ``FLUSH`` tokens, and put out packed arrays, one row per shard
of the pair space; Spark shuffles the rows by shard. A shard's task sums its pairs, writes them
as sorted hash arrays, with the totals and counts of counts of its contexts, and puts out
packed sums per word for the second shuffle, whose tasks write the sorted unigram arrays: raw
counts and numbers of different words before. Numbers of shards grow with the corpus, so a
shard fits one task. Contexts that a sample shows to be frequent (a third of all tokens may be
one word) are spread over ``SPREAD`` shards, their totals summed apart; this changes where
pairs lie and no count.

Scoring tasks map the files from the shared folder, or from an unlinked local copy where that
folder is no local path, and look up batches of sorted distinct hashes. With discounts D from
the counts of counts n1 to n4,

    P(w | v) = max(c(v w) - D(c), 0) / c(v) + gamma(v) Pc(w)
    Pc(w)    = max(a(w) - D'(a), 0) / A + gamma' / (V + 1)

where a(w) is the number of different words before w, A their sum, and gamma what discounts
leave. A text begins after a start mark and ends with an end mark, which is a token.

Tasks name their files by shard and write them under another name first, so a task that runs
twice, or after an executor was lost, leaves the same files.

Edge cases: a null or empty text is its end mark only. Without texts to learn from all
probabilities are 1. A null doc_id is neither learned from nor held out. Repeated rows are
counted and scored one by one. Columns besides those named are ignored.
"""

from __future__ import annotations

import io
import mmap
import os
import sys
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import shared_folder
from sightline.llm.language import fold

END, START = 1, 2
#: Tokens whose pairs a counting task sums before it puts them out.
FLUSH = 1_500_000
#: Tokens scored at once.
SCORED = 400_000
#: Bytes of text per shard of pairs, about, and pair shards per shard of words.
SHARD_BYTES = 8 << 20
PER_WORDS = 8
#: Bits of a pair's key that place it in a shard; the others are a hash of the pair.
PLACE = 20
#: Texts, by smallest hash of doc_id, that show which contexts are frequent; the share of their
#: tokens that makes one so; shards each is spread over.
HOT_TEXTS, HOT_SHARE, SPREAD = 500, 0.002, 16


# Files in the shared folder.

#: A map keeps a descriptor of its own unless told not to, which Python can since 3.13.
UNTRACKED = {"trackfd": False} if sys.version_info >= (3, 13) else {}


def _path(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def put_file(uri: str, data: bytes) -> None:
    """Writes a file whole or not at all."""
    aside = f"{uri}.{uuid.uuid4().hex}"
    if path := _path(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_path(aside), "wb") as f:
            f.write(data)
        os.replace(_path(aside), path)
        return
    from pyarrow.fs import FileSystem

    store, path = FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path))
    _, beside = FileSystem.from_uri(aside)
    with store.open_output_stream(beside) as f:
        f.write(data)
    store.move(beside, path)


def mapped(uri: str) -> memoryview:
    """A file's bytes, mapped; no descriptor stays open, so any number of files may be."""
    if path := _path(uri):
        with open(path, "rb") as f:
            return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **UNTRACKED))
    from pyarrow.fs import FileSystem

    store, path = FileSystem.from_uri(uri)
    with tempfile.TemporaryFile() as f, store.open_input_stream(path) as source:
        while chunk := source.read(1 << 24):
            f.write(chunk)
        f.flush()
        return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **UNTRACKED))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays behind a count of their items and widths; 8-byte items first keeps them aligned."""
    out = io.BytesIO()
    out.write(np.array([len(arrays), *(x for a in arrays for x in (len(a), a.itemsize))], "<i8").tobytes())
    for a in arrays:
        out.write(np.ascontiguousarray(a).tobytes())
    return out.getvalue()


def unpacked(data: bytes | memoryview) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    shape = np.frombuffer(data, "<i8", 2 * n, 8).reshape(n, 2).tolist()
    at, out = 8 + 16 * n, []
    for count, width in shape:
        out.append(np.frombuffer(data, f"<u{width}", count, at))
        at += count * width
    return out


# Hashes.


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's words and the end mark."""
    words = (text or "").encode().lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def is_in(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """The place of each x in ``ordered``, or -1."""
    if not len(ordered):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return np.where(ordered[at] == x, at, -1)


def pair_keys(before: np.ndarray, words: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Keys of pairs: PLACE bits by the word before, and for hot ones the word, then a hash."""
    spread = np.where(is_in(before, hot) >= 0, (mixed(words) % np.uint64(SPREAD)) + np.uint64(1), np.uint64(0))
    place = mixed(before + spread * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PLACE)
    rest = mixed(mixed(before) + words) >> np.uint64(PLACE)
    return (place << np.uint64(64 - PLACE)) | rest


def pair_shard(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(64 - PLACE)) * np.uint64(n)) >> np.uint64(PLACE)


def word_shard(words: np.ndarray, n: int) -> np.ndarray:
    return ((words >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def summed(order_by: tuple[np.ndarray, ...], *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows of ``order_by`` (the last array sorts first) and the sums of ``values``."""
    n = len(order_by[0])
    if not n:
        return (*order_by, *values)
    order = np.lexsort(order_by)
    keys = [k[order] for k in order_by]
    new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
    heads = np.flatnonzero(new)
    return (*(k[heads] for k in keys), *(np.add.reduceat(v[order].astype(np.uint64), heads) for v in values))


def summed_by_first(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """``summed`` over all parts' rows, by their first array."""
    first, *values = (np.concatenate(column) for column in zip(*parts, strict=True))
    return summed((first,), *values)


def split_rows(shard: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each shard, in the order they have."""
    order = np.argsort(shard, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0]) if len(shard) else []
    for a, b in zip(heads, [*heads[1:], len(shard)], strict=True):
        yield int(shard[order[a]]), [x[order[a:b]] for x in arrays]


# Counting.


@dataclass(frozen=True)
class Layout:
    folder: str
    pair_shards: int
    word_shards: int
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))


COUNTED = "shard int, data binary"


def _count(layout: Layout):
    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        words = np.concatenate(held)
        before = np.r_[np.uint64(START), words[:-1]]
        before[np.cumsum([len(h) for h in held])[:-1]] = START
        words, before, counts = summed((words, before), np.ones(len(words), np.uint64))
        shard = pair_shard(pair_keys(before, words, layout.hot), layout.pair_shards).astype(np.int64)
        shards, rows = [], []
        for k, (v, w, c) in split_rows(shard, before, words, counts):
            heads = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            runs = np.diff(np.r_[heads, len(v)]).astype(np.uint32)
            shards.append(k)
            rows.append(packed(v[heads], w, runs, c.astype(np.uint32)))
        return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(rows, pa.binary())], names=["shard", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(tokens(text.as_py()))
                size += len(held[-1])
                if size >= FLUSH:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    return run


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def _pairs(layout: Layout):
    """Sums a shard's pairs and writes them; puts out sums per word, and of hot contexts."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [unpacked(d) for d in rows["data"]]
        before = np.concatenate([np.repeat(v, runs) for v, _, runs, _ in parts])
        words = np.concatenate([w for _, w, _, _ in parts])
        words, before, counts = summed((words, before), np.concatenate([c for *_, c in parts]))
        heads = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        per = lambda x: np.add.reduceat(x.astype(np.uint64), heads)
        stats = [per(counts), per(counts == 1), per(counts == 2), per(counts >= 3)]
        contexts = before[heads]
        hot = is_in(contexts, layout.hot) >= 0
        keys = pair_keys(before, words, layout.hot)
        order = np.argsort(keys)
        put_file(
            f"{layout.folder}/pairs-{key[0]}",
            packed(
                keys[order],
                contexts[~hot],
                stats[0][~hot],
                counts[order].astype(np.uint32) if counts.max() < 2**32 else counts[order],
                *(s[~hot].astype(np.uint32) for s in stats[1:]),
            ),
        )
        own, total, kinds = summed((words,), counts, np.ones(len(words), np.uint64))
        of = word_shard(own, layout.word_shards).astype(np.int64)
        out = [(k, packed(*x)) for k, x in split_rows(of, own, total, kinds)]
        seen = np.array(_counts_of_counts(counts), np.uint64)
        out.append((-1, packed(seen, contexts[hot], *(s[hot] for s in stats))))
        return pd.DataFrame(out, columns=["shard", "data"])

    return run


STATS = "tokens long, words long, kinds long, n array<long>, pair_n array<long>, hot binary"


def _words(layout: Layout):
    """Sums a shard's words and writes them; shard -1 sums what concerns pairs as a whole."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [unpacked(d) for d in rows["data"]]
        if key[0] == -1:
            seen = np.sum([p[0] for p in parts], axis=0).tolist()
            hot = summed_by_first([p[1:] for p in parts])
            return pd.DataFrame([(0, 0, 0, [0] * 4, seen, packed(*hot))], columns=["tokens", "words", "kinds", "n", "pair_n", "hot"])
        own, total, kinds = summed_by_first(parts)
        put_file(f"{layout.folder}/words-{key[0]}", packed(own, total, kinds))
        row = (int(total.sum()), len(own), int(kinds.sum()), _counts_of_counts(kinds), [0] * 4, b"")
        return pd.DataFrame([row], columns=["tokens", "words", "kinds", "n", "pair_n", "hot"])

    return run


def discounts(n: list[int]) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more, from the numbers of counts 1 to 4."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3) == 0:
        return np.array([0.0, 0.5, 0.75, 0.75])
    y = n1 / (n1 + 2 * n2)
    d = [k - (k + 1) * y * b / a for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(max(x, 0.0), float(k)) for k, x in enumerate(d, 1))])


@dataclass(frozen=True)
class Model:
    layout: Layout
    tokens: int
    words: int
    kinds: int
    n: tuple[int, ...]
    pair_n: tuple[int, ...]
    hot: bytes


def _hot_contexts(texts: DataFrame) -> np.ndarray:
    """Hashes of words that are frequent in a bounded sample; for the layout only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                words, counts = np.unique(tokens(text.as_py()), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])

    ids = texts.select(F.col("doc_id").alias("sampled")).orderBy(F.xxhash64("sampled"), "sampled").limit(HOT_TEXTS)
    counted = (
        texts.join(F.broadcast(ids), F.col("doc_id") == F.col("sampled"))
        .select("text")
        .mapInArrow(count, "word long, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )
    total = counted.agg(F.sum("n")).first()[0] or 0
    # at most 1 / HOT_SHARE words can reach the share
    rows = counted.where(F.col("n") >= HOT_SHARE * total).collect()
    return np.sort(np.array([r.word for r in rows], np.int64).view(np.uint64))


def learn(documents: DataFrame, allowed: Column) -> Model:
    """Counts all ``allowed`` rows; the model's files lie in a new shared folder."""
    texts = documents.where(allowed).select("doc_id", "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pair_shards = min(max(8, size // SHARD_BYTES), 1 << PLACE)
    layout = Layout(
        shared_folder(documents.sparkSession, "ngrams"),
        int(pair_shards),
        int(max(8, pair_shards // PER_WORDS)),
        _hot_contexts(texts),
    )
    rows = (
        texts.select("text")
        .mapInArrow(_count(layout), COUNTED)
        .groupBy("shard")
        .applyInPandas(_pairs(layout), COUNTED)
        .groupBy("shard")
        .applyInPandas(_words(layout), STATS)
        .collect()
    )
    add = lambda name: tuple(sum(x) for x in zip([0] * 4, *(r[name] for r in rows), strict=True))
    return Model(
        layout,
        sum(r.tokens for r in rows),
        sum(r.words for r in rows),
        sum(r.kinds for r in rows),
        add("n"),
        add("pair_n"),
        next((bytes(r.hot) for r in rows if r.hot), b""),
    )


# Scoring.


class Scorer:
    """A model's mapped files and what scores are made of."""

    def __init__(self, model: Model):
        self.model = model
        self.files: dict[str, list[np.ndarray]] = {}
        self.d_pair, self.d_word = discounts(list(model.pair_n)), discounts(list(model.n))
        self.hot = unpacked(model.hot) if model.hot else [np.zeros(0, np.uint64)] * 5
        n1, n2 = model.n[:2]
        rest = max(0, model.words - n1 - n2)
        left = float(self.d_word[1:] @ np.array([n1, n2, rest]))
        self.unseen = 1 / (model.words + 1)
        self.floor = left / model.kinds * self.unseen if model.kinds else self.unseen

    def file(self, name: str) -> list[np.ndarray]:
        if name not in self.files:
            try:
                self.files[name] = unpacked(mapped(f"{self.model.layout.folder}/{name}"))
            except FileNotFoundError:  # a shard without pairs or words has no file
                self.files[name] = []
        return self.files[name]

    def look(self, kind: str, shards: np.ndarray, asked: np.ndarray, keys: int, *columns: int) -> list[np.ndarray]:
        """Columns of the rows whose key is asked for; 0 where there is none. Sorted shards."""
        out = [np.zeros(len(asked), np.uint64) for _ in columns]
        heads = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(asked) else []
        for a, b in zip(heads, [*heads[1:], len(asked)], strict=True):
            arrays = self.file(f"{kind}-{int(shards[a])}")
            if arrays and len(arrays[keys]):
                at = is_in(asked[a:b], arrays[keys])
                found = at >= 0
                for o, c in zip(out, columns, strict=True):
                    o[a:b][found] = arrays[c][at[found]]
        return out

    def token_scores(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: known, base log10 probability, the model's log10 probability."""
        layout, model = self.model.layout, self.model
        own, of = np.unique(words, return_inverse=True)
        raw, kinds = self.look("words", word_shard(own, layout.word_shards), own, 0, 1, 2)
        base = np.log10((raw + 1.0) / (model.tokens + model.words + 1.0))
        a = kinds.astype(float)
        lower = self.floor + np.maximum(a - self.d_word[np.minimum(kinds, 3).astype(int)], 0) / max(model.kinds, 1)
        # contexts: every word, and the start mark behind them
        contexts = np.r_[own, np.uint64(START)]
        shard = pair_shard(mixed(contexts) & ~np.uint64((1 << (64 - PLACE)) - 1), layout.pair_shards)
        order = np.argsort(shard, kind="stable")
        found = self.look("pairs", shard[order], contexts[order], 1, 2, 4, 5, 6)
        stats = [np.zeros(len(contexts)) for _ in range(4)]
        for s, f in zip(stats, found, strict=True):
            s[order] = f
        at = is_in(contexts, self.hot[0])
        for s, h in zip(stats, self.hot[1:], strict=True):
            s[at >= 0] = h[at[at >= 0]]
        total = stats[0]
        gamma = np.where(total > 0, (np.stack(stats[1:], 1) @ self.d_pair[1:]) / np.maximum(total, 1), 1.0)
        place = np.r_[0, of[:-1]]
        place[starts] = len(own)
        keys, which = np.unique(pair_keys(contexts[place], words, layout.hot), return_inverse=True)
        (c,) = self.look("pairs", pair_shard(keys, layout.pair_shards), keys, 0, 3)
        c = c[which]
        upper = np.maximum(c - self.d_pair[np.minimum(c, 3).astype(int)], 0) / np.maximum(total[place], 1)
        return raw[of] > 0, base[of], np.log10(upper + gamma[place] * lower[of])


#: The scorer of the model that a worker used last, by the model's folder.
_KEPT: dict[str, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    folder = model.layout.folder
    if folder not in _KEPT:
        _KEPT.clear()
        _KEPT[folder] = Scorer(model)
    return _KEPT[folder]


def _score(model: Model):
    def out(scorer: Scorer, ids: list, held: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(p) for p in parts])
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        known, base, score = scorer.token_scores(np.concatenate(parts), starts)
        per = lambda x: np.add.reduceat(x, starts)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays(ids),
                pa.concat_arrays(held),
                pa.array(sizes, pa.int64()),
                pa.array(per(known.astype(np.int64)), pa.int64()),
                pa.array(np.full(len(parts), model.tokens), pa.int64()),
                pa.array(per(base), pa.float64()),
                pa.array(per(score), pa.float64()),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        ids, held, parts, size = [], [], [], 0
        for batch in batches:
            done = 0
            for i, text in enumerate(batch.column("text")):
                parts.append(tokens(text.as_py()))
                size += len(parts[-1])
                if size >= SCORED or i + 1 == batch.num_rows:
                    ids.append(batch.column("doc_id").slice(done, i + 1 - done))
                    held.append(batch.column("held_out").slice(done, i + 1 - done))
                    done = i + 1
                if size >= SCORED:
                    yield out(scorer, ids, held, parts)
                    ids, held, parts, size = [], [], [], 0
        if parts:
            yield out(scorer, ids, held, parts)

    return run


def scored(documents: DataFrame, folds: int = 7, out: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity)."""
    remainder = fold(F.col("doc_id"), folds)
    model = learn(documents, remainder != out)
    kept = documents.select("doc_id", F.coalesce(remainder == out, F.lit(False)).alias("held_out"), "text")
    kind = dict(kept.dtypes)["doc_id"]
    return kept.mapInArrow(
        _score(model),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
