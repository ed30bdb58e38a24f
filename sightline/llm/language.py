"""Language identification with a byte convolutional network.

A text's bytes, A to Z in lower case, are cut into overlapping windows of a fixed length. Bytes
are embedded; filters of several widths run over a window, each filter's largest answer is kept
and passed through a rectifier; a softmax layer names the language. A text's scores are the
mean over all of its windows, weighted by their bytes. The network is trained with numpy on the
driver, from windows of at most ``FIT_TEXTS`` labelled texts per language, and travels to the
workers inside the task; texts are scored in Arrow batches of windows, without a shuffle.

The learned weights are rounded to binary fractions so coarse that every product and every sum of
a score is exact, and windows are added up as integers: a text has the same score in whatever
row, batch or partition it stands.

Edge cases: a null text, or one without a letter, is ``und`` with score 0. So is every text if
nothing was learned. With one language learned, that language is given with score 1. Rows
without lang are not learned from; a null doc_id is neither learned from nor held out. Repeated
rows are judged one by one and alike; equal texts under one doc_id are learned from once, and
different ones each count as a text. A text of any length is read in all its windows. Languages of equal score: the first in
the order of names. Columns besides those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LENGTH = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDED = 8
#: At most so many texts of a language are learned from: those with the smallest hash of doc_id.
FIT_TEXTS = 250
#: Windows taken from each of them, evenly over the whole text.
FIT_WINDOWS = 8
#: Windows scored at once.
BATCH = 512
#: A window's scores are counted in so many parts of one.
PARTS = 1 << 24
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def windows(text: str, length: int = LENGTH) -> np.ndarray:
    """The byte windows of a whole text; the last is filled with zeros. Neighbours overlap by
    one byte less than the widest filter, so no filter misses a place."""
    data = np.frombuffer(text.encode().lower(), np.uint8)
    step = length - max(WIDTHS) + 1
    n = max(1, -(-(len(data) - (length - step)) // step))
    filled = np.zeros((n - 1) * step + length, np.uint8)
    filled[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(filled, length)[::step]


@dataclass
class Network:
    """Weights; ``kernels`` has a row block of EMBEDDED per offset and a column per filter."""

    languages: list[str]
    bytes_in: np.ndarray
    kernels: list[np.ndarray]
    shifts: list[np.ndarray]
    out: np.ndarray
    base: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.bytes_in, *self.kernels, *self.shifts, self.out, self.base]

    def pooled(self, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest answer in each window and where it was."""
        n, length = batch.shape
        x = self.bytes_in[batch].reshape(n, length * EMBEDDED)
        best, place = [], []
        for width, kernel, shift in zip(WIDTHS, self.kernels, self.shifts, strict=True):
            view = np.lib.stride_tricks.sliding_window_view(x, width * EMBEDDED, axis=1)[:, ::EMBEDDED]
            answers = view.reshape(-1, width * EMBEDDED) @ kernel
            answers = answers.reshape(n, length - width + 1, FILTERS)
            place.append(answers.argmax(axis=1))
            best.append(np.take_along_axis(answers, place[-1][:, None], 1)[:, 0] + shift)
        return np.hstack(best), np.hstack(place)

    def scores(self, batch: np.ndarray) -> np.ndarray:
        """Softmax over languages per window; of a ``settled`` network, exact up to the exponentials."""
        n, length = batch.shape
        x = self.bytes_in[batch].reshape(n, length * EMBEDDED)
        best = []
        for width, kernel, shift in zip(WIDTHS, self.kernels, self.shifts, strict=True):
            view = np.lib.stride_tricks.sliding_window_view(x, width * EMBEDDED, axis=1)[:, ::EMBEDDED]
            answers = (view.reshape(-1, width * EMBEDDED) @ kernel).reshape(n, -1, FILTERS)
            best.append(answers.max(axis=1).astype(np.float64) + shift)
        return _softmax(np.maximum(np.hstack(best), 0) @ self.out.astype(np.float64) + self.base)

    def settled(self) -> Network:
        """The weights rounded so that products and sums have no rounding of their own.

        A float32 holds 24 bits: an answer sums at most 32 products of 9 and 9 bits. The layer above
        is summed in float64, of which it fills 45 of 53.
        """
        near = lambda w, bits, most: np.clip(np.rint(w * 2.0**bits) / 2.0**bits, -most, most)
        small = lambda w, bits, most: near(w, bits, most).astype(np.float32)
        return Network(
            self.languages,
            small(self.bytes_in, 7, 4 - 2**-7),
            [small(k, 8, 2 - 2**-8) for k in self.kernels],
            [near(s, 15, 64) for s in self.shifts],
            near(self.out, 12, 16),
            near(self.base, 20, 64),
        )


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fresh(languages: list[str], seed: int = 0) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    return Network(
        languages,
        rng.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32),
        [draw(w * EMBEDDED, FILTERS) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        draw(len(WIDTHS) * FILTERS, len(languages)),
        np.zeros(len(languages), np.float32),
    )


def gradients(net: Network, batch: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross entropy, in the order of ``weights``."""
    n = len(batch)
    best, place = net.pooled(batch)
    active = np.maximum(best, 0)
    error = _softmax(active @ net.out + net.base)
    error[np.arange(n), wanted] -= 1
    error /= n
    back = (error @ net.out.T) * (best > 0)
    d_in = np.zeros_like(net.bytes_in)
    d_kernels, d_shifts = [], []
    rows = np.arange(n)[:, None]
    for i, (width, kernel) in enumerate(zip(WIDTHS, net.kernels, strict=True)):
        own = slice(i * FILTERS, (i + 1) * FILTERS)
        d, at = back[:, own], place[:, own]
        d_kernel = np.zeros_like(kernel)
        for j in range(width):
            part = slice(j * EMBEDDED, (j + 1) * EMBEDDED)
            seen = batch[rows, at + j]
            d_kernel[part] = np.einsum("nf,nfe->ef", d, net.bytes_in[seen])
            np.add.at(d_in, seen.ravel(), (d[:, :, None] * kernel[part].T[None]).reshape(-1, EMBEDDED))
        d_kernels.append(d_kernel)
        d_shifts.append(d.sum(axis=0))
    return [d_in, *d_kernels, *d_shifts, active.T @ error, error.sum(axis=0)]


def trained(rows: np.ndarray, wanted: np.ndarray, languages: list[str], steps: int = 700, size: int = 128, rate: float = 0.01) -> Network:
    """Adam on batches with every language alike often; the same for the same rows."""
    net = fresh(languages)
    rng = np.random.default_rng(1)
    by = [np.flatnonzero(wanted == k) for k in range(len(languages))]
    weights = net.weights()
    means = [np.zeros_like(w) for w in weights]
    squares = [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        which = rng.integers(0, len(languages), size)
        picked = np.array([by[k][rng.integers(0, len(by[k]))] for k in which])
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, s in zip(weights, gradients(net, rows[picked], wanted[picked]), means, squares, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            w -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def fold(doc_id: Column, folds: int) -> Column:
    """The remainder of the CRC-32 of doc_id as text."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, ids, numbers, data = [], [], [], []
        for lang, doc, text in zip(
            batch.column("lang").to_pylist(), batch.column("rank").to_pylist(), batch.column("text"), strict=True
        ):
            cut = windows(text.as_py())
            for k in np.unique(np.linspace(0, len(cut) - 1, FIT_WINDOWS).astype(int)):
                langs.append(lang)
                ids.append(doc)
                numbers.append(int(k))
                data.append(cut[k].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(ids, pa.int32()), pa.array(numbers, pa.int32()), pa.array(data, pa.binary())],
            names=["lang", "rank", "number", "data"],
        )


def learn(documents: DataFrame, allowed: Column, bound: int = FIT_TEXTS) -> Network | None:
    """The network learned from at most ``bound`` texts per language among ``allowed`` rows."""
    usable = documents.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull())
    named = usable.where(F.length("text") > 0).select("lang", "doc_id", F.xxhash64("text").alias("mark"), "text")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "mark")
    # only ids and marks are ranked, each once; the rank filter limits each task before the shuffle
    picked = (
        named.select("lang", "doc_id", "mark")
        .distinct()
        .select("*", F.row_number().over(order).cast("int").alias("rank"))
        .where(F.col("rank") <= bound)
    )
    rows = (
        named.join(F.broadcast(picked), ["lang", "doc_id", "mark"])
        .groupBy("lang", "rank")
        .agg(F.first("text").alias("text"))
        .mapInArrow(_sampled, "lang string, rank int, number int, data binary")
        .collect()
    )
    rows = sorted({(r.lang, r["rank"], r.number, bytes(r.data)) for r in rows})
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, LENGTH)
    wanted = np.array([languages.index(r[0]) for r in rows])
    return trained(data, wanted, languages).settled()


def predicted(net: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    names, sure = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if net is None:
        return names, sure
    judged = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    totals = np.zeros((len(texts), len(net.languages)), np.int64)
    held: list[np.ndarray] = []
    owners: list[np.ndarray] = []

    def flush() -> None:
        if not held:
            return
        rows, of = np.concatenate(held), np.concatenate(owners)
        weight = (rows != 0).sum(axis=1)
        for a in range(0, len(rows), BATCH):
            scores = np.rint(net.scores(rows[a : a + BATCH]) * PARTS).astype(np.int64)
            np.add.at(totals, of[a : a + BATCH], scores * weight[a : a + BATCH, None])
        held.clear()
        owners.clear()

    size = 0
    for i in judged:
        cut = windows(texts[i])
        for a in range(0, len(cut), 8 * BATCH):
            part = cut[a : a + 8 * BATCH]
            held.append(part)
            owners.append(np.full(len(part), i))
            size += len(part)
            if size >= 8 * BATCH:
                flush()
                size = 0
    flush()
    for i in judged:
        share = totals[i] / max(int(totals[i].sum()), 1)
        best = int(share.argmax())
        names[i], sure[i] = net.languages[best], float(min(1.0, share[best]))
    return names, sure


def _predict(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names, sure = predicted(net, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("held_out"),
                        pa.array(names, pa.string()),
                        pa.array(sure, pa.float64()),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return run


def identified(documents: DataFrame, folds: int = 4, held: int = 2, bound: int = FIT_TEXTS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learned from the rows that are not held out."""
    remainder = fold(F.col("doc_id"), folds)
    net = learn(documents, remainder != held, bound)
    kept = documents.select("doc_id", F.coalesce(remainder == held, F.lit(False)).alias("held_out"), "text")
    kind = dict(kept.dtypes)["doc_id"]
    return kept.mapInArrow(_predict(net), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
