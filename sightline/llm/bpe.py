"""BPE encoding and decoding with a tokenization automaton.

``Automaton`` compiles the merge list one gadget at a time, in rank order. It starts with one
state per base symbol, each followed by every symbol. The gadget of merge (u, v) at rank k

* cuts the arc from state u to v: from rank k on, that pair is always joined;
* adds state uv. It is entered where u could be entered while u and v were still apart, and
  leaves like v, except for arcs cut later for uv itself.

A state is the last token read and an arc's label the next token. The automaton is
deterministic in its labels, and a text's BPE tokenization is the one path whose labels spell
it. States inherit arcs rather than copy them; an arc looked up once stays in the transition
table. ``encode`` walks a word through the table, the longest label first and backing out of
dead ends; ``decode`` emits the labels of the arcs.

Texts are normalised and cut into words as the vocabulary file says (canonical composition,
lower case, words of letters, single digits, other signs; white space is dropped; special
tokens are found first in the raw text). A worker reads the vocabulary file once, by path,
and codes the texts of Arrow batches; no shuffle. The table of finished words has a bounded
number of entries, after which it starts anew; results do not depend on it.

Edge cases: null and empty texts have no tokens; their decoded text is empty. Repeated rows
are coded one by one. Columns besides those named are passed through.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words kept with their tokens by each worker.
WORDS_KEPT = 600_000
#: Arcs kept in the transition table by each worker.
ARCS_KEPT = 1_000_000


def byte_symbols() -> dict[int, str]:
    """One printable character per byte: itself where it is one, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Automaton:
    """States and arcs of a merge list; tokens are numbers, ``labels`` their strings."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.labels = {i: s for s, i in vocab.items()}
        self.ids = vocab
        self.cut: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.arcs: dict[tuple[int, int], bool] = {}
        self.entered = set(vocab.values()) - {vocab[a + b] for a, b in merges}
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, vocab[a], vocab[b], vocab[a + b])

    def _gadget(self, rank: int, u: int, v: int, joined: int) -> None:
        """Joins ``u`` and ``v`` from ``rank`` on. A join whose arc is gone adds nothing."""
        if u not in self.entered or v not in self.entered or not self._open(u, v):
            return
        self.cut[u, v] = rank
        self.parts[joined] = (u, v, rank)
        self.entered.add(joined)

    def _open(self, state: int, label: int) -> bool:
        """Whether ``label`` can follow ``state``, by what gadgets cut on either side.

        The pair is taken apart, the token joined last first. Between the inner parts an arc
        must have lived until that join. Of two joins of one rank the left one came first,
        so a right token's parts must have stayed apart through the rank as well.
        """
        before = float("inf")
        while True:
            if self.cut.get((state, label), before) < before:
                return False
            left, right = self.parts.get(state), self.parts.get(label)
            if left is None and right is None:
                return True
            if right is None or left is not None and left[2] > right[2]:
                state, before = left[1], left[2]
            else:
                label, before = right[0], right[2] + 0.5

    def arc(self, state: int, label: int) -> bool:
        key = (state, label)
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= ARCS_KEPT:
                self.arcs.clear()
            found = self.arcs[key] = self._open(state, label)
        return found

    def spell_by(self, end: str) -> None:
        """Lays out the labels as a table of symbols; ``end`` marks a word's last symbol."""
        self.end, self.table = end, {}
        for label in sorted(self.entered):
            string = self.labels[label]
            closing = bool(end) and string.endswith(end) and string != end
            symbols = [*string.removesuffix(end)] if closing else [*string]
            if closing:
                symbols[-1] += end
            node = self.table
            for symbol in symbols:
                node = node.setdefault(symbol, {})
            node[None] = label

    def encode(self, word: str) -> list[int]:
        """The tokens of one word, given as one symbol per byte."""
        symbols = [*word]
        symbols[-1] += self.end
        size, arcs, table = len(symbols), self.arcs, self.table
        path: list[int] = []
        places = [0]
        left: list[list[tuple[int, int]]] = []  # labels still to be tried at each place
        dead: set[tuple[int, int]] = set()  # states and places from which nothing ends
        while True:
            at = places[-1]
            if at == size:
                return path
            if len(left) < len(places):
                node, found = table, []
                for stop in range(at, size):
                    node = node.get(symbols[stop])
                    if node is None:
                        break
                    label = node.get(None)
                    if label is not None:
                        found.append((label, stop + 1))
                left.append(found)
            found = left[-1]
            state = path[-1] if path else None
            while found:
                label, stop = found.pop()
                if dead and (label, stop) in dead:
                    continue
                if state is None:
                    break
                alive = arcs.get((state, label))
                if self.arc(state, label) if alive is None else alive:
                    break
            else:
                # nothing follows this state here: back to the state before
                left.pop()
                places.pop()
                if not path:
                    raise ValueError("the vocabulary cannot spell this word")
                dead.add((path.pop(), at))
                continue
            path.append(label)
            places.append(stop)


class Tokenizer:
    """A vocabulary file's text rules around an automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        vocab = {s: i for s, i in model["vocab"].items() if i < len(model["vocab"])}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.automaton = Automaton({s: i for s, i in vocab.items() if s not in self.special}, merges)
        self.automaton.spell_by(model["end_of_word_suffix"] or "")
        self.labels = self.automaton.labels | {i: s for s, i in self.special.items()}
        split = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words_of = regex.compile(split).findall
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.symbols = byte_symbols()
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        plain = word.isascii() and word.isprintable()  # then symbols and bytes are the same
        symbols = word if plain else "".join([self.symbols[b] for b in word.encode()])
        tokens = np.array(self.automaton.encode(symbols), "<u4").tobytes()
        if len(self.known) >= WORDS_KEPT:
            self.known.clear()
        self.known[word] = tokens
        return tokens

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            # one sign at a time: no other lower case at a word's end
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        known = self.known.get
        return b"".join([known(w) or self._word(w) for w in self.words_of(text.lower())])

    def encode(self, text: str | None) -> bytes:
        """Token ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.marks is None or not any(m in text for m in self.special):
            return self._plain(text)
        out = [
            np.array([self.special[part]], "<u4").tobytes() if i % 2 else self._plain(part)
            for i, part in enumerate(self.marks.split(text))
        ]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The labels of the tokens, in order, with a space between."""
        labels = self.labels
        return " ".join([labels[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


#: What can be given of a text's tokens, and its type.
RESULTS = {
    "token_ids": T.ArrayType(T.IntegerType()),
    "decoded": T.StringType(),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def _column(name: str, ids: list[bytes], texts: list[str]) -> pa.Array:
    if name == "token_ids":
        ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
        flat = np.frombuffer(b"".join(ids), "<i4")
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
    if name == "decoded":
        return pa.array(texts, pa.string())
    if name == "n_tokens":
        return pa.array([len(i) // 4 for i in ids], pa.int64())
    data = ids if name == "ids_sha256" else [t.encode() for t in texts]
    return pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string())


def _coder(path: str, results: tuple[str, ...], kept: list[str]):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            # few texts at a time: what a step holds does not follow the batch's size
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = [own.encode(t.as_py()) for t in part.column("text")]
                texts = [own.decode(i) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in kept), *(_column(r, ids, texts) for r in results)],
                    names=[*kept, *results],
                )

    return code


def coded(documents: DataFrame, path: str, results: tuple[str, ...] = ("token_ids", "decoded")) -> DataFrame:
    """``documents`` with ``results`` of every text; columns of those names are replaced."""
    kept = documents.drop(*results)
    fields = [*kept.schema.fields, *(T.StructField(r, RESULTS[r]) for r in results)]
    return kept.mapInArrow(_coder(path, results, kept.columns), T.StructType(fields))


def digests(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, coded both ways."""
    found = coded(documents.select("doc_id", "text"), path, ("n_tokens", "ids_sha256", "decoded_sha256"))
    return found.drop("text")
