import hashlib
import random

import numpy as np
import pytest
import tokenizers

from sightline.llm import bpe
from sightline.llm.common import vocabulary
from tests.llm.conftest import CLASHING

PATH = vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts():
    rng = random.Random(12)
    pieces = ["<|endoftext|>", "<|startoftext|>", " ", "x", "don't I'LL", "Σ Σας", "İ", "\x1c", "\x85", "​", "\U0001f600", "é", "aaaaaaa", "!!!!?"]
    out = ["", " ", "a", "<|endoftext|>", "12 345", "'s''t"]
    for _ in range(400):
        out.append("".join(rng.choice("abt") for _ in range(rng.randrange(1, 20))))
        out.append("".join(rng.choice("etaoinshrdlu'") for _ in range(rng.randrange(1, 30))))
        out.append("".join(rng.choice(pieces) for _ in range(8)))
        out.append("a" * rng.randrange(1, 120) + rng.choice(["", "hhhh", "..."]))
    return out


def test_equal_to_the_library(library):
    own = bpe.Tokenizer(PATH)
    for text in odd_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        got = own.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == ids, ascii(text)
        assert own.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_automaton_equals_merging_by_rank():
    """On small random merge lists, where dead ends are frequent."""
    rng = random.Random(13)
    for _ in range(60):
        tokens, merges = ["a", "b", "c"], []
        while len(merges) < 12:
            pair = (rng.choice(tokens), rng.choice(tokens))
            if pair[0] + pair[1] not in tokens:
                merges.append(pair)
                tokens.append(pair[0] + pair[1])
        ids = {t: i for i, t in enumerate(tokens)}
        own = bpe.Automaton(ids, merges)
        own.spell_by("")
        for _ in range(60):
            word = "".join(rng.choice("aab" if rng.random() < 0.5 else "abc") for _ in range(rng.randrange(1, 14)))
            parts = list(word)
            for a, b in merges:
                i = 0
                while i < len(parts) - 1:
                    if parts[i] == a and parts[i + 1] == b:
                        parts[i : i + 2] = [a + b]
                    i += 1
            assert [own.labels[t] for t in own.encode(word)] == parts


def test_full_tables_start_anew(monkeypatch, library):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 3)
    monkeypatch.setattr(bpe, "ARCS_KEPT", 2)
    text = "whatever words there are to be encoded again whatever words there are"
    got = np.frombuffer(bpe.Tokenizer(PATH).encode(text), "<u4").tolist()
    assert got == library.encode(text, add_special_tokens=False).ids


def test_digests_of_odd_rows(documents, odd_rows, library):
    found = bpe.digests(documents(odd_rows, CLASHING), PATH).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for i, t in odd_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((str(i), len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded.encode())))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted(expected)
    assert bpe.digests(documents([]), PATH).count() == 0


def test_columns_are_passed_through_and_replaced(documents):
    found = bpe.coded(documents([(1, "The end")], CLASHING), PATH)
    assert found.columns == [*documents([], CLASHING).drop("token_ids").columns, "token_ids", "decoded"]
    row = found.first()
    assert row.decoded == "the</w> end</w>" and len(row.token_ids) == 2 and row.words == "x"
