import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import language
from tests.llm.conftest import CLASHING

SYLLABLES = {
    "aa": "the and ing ion ent her tha nth".split(),
    "bb": "der sch ung ich ein und zu ß".split(),
    "cc": "que les ção não às um é".split(),
}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy(documents):
    rng = random.Random(4)
    data = [(i, text(rng, lang, rng.randrange(5, 80)), lang) for i, lang in enumerate(sorted(SYLLABLES) * 60)]
    found = {r.doc_id: r for r in language.identified(documents(data)).collect()}
    held = [(i, lang) for i, _, lang in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in found if found[i].held_out} == {i for i, _ in held}
    assert np.mean([found[i].lang_pred == lang for i, lang in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_prediction_uses_the_text_alone_and_all_of_it(documents):
    rng = random.Random(5)
    data = [(i, text(rng, lang, 30), lang) for i, lang in enumerate(sorted(SYLLABLES) * 30)]
    # a start in one language, then far more of another, labelled wrongly
    long = text(rng, "aa", 40) + " " + text(rng, "bb", 4000)
    data.append((900, long, None))
    data.append((901, long, "cc"))
    found = {r.doc_id: r for r in language.identified(documents(data)).collect()}
    assert found[900].lang_pred == "bb" and found[900].score == found[901].score


def test_odd_rows(documents, odd_rows):
    rng = random.Random(6)
    learned = [(100 + i, text(rng, lang, 30), lang) for i, lang in enumerate(sorted(SYLLABLES) * 20)]
    data = [*learned, *((i, t, None) for i, t in odd_rows), (8, "123 !?  ", None), (9, None, "aa")]
    found = language.identified(documents(data, CLASHING)).collect()
    assert len(found) == len(data)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    for i in (1, 2, 3, 8, 9):
        assert by[i] == [("und", 0.0)]
    assert by[5][0] == by[5][1] and by[5][0][0] in SYLLABLES
    assert not [r for r in found if r.doc_id is None and r.held_out]


def test_nothing_or_one_language_learned(documents):
    assert language.identified(documents([])).count() == 0
    assert [r.lang_pred for r in language.identified(documents([(1, "abc", None)])).collect()] == ["und"]
    only = language.identified(documents([(i, "some words", "xx") for i in range(8)])).collect()
    assert {(r.lang_pred, r.score) for r in only} == {("xx", 1.0)}


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = language.fresh(["a", "b", "c"])
    for name in ("bytes_in", "out", "base"):
        setattr(net, name, getattr(net, name).astype(float))
    net.kernels = [k.astype(float) for k in net.kernels]
    net.shifts = [s.astype(float) + 0.1 for s in net.shifts]
    rows, wanted = rng.integers(97, 123, (4, 20)).astype(np.uint8), np.array([0, 1, 2, 1])
    loss = lambda: -np.log(net.scores(rows)[np.arange(4), wanted]).mean()
    for w, g in zip(net.weights(), language.gradients(net, rows, wanted), strict=True):
        for flat in rng.choice(w.size, 3):
            at = np.unravel_index(np.abs(g).argmax() if flat % 2 else flat, w.shape)
            old = w[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_windows_cover_every_filter_place():
    for n in (0, 1, 127, 128, 129, 253, 254, 1000):
        data = ("x" * n).encode()
        cut = language.windows("x" * n)
        assert cut.shape[1] == language.LENGTH
        step = language.LENGTH - max(language.WIDTHS) + 1
        covered = {i * step + j for i in range(len(cut)) for j in range(language.LENGTH - max(language.WIDTHS) + 1)}
        assert set(range(max(0, len(data) - max(language.WIDTHS) + 1))) <= covered
        assert len(cut) == 1 or (cut[-1] != 0).any()


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_scores_do_not_depend_on_partitions(spark, documents, parts):
    rng = random.Random(12)
    data = [(i, text(rng, lang, rng.randrange(1, 60)), lang) for i, lang in enumerate(sorted(SYLLABLES) * 40)]
    whole = {r.doc_id: r.score for r in language.identified(documents(data)).collect()}
    dealt = documents(data).repartition(parts)
    assert {r.doc_id: r.score for r in language.identified(dealt).collect()} == whole


def test_copies_of_an_id_do_not_lift_the_bound(spark, documents, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "trained", lambda rows, wanted, languages: seen.append(len(rows)) or language.fresh(languages))
    rng = random.Random(13)
    own = text(rng, "aa", 10)
    data = [(1, own, "aa")] * 10_000 + [(i, text(rng, "bb", 10), "bb") for i in range(2, 40)]
    language.learn(documents(data), F.lit(True), 20)
    assert seen[0] <= (1 + 20) * language.FIT_WINDOWS
