"""Language identification: held-out accuracy, what is learned from, odd rows, and predictions that depend on the text alone."""

import random
import zlib

import numpy as np
import pytest

from codeloom.llm import language_id

SYLLABLES = {"en": "the ing tion and er re on at sh wh", "de": "sch ung der ein ge ver ß ich te auf", "fr": "eau oi les que é è ment aux ch tre", "es": "ción ñ os ar que í do ra ll ez", "xx": "ka ki ku mo ma ne no ra ri tsu"}


def text(rng, lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(s, k=rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "s", 0.5) for r in rows], "doc_id long, text string, lang string, source string, score double")


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choices(list(SYLLABLES), [30, 5, 5, 3, 2])[0]
        rows.append((i, text(rng, lang, rng.choice([6, 20, 90])), lang))
    return rows


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy(spark, tmp_path):
    rows = corpus()
    odd = [(2000, None, "en"), (2001, "", "de"), (2002, " 12 .-\n", "fr"), (None, rows[0][1], "es"), (2003, rows[1][1] * 3000, None), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2])]
    docs_of(spark, rows + odd).write.parquet(str(tmp_path / "documents.parquet"))
    out = language_id.op11_language_id(spark, str(tmp_path)).collect()
    assert len(out) == len(rows + odd) and {r.doc_id for r in out} == {r[0] for r in rows + odd}
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in out)
    found = {r.doc_id: r for r in out}
    assert [found[i].lang_pred for i in (2000, 2001, 2002)] == ["und"] * 3 and [found[i].score for i in (2000, 2001, 2002)] == [0.0] * 3
    assert found[None].lang_pred == rows[0][2] and found[2003].lang_pred == rows[1][2]
    test = [r for r in rows if held(r[0])]
    assert np.mean([found[i].lang_pred == lang for i, _, lang in test]) > 0.98
    assert {found[i].lang_pred for i, _, _ in test} == set(SYLLABLES)  # the rare ones too
    assert len({(r.lang_pred, r.score) for r in out if r.doc_id == 5}) == 1


def test_held_out_rows_teach_nothing(spark):
    """Wrong labels on rows that are held out, or without an id or label, change no prediction."""
    rows = corpus(400)
    model = language_id.fitted(docs_of(spark, rows))
    wrong = [(i, t, "xx" if held(i) else lang) for i, t, lang in rows] + [(None, t, "zz") for _, t, _ in rows[:50]] + [(10_000 + i, t, None) for i, t, _ in rows[:50]]
    again = language_id.fitted(docs_of(spark, wrong))
    assert again.languages == model.languages and (again.weights == model.weights).all() and again.slopes == model.slopes


def test_family_first():
    rng = random.Random(1)
    texts = [(lang, text(rng, lang, 40)) for lang in SYLLABLES for _ in range(20)]
    model = language_id.Model(np.array([language_id.counts(t) for _, t in texts], np.float32), [v for v, _ in texts])
    assert model.families == {"germanic": ["de", "en"], "language xx": ["xx"], "romance": ["es", "fr"]}
    assert [(f, [(a, b) for a, b, _ in p]) for f, p in model.pairs.items()] == [("germanic", [("de", "en")]), ("romance", [("es", "fr")])]
    # the pair machines of one family are not asked about a text of another
    for f, pairs in model.pairs.items():
        for _, _, row in pairs:
            model.weights[row] = -model.weights[row]
        others = [(v, t) for v, t in texts if language_id.family_of(v) != f and v != "xx"]
        assert np.mean([language_id.family_of(model.predict(t)[0]) == language_id.family_of(v) for v, t in others]) == 1


def test_machine_separates_with_the_widest_margin():
    x = np.array([[0.0, 1.0], [0.0, 2.0], [0.0, -1.0], [3.0, -1.0]])
    factors = language_id.machine(x @ x.T + 1, np.array([1, 1, -1, -1]), np.array(list("aabb")))
    assert np.allclose([*(factors @ x), factors.sum()], [0, 1, 0], atol=0.02)


@pytest.mark.parametrize("piece", [1, 5, 64])
def test_whole_texts_in_pieces(monkeypatch, piece):
    t = "Straße, 12 Äpfel…\n\nİstanbul " + "ab" * 50
    whole = language_id.counts(t)
    n = len(language_id.symbols(t))
    assert whole.sum() == sum(n - k for k in range(language_id.LONGEST_GRAM))
    monkeypatch.setattr(language_id, "PIECE", piece)
    assert (language_id.counts(t) == whole).all()


def test_few_languages(spark):
    rows = corpus(60)
    assert {r["__lang"] for r in language_id.predicted(docs_of(spark, rows), language_id.fitted(docs_of(spark, []))).collect()} == {"und"}
    one = language_id.fitted(docs_of(spark, [(i, t, "en") for i, t, _ in rows]))
    out = language_id.predicted(docs_of(spark, rows), one)
    assert {(r["__lang"], r["__score"]) for r in out.collect()} == {("en", 1.0)}
    assert out.columns == ["doc_id", "text", "lang", "source", "score", "__lang", "__score"]
    assert language_id.predicted(docs_of(spark, []), one).count() == 0
