import math

import numpy as np
import public_tokenizers as P
import pytest

from rankflow.llm import langid

PATH = P.path("piece_bpe_32k.model")


def brute(word, table, vocabulary):
    """Sum over all segmentations, by recursion."""
    total = 0.0
    for part in [("▁" + word)[i : i + langid.SLICE] for i in range(0, len(word) + 1, langid.SLICE)]:

        def rest(i, part=part):
            if i == len(part):
                return 1.0
            out = sum(table[vocabulary[part[i:j]]] * rest(j) for j in range(i + 1, len(part) + 1) if part[i:j] in vocabulary)
            return out + (langid.UNKNOWN * rest(i + 1) if part[i] not in vocabulary else 0.0)

        total += math.log(rest(0))
    return total


def test_forward_sums_all_segmentations():
    automaton, size = langid._automaton(PATH)
    vocabulary = {piece: number for piece, (_, number) in automaton.items()}
    table = np.random.default_rng(1).random((size + 1, 2)) * 1e-3
    table[size] = langid.UNKNOWN
    words = ["a", "the", "straße", "zzxq", "Ωa", "international", "häuser", "中a文"]
    got = langid.log_likelihoods(words, table, PATH)
    for k, word in enumerate(words):
        assert got[k].tolist() == pytest.approx([brute(word, table[:, c], vocabulary) for c in range(2)])
    assert langid.log_likelihoods([], table, PATH).shape == (0, 2)
    long = "abc" * 400
    assert np.isfinite(langid.log_likelihoods([long], table, PATH)).all()


TEXTS = {"en": "the house and the garden of this town are where they think about the weather", "de": "das haus und der garten dieser stadt sind wo sie über das wetter nachdenken", "fr": "la maison et le jardin de cette ville sont où ils pensent au temps"}


def corpus(spark):
    rows = []
    for k, (lang, text) in enumerate(TEXTS.items()):
        words = text.split()
        rows += [(100 * k + i, " ".join(words[i % 5 :] + words[: i % 7]), lang) for i in range(30)]
    return spark.createDataFrame([*rows, (900, None, "en"), (901, "no label", None)], "doc_id long, text string, lang string")


def test_held_out_texts(spark):
    model = langid.fit(corpus(spark), PATH)
    assert model["languages"] == ["de", "en", "fr"]
    rows = [(1, "they think of the town", "x"), (2, "der garten dieser stadt", "x"), (3, "le jardin et la ville", "x"), (4, None, "x"), (5, " 12 .", "x"), (6, "", "x"), (6, "", "x"), (7, "der garten " * 20000, "x")]
    got = langid.predict(spark.createDataFrame(rows, "doc_id long, text string, SCORE string"), model, PATH).collect()
    assert [(r.doc_id, r.lang_pred) for r in sorted(got, key=lambda r: r.doc_id)] == [(1, "en"), (2, "de"), (3, "fr"), (4, "und"), (5, "und"), (6, "und"), (6, "und"), (7, "de")]
    assert all(0 <= r["score"] <= 1 for r in got)


def test_no_labels(spark):
    model = langid.fit(corpus(spark).where("lang = 'none'"), PATH)
    assert {r.lang_pred for r in langid.predict(corpus(spark), model, PATH).collect()} == {"und"}


def test_copies_and_blank_texts_leave_room_for_every_language(spark):
    """Copies count once and blank texts not at all, and no language takes the room of another."""
    rows = [(t, lang) for lang, text in TEXTS.items() for t in (f"{text} {chr(97 + i)}" for i in range(3))]
    rows += [(" ".join(["the house and", chr(97 + i // 26), chr(97 + i % 26)]), "en") for i in range(300)]
    rows += [(t, lang) for lang in TEXTS for t in ("", " 12 .", "copied text of this place") for _ in range(200)]
    for limit in (3, 6, 9):
        model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), PATH, max_train_docs=limit)
        assert model["languages"] == ["de", "en", "fr"]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), PATH, max_train_docs=1)
    assert model["languages"] == ["de", "en", "fr"]  # one text of each, at least
    held = spark.createDataFrame([("der garten dieser stadt",), ("le jardin de cette ville",)], "text string")
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), PATH, max_train_docs=12)
    assert [r.lang_pred for r in langid.predict(held, model, PATH).collect()] == ["de", "fr"]


def test_long_words_are_summed_whole():
    automaton, size = langid._automaton(PATH)
    vocabulary = {piece: number for piece, (_, number) in automaton.items()}
    table = np.random.default_rng(2).random((size + 1, 2)) * 1e-3
    table[size] = langid.UNKNOWN
    for word in ("donaudampfschifffahrtsgesellschaft", "a" * 23, "a" * 24, "Ω" * 30 + "house"):
        forward = np.zeros((len(word) + 2, 2))
        forward[0], text = 1.0, "▁" + word
        for end in range(1, len(text) + 1):
            for start in range(end):
                if text[start:end] in vocabulary:
                    forward[end] += forward[start] * table[vocabulary[text[start:end]]]
            if text[end - 1] not in vocabulary:
                forward[end] += forward[end - 1] * langid.UNKNOWN
        got = langid.log_likelihoods(["the", word, "of"], table, PATH)
        assert got[1] == pytest.approx(np.log(forward[len(text)]))
        assert got[[0, 2]] == pytest.approx(langid.log_likelihoods(["the", "of"], table, PATH))
    p = lambda k: float(table[k, 0])
    short, ends = "gesellschaft", langid._matches(automaton.iter, "▁gesellschaft")
    assert dict(langid._long_expected(ends, p)) == pytest.approx(dict(langid._expected(short, p, PATH)))
    used = langid._expected("ab" * 3000, p, PATH)
    length = {number: len(piece) for piece, number in vocabulary.items()}
    assert sum(n * length[k] for k, n in used.items()) == pytest.approx(6001)


def test_expected_counts_of_many_words_at_once():
    automaton, size = langid._automaton(PATH)
    table = np.random.default_rng(3).random((2, size)) * 1e-3
    words = ["the", "gesellschaft", "Ωa", "中a文", "a", "donaudampfschifffahrtsgesellschaft", "the"]
    languages, counts, got, want = np.array([0, 1, 1, 0, 0, 1, 1]), np.array([3, 1, 2, 1, 1, 5, 4]), np.zeros((2, size)), np.zeros((2, size))
    langid.add_expected(got, words, languages, counts, table, PATH)
    for word, x, n in zip(words, languages, counts):
        for k, used in langid._expected(word, lambda k, x=x: table[x, k], PATH).items():
            want[x, k] += n * used
    assert got == pytest.approx(want)
    langid.add_expected(got, [], languages[:0], counts[:0], table, PATH)
    assert got == pytest.approx(want)


def test_texts_without_a_letter(spark):
    model = langid.fit(corpus(spark), PATH)
    texts = ["½ ²", "①", "Ⅷ", "三½", "x²y", "½"]
    assert langid.words_of("x²y Ⅷ") == ["x", "y"]
    got = langid.predict(spark.createDataFrame([(t,) for t in texts], "text string"), model, PATH).collect()
    assert [r.lang_pred == "und" for r in got] == [True, True, True, False, False, True]
    assert langid.predict(spark.createDataFrame([], "text string"), model, PATH).count() == 0
    blank = langid.fit(spark.createDataFrame([("½", "en")], "text string, lang string"), PATH)
    assert blank["languages"] == []
