"""Toxic words outside Latin-1."""

import itertools
import random

import numpy as np
import pytest

from tidemark.llm import toxicity


def codes(text):
    found = toxicity.letters([text])
    return found.code.tolist(), found.words.tolist()


@pytest.mark.parametrize("word", ["негодяйка", "παλιάνθρωπος", "وغدحقيرجدا", "大馬鹿野郎"])
def test_words_of_other_scripts_are_learned(word):
    plain = [f"plain words number {i} of a text" for i in range(40)]
    model = toxicity.train([f"you {word} {i}" for i in range(20)] + plain, [1] * 20 + [0] * 40)
    bad, good = model.scores([f"what a {word}", "what a plain text"])
    assert bad > 0.7 > 0.3 > good


def test_letters_fold_alike():
    assert codes("ＩＤＩＯＴ ﬁne") == codes("idiot fine") and codes("école Б") == codes("école б")
    assert codes("łąka　zażółć")[1] == codes("lxaka zazolc")[1] and codes("a\u0085b") == codes("ab")
    assert len(set(map(str, (codes(c) for c in "бгджзилпфцчшщ")))) == 13
    found = toxicity.letters(["日本", None, "x\ud800y", "é ´"])
    assert found.owner.tolist() == [0, 2, 3] and np.max(found.code) == toxicity.EDGE


def brute_features(words):
    """All subsequences of words with an edge before and after, by enumeration, and the norm by lengths alone."""
    found, square = {}, 0.0
    for word in dict.fromkeys(words):
        w = f"|{word}|"
        for places in itertools.combinations(range(len(w)), toxicity.ORDER):
            span = places[-1] - places[0] + 1
            if span <= toxicity.SPAN:
                key = "".join(w[p] for p in places)
                found[key] = found.get(key, 0.0) + toxicity.DECAY**span
                square += toxicity.DECAY ** (2 * span)
    return found, max(square, toxicity.DECAY ** (2 * toxicity.ORDER)) ** 0.5


def test_kernel_equals_enumeration():
    sentences = ["you idiot", "an idixot here", "banana bananas", "a", "ab", "idle idle riot", "some other words here"]
    for a in sentences:
        own = toxicity.letters([a])
        assert len(own.sentences) == 1
        table = np.zeros(toxicity.LETTERS**toxicity.ORDER, np.float32)
        for at, key, weight in toxicity.subsequences(own):
            np.add.at(table, key, np.float32(weight / own.norms()[0]))
        keys = np.flatnonzero(table)
        for b in sentences:
            (fa, na), (fb, nb) = brute_features(a.split()), brute_features(b.split())
            want = sum(v * fb.get(k, 0.0) for k, v in fa.items()) / na / nb
            other = toxicity.letters([b])
            assert toxicity.sentence_scores(other, table)[0] == pytest.approx(want, abs=1e-5)
            assert toxicity.mapped(other, keys, table[keys][:, None])[0, 0] == pytest.approx(want, abs=1e-5)


def test_sentences_and_words():
    found = toxicity.letters(["One two. Three\nfour five six seven eight", "", "i d i o t you you a b"])
    n = np.diff(np.append(found.sentences, len(found.words)))
    assert n.tolist() == [2, 1, 4, 1, 3] and found.owner.tolist() == [0, 0, 0, 0, 2]  # idiot, you (once), ab
    some = found.only(np.array([1, 3]))
    assert some.owner.tolist() == [0, 0] and some.code.tolist() == codes("three. eight")[0]


def test_insults_spaced_out_or_over_several_words():
    r = random.Random(3)
    filler = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(6))
    say = lambda words: f"{filler()} {words} {filler()}. {filler()} {filler()} {filler()}"
    bad, clean = [say(("idiot", "total waste")[i % 2]) for i in range(80)], [say(("total", "waste", filler())[i % 3]) for i in range(160)]
    s = toxicity.train(bad + clean, [1] * len(bad) + [0] * len(clean)).scores([say("i d i o t"), say("id-iot"), say("total waste"), say("total"), say("waste"), say(filler())])
    assert min(s[:2]) > 0.7 > 0.5 > max(s[3:]) and s[2] > max(s[3:])  # words count one by one, so a phrase stands above its words, but lower
