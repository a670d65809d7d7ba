import pickle
import string

import pytest

from depthframe.llm import toxicity
from depthframe.llm.toxicity import CROWD, NEAR, Lexicon


def hits(lexicon, word):
    return lexicon.features(f"you {word} there")[0]


@pytest.mark.parametrize("token", ["grunpfriko", "grumfriko", "grrumpfriko", "grumpf"])
def test_a_misspelt_stem_is_found(token):
    assert hits(Lexicon({}, {"grumpf": 1.0}, set()), token) == pytest.approx(1.0 if token == "grumpf" else NEAR)
    assert hits(Lexicon({}, {"grumpf": 1.0}, {"grunpfriko"}), "grunpfriko") == 0 == hits(Lexicon({}, {"grumpf": 1.0}, set()), "gramofriko")


def test_four_letters_take_one_edit_after_the_first():
    words, stems = Lexicon({"twit": 1.0}, {}, set()), Lexicon({}, {"twit": 1.0}, set())
    assert hits(words, "twiit") == hits(words, "twt") == hits(stems, "twtlovi") == pytest.approx(NEAR)
    assert hits(words, "gwit") == hits(stems, "gwitlovi") == hits(words, "tana") == hits(Lexicon({"git": 1.0}, {}, set()), "giit") == 0


def test_a_crowded_term_keeps_its_misspellings():
    crowd = {f"idi{c}t" for c in string.ascii_lowercase if c != "o"}
    lexicon = Lexicon({"idiot": 1.0}, {}, crowd)
    assert hits(lexicon, "idiiot") == pytest.approx(NEAR * CROWD / len(crowd)) and hits(lexicon, "idiot") == 1
    assert hits(Lexicon({"idiot": 1.0}, {}, crowd, {"idiott", "iddiot"}), "idiiot") == pytest.approx(NEAR * (CROWD + 2) / (len(crowd) + 2))
    assert all(hits(lexicon, w) == 0 for w in crowd)


def test_purity_reaches_the_workers():
    crowd = {f"idi{c}t" for c in string.ascii_lowercase if c != "o"}
    model = toxicity.Model(Lexicon({"idiot": 1.0}, {"grumpf": 1.0}, crowd, {"idiott"}), [0, 1, 1, 1, 0])
    sent = pickle.loads(pickle.dumps(model))
    assert sent.lexicon.purity == model.lexicon.purity != {} and sent.score(["you idiiot", "grunpfna"]) == model.score(["you idiiot", "grunpfna"])
