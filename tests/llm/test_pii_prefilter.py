import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from depthframe.llm import pii

# Chosen to come near each rule: digits in groups and words, words for signs, brackets, digits and dashes of other scripts.
PIECES = ["4111", "1111", "1", "55", "four", "one", "fünf", "un", "dash", "minus", "hyphen", "plus", "más", "dot", "punkt", "at", "ät", "a", "john", "example", "com", "@", ".", "-", "_", "+", "[", "]", "(", ")", ",", " ", " ", " ", "\t", "\xa0", "০", "๔", "１", "᠆", "‐", "―", "é", "º", "​", "а", "", "日"]


def without_prefilter(text):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pii, "_touched", lambda _: True)
        return pii.find(text)


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=24).map("".join))
def test_the_prefilter_changes_no_result(text):
    assert pii.find(text) == without_prefilter(text)
    assert pii._touched(text) or pii.Tape(text).normalise().text == text


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("pay 4111 dash 1111 dash 1111 dash 1111 now", "card", "4111 dash 1111 dash 1111 dash 1111"), ("call +1 555 dash 123 dash 4567 now", "phone", "+1 555 dash 123 dash 4567"),
        ("no four 111111 11111 1111 x", "card", "four 111111 11111 1111"), ("call plus four 917 123 45678 x", "phone", "plus four 917 123 45678"),
        ("no ৪১১১ ১১১১ ১১১১ ১১১১ x", "card", "৪১১১ ১১১১ ১১১১ ১১১১"), ("no 4111᠆1111᠆1111᠆1111 x", "card", "4111᠆1111᠆1111᠆1111"),
    ],
)
def test_a_single_disguise_is_enough(text, kind, part):
    base, spans = pii.find(text)
    assert not [s for s in base if s[0] == kind] and (kind, text.index(part), text.index(part) + len(part)) in spans
    assert [s for s in pii.find(text + " and ＠")[1] if s[0] == kind] == [s for s in spans if s[0] == kind]
