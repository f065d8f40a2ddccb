"""Segments against the library's own encoding of whole texts."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm.token_ids import BARE_SEGMENT, SegmentEncoder, segments_of

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
HARD = ["", " ", "\n", "a", "a b", "a  b", "a   b", " a", "a ", "a \n\n b", "x y", "x   y", "a\x1cb", "a \x1c b", "!\x1c !", "it's 's 't don't", "A.B.C", "word.)foo, bar;;;  baz?!\nNext", "É É é.", "ΑΣ ΟΔΟΣ.", "İstanbul", "<|endoftext|> x <|startoftext|>", "²³.¼ 12.5,3", "日本語 テキスト。 x", "a　b  c", "\r\n\r\n a\tb", "ﬁ ＡＢＣ.", "́.", "á́,b"]


@pytest.fixture(scope="module")
def both():
    found = {}
    for n in NAMES:
        found[n] = SegmentEncoder(public_tokenizers.path(n)), Tokenizer.from_file(public_tokenizers.path(n))
    return found


def own(code, texts):
    import numpy as np

    return [np.frombuffer(b, code.dtype).tolist() for b in code.encode(texts)]


@pytest.mark.parametrize("name", NAMES)
def test_hard_texts(both, name):
    code, whole = both[name]
    assert code.by_segment
    assert own(code, HARD) == [whole.encode(t, add_special_tokens=False).ids for t in HARD]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("aAbé.,;:!?'’-_ \n\t\r \x1c 　²1２日́ÉΣß<|>")), max_size=40))
def test_any_text(both, text):
    for code, whole in both.values():
        assert own(code, [text]) == [whole.encode(text, add_special_tokens=False).ids]


def test_letters_before_marks():
    """What the pattern takes for a letter stays one when it is normalised."""
    import unicodedata

    letters = [c for c in map(chr, range(0x30000)) if (m := BARE_SEGMENT.match(c + ".")) and m.end() == 1 and c not in ".,;:!? \n"]
    assert len(letters) > 500 and all(unicodedata.normalize(f, x)[-1].isalpha() for c in letters for x in (c, c.lower()) for f in ("NFC",))


def test_small_cache(both, monkeypatch):
    from lodestone.llm import token_ids

    monkeypatch.setattr(token_ids, "MOST_KEPT", 8)
    code = SegmentEncoder(public_tokenizers.path(NAMES[0]))
    _, whole = both[NAMES[0]]
    for t in ["a b c d e", "a b c f g h", "i j k l m n o p q r", "a b c"]:
        assert own(code, [t]) == [whole.encode(t, add_special_tokens=False).ids]


def test_other_tokenizers_get_whole_texts():
    assert segments_of({"pre_tokenizer": None}) is None
    assert segments_of({"pre_tokenizer": {"type": "ByteLevel", "use_regex": True, "add_prefix_space": True}}) is None
    split = {"type": "Split", "pattern": {"Regex": r"\S+"}, "behavior": "Removed", "invert": True}
    assert segments_of({"pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, {"type": "ByteLevel", "use_regex": False, "add_prefix_space": False}]}}) is None


def test_words_need_no_pattern(both):
    """Texts with single spaces and line feeds are cut without the pattern, which takes several times as long; others by it."""

    class Counted:
        def __init__(self, pattern):
            self.pattern, self.texts = pattern, []

        def findall(self, text):
            self.texts.append(text)
            return self.pattern.findall(text)

    code, whole = SegmentEncoder(public_tokenizers.path(NAMES[0])), both[NAMES[0]][1]
    plain = ["The cat, the dog.\nThe cat\nsat", "cat", "dog the\tcat", "cat?! the\ncat, don't. É, 1. a.b. .,"]
    odd = ["The cat \n sat", "a\t b", "a\x1c\nb", "cat ", "\ncat", "a\n\nb", "", " "]
    code.segment = Counted(code.segment)
    for _ in range(2):
        assert own(code, plain + odd) == [whole.encode(t, add_special_tokens=False).ids for t in plain + odd]
    assert set(code.segment.texts) == set(odd)
