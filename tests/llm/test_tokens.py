"""Both tokenizer libraries give the same ids on any text."""

import pytest
from hypothesis import given, settings, strategies as st

from ravelin.llm.packing import cuts, tokenizer


@pytest.fixture(scope="module")
def both():
    return tokenizer(), tokenizer(library="tokenizers")


@settings(max_examples=400, deadline=None)
@given(text=st.one_of(st.text(max_size=200), st.text(alphabet="ab '’stdmlvreIE \n\t\r0129.,!?-_éßñç漢 ​\U0001f600", max_size=200)))
def test_same_ids(both, text):
    fast, other = both
    assert fast([text]) == other([text])


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a" * 5000, " " * 5000, "x\x00y", "﻿start", "one\r\n\r\ntwo  three   "])
def test_same_ids_of_odd_texts(both, text):
    assert both[0]([text]) == both[1]([text])


@pytest.fixture(scope="module")
def default():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(parts=st.lists(st.one_of(st.just("<|endoftext|>"), st.text(alphabet="ab <|>endoftx\n'sé漢", max_size=12)), max_size=8))
def test_ids_are_those_of_the_default_tokenizer(both, default, parts):
    for text in ("".join(parts), "a <|endoftext|> b"):
        want = default.encode(text, add_special_tokens=False).ids
        assert both[0]([text]) == both[1]([text]) == [want]
        assert want.count(50256) == text.count("<|endoftext|>")


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 10_000))
def test_cuts_cover(n):
    parts = cuts(n)
    assert parts[0][0] == 0 and sum(k for _, k in parts) == n and all(k == 2048 for _, k in parts[1:]) and all(a + k == b for (a, k), (b, _) in zip(parts, parts[1:], strict=False))
