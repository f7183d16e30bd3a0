"""The chunked encoder against the tokenizers library on whole texts."""

import random

import numpy as np

from tessella.llm import tokens

ODD = ["", "a<|endoftext|>b", "dog's. it's' y'all'd.", "<|startoftext|>", "x'S, y'S. n't' a'", "word$$$ Été!? ÿ...\n×. ÷, é́.", "a" * 5000, "a\tb.\r\nc"]


def test_encoder_equals_the_library():
    rng = random.Random(5)
    letters = "abcDÉéßxys'.,!<|>endoftext \n\t 0129$%`~{}[]^_\\/-×÷ªº́İ日ﬁ ­"
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(2000)]
    coder = tokens.Encoder(tokens.default_path())
    for _ in range(2):  # first learned, then remembered
        for text, got in zip(texts, coder.encode(texts), strict=True):
            assert got == np.array(coder.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text


def test_full_memory_is_cleared(monkeypatch):
    monkeypatch.setattr(tokens, "MOST", 3)
    coder = tokens.Encoder(tokens.default_path())
    texts = ["one two three four", "two five six", "one one seven."]
    for text in texts:
        assert coder.encode([text])[0] == np.array(coder.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert len(coder.known) <= 5


def test_latin_texts_are_cut_as_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE", 40)
    coder = tokens.Encoder(tokens.default_path())
    texts = ["!a. \n", "Été, été,! ÉTÉ\n(été)", "", " ", "日 été.", "x'S, 7. ß!? a", "été...", ".", "a\x85b\xa0c, ²³.", "the<|endoftext|>the."]
    for _ in range(2):
        assert coder.encode(texts) == [np.array(coder.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    # a word is remembered once, whatever its case and the stops behind it
    assert {c for c in coder.known if isinstance(c, bytes) and b"\xe9t\xe9" in c} == {b"\xe9t\xe9", b"(\xe9t\xe9"}


def test_a_model_that_differs_is_not_asked_alone():
    coder = tokens.Encoder(tokens.default_path())
    coder.signs = {ord("é"): "e"}
    assert coder.direct and not coder._by_model()
