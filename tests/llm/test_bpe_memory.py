"""A Python worker, which goes on to other tasks, keeps no remembered words for long."""

import time
from types import SimpleNamespace

import public_tokenizers

from sedimenta.llm import bpe


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "IDLE_S", 0.5)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        text = file.read()
    shared = SimpleNamespace(value=(hash(text), text))
    with bpe._tokenizer(shared) as first:
        first.encode("some words here")
        time.sleep(1)
        assert bpe._loaded  # not while a task runs
    with bpe._tokenizer(shared) as again:
        assert again is first and again.later
    time.sleep(1.5)
    assert not bpe._loaded
