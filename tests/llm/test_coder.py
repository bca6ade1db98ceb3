"""The coder of packing beside its tokenizer, and what workers keep from task to task."""

from __future__ import annotations

import sys
import types

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from assayframe.llm import common, packing


def test_known_parts_need_no_whole_tokenizer():
    """Texts up to U+024F never reach the tokenizer's normalizer, and new parts are cut once."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coder = packing.WordCoder(path)
    whole = Tokenizer.from_file(path)
    texts = [
        "Don't STOP, they'll zqxjkvian Ünïcode 12½ a b\u0085c x'S 'tis 'RE\n\n***&& ÅngströM Ÿ ǅ ȺȾ ſ ß",
        "<|endoftext|> a", "a\x1cb", "İI", "日本 word", "é", "", "...,;'s's''t", "µªº²³¹",
    ]
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, np.uint32).tobytes() for t in texts]
    assert coder.encode(texts) == want == coder.encode(texts)
    coder.tokenizer = None
    text = "Some PLAIN words, and-more 1234 ŒUVRE"
    assert coder.encode([text]) == [np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()]


def test_what_earlier_tasks_built_makes_room(monkeypatch):
    class Task:
        number = 1

        def taskAttemptId(self):
            return self.number

    task = Task()
    monkeypatch.setattr(common.TaskContext, "get", classmethod(lambda cls: task))
    monkeypatch.setitem(sys.modules, "assayframe_worker_state", types.ModuleType("assayframe_worker_state"))
    made = []

    def get(key):
        return common.once_per_worker(key, lambda: made.append(key) or key)

    get("a"), get("b"), get("a")
    assert made == ["a", "b"]
    task.number = 2
    assert get("a") == "a" and made == ["a", "b"]
    get("c")
    # Task 2 used a and c; b was left by task 1.
    assert set(sys.modules["assayframe_worker_state"].made) == {"a", "c"}
