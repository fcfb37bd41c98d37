"""Packing does no work that can't help: frequent words stay remembered, splits that can't be better are left."""

import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import packing
from millrace.llm._common import Words


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_words_met_often_stay_remembered(path):
    chunks = packing.ChunkIds(path, limit=60)
    often = ["Straße,", "the", "naïve", "Été", "x=1;"]
    for turn in range(12):
        new = [f"{'abcdefghijkl'[turn]}{'abcdefghijkl'[k]}zé{'!' * (k % 3)}" for k in range(10)]
        texts = [" ".join(often), " ".join(new), "", None]
        ids, ends = chunks.encode(Words(pa.array(texts)))
        found = [a.tolist() for a in np.split(ids, ends[:-1])]
        assert found == [chunks.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(chunks.runs.keys) < 80 and set(often) <= set(chunks.runs.keys.to_pylist())


def test_letters_have_the_librarys_ids(path):
    chunks = packing.ChunkIds(path)
    assert chunks.of_letters is not None
    rng = random.Random(3)
    letters = "abzABZéÉßñÑçøØæжЖяЯΣσςİıǅﬁ中文שאक़ेéåÅKſ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ".", "'s", "!?"]) for _ in range(3000)]
    texts = [" ".join(words[i : i + 50]) for i in range(0, 3000, 50)]
    ids, ends = chunks.encode(Words(pa.array(texts)))
    found = [a.tolist() for a in np.split(ids, ends[:-1])]
    assert found == [e.ids for e in chunks.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_splits_that_cannot_be_better_are_left(monkeypatch):
    rng = random.Random(1)
    counts = {s: rng.randint(1, 9) for s in range(40, 400)}
    fewest = sum(n for _, n in packing.best_fit_decreasing(counts, 1000))
    assert packing.tight(counts, 1000, packing.fewest_sequences(counts, 1000)) is None
    tried = []
    monkeypatch.setattr(packing, "best_fit_decreasing", lambda *a: tried.append(a) or [])
    assert list(packing.split_packings(counts, 1000, min(fewest, packing.fewest_sequences(counts, 1000)))) == [] and not tried
