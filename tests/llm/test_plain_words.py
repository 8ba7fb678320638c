"""Plain words are encoded without the tokenizer's normalizer and pattern, to the same ids."""

import json
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from corpusmill.llm import tokenids
from corpusmill.llm.arrowtext import runs

public_tokenizers = pytest.importorskip("public_tokenizers")
DEFINITION = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")


class Watched:
    """A tokenizer that notes the words it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.words = tokenizer, []

    def encode(self, text, **kwargs):
        self.words += text.split()
        return self.tokenizer.encode(text, **kwargs)

    def encode_batch_fast(self, texts, **kwargs):
        self.words += " ".join(texts).split()
        return self.tokenizer.encode_batch_fast(texts, **kwargs)


def ids_of(encoder, texts):
    out = []
    for a, b, buf, offsets in runs(pa.array(texts), 2000):
        ids, at = encoder.encode(buf, offsets)
        out += [ids[at[i] : at[i + 1]].tolist() for i in range(b - a)]
    return out


def test_plain_words_pass_the_pattern_by():
    encoder = tokenids.Encoder(DEFINITION)
    watched = encoder.tokenizer = Watched(encoder.tokenizer)
    texts = ["Größe und straße", "L'été à noël", "ünïcode naïve ÿ", "ÉTÉ 7 ſ"]
    got = ids_of(encoder, texts)
    assert sorted(watched.words) == sorted(["'été", "7", "ÉtÉ", "ſ"])
    assert got == [watched.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_letters_that_are_plain_stay_as_they_are():
    encoder = tokenids.Encoder(DEFINITION)
    plain = [c for c in map(chr, range(0x3000)) if tokenids._PLAIN.fullmatch(c)]
    assert len(plain) == 58
    normal = encoder.tokenizer.normalizer.normalize_str
    assert all(normal(a + b) == a + b for a in plain for b in plain)


def test_ids_of_mixed_letters():
    encoder, r = tokenids.Encoder(DEFINITION), random.Random(3)
    few = list("abxyzßàéÿñ ")
    many = [*few, *"ABÉÑ×÷ªº0.,'’<|", "́", "̈", "­", " ", "\u0085", "İ", "ς", "ǰ", "ł", "Ġ", "中", "각", "<|endoftext|>", "</w>"]
    texts = ["".join(r.choice(few if r.random() < 0.8 else many) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    assert ids_of(encoder, texts) == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("change", [{"normalizer": None}, {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFD"}, {"type": "Lowercase"}]}}])
def test_other_tokenizers_take_the_whole_way(change):
    assert tokenids.Encoder(json.dumps(json.loads(DEFINITION) | change)).light is None
    assert np.array_equal(tokenids.Encoder(DEFINITION).light.encode("plain", add_special_tokens=False).ids, tokenids.Encoder(DEFINITION).tokenizer.encode("plain", add_special_tokens=False).ids)
