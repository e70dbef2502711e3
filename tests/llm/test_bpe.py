import hashlib
import json

import pytest
from tokenizers import Tokenizer

from podium.llm import bpe
from podium.llm.queries import tokenizer_path

from .conftest import ordered


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_same_as_the_library(docs, texts):
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    want = []
    for i, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert ordered(bpe.digest(docs, tokenizer_path()).collect()) == ordered(want)


def test_columns_and_empty_tables(docs):
    both = bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path())
    assert both.columns == [c for c in docs.columns if c not in ("tokens", "decoded")] + ["tokens", "decoded"]
    assert bpe.digest(docs.limit(0), tokenizer_path()).collect() == []


def test_words_by_random_symbols():
    """Backtracking against the merge procedure of the library, on words made to be hard."""
    import random

    own, t, r = bpe.WordBpe.load(tokenizer_path()), Tokenizer.from_file(tokenizer_path()), random.Random(3)
    for _ in range(3000):
        word = "".join(r.choice("aeinrstlohé'") for _ in range(r.randint(1, 40)))
        assert own.encode(word) == t.encode(word, add_special_tokens=False).ids, word


def test_other_normalizers_are_refused():
    with open(tokenizer_path()) as f:
        spec = json.load(f)
    bpe.WordBpe(spec)
    with pytest.raises(ValueError):
        bpe.WordBpe({**spec, "normalizer": {"type": "NFKC"}})
