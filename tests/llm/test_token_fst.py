import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cartlytics.llm import token_fst as X
from conftest_llm import ODD

FILE = public_tokenizers.path("word_bpe_49k.json")
ODD_CHARACTERS = "aAbB'sstrell ve'LL1½²Ⅷé́ΣσςİıßÀ\n\t\x85　\x1c​日本語한글👍🏽_-–—…!?;:.,`~@#$%^&*()[]{}\\/\"ﬁǅ̀ͅẞ𝟘𐄇"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def machine():
    with open(FILE, encoding="utf-8") as f:
        return X.WordEndBpe(f.read())


def in_chunks(machine, text, size):
    maps = [machine.state_map(text[i:i + size]) for i in range(0, len(text), size)]
    while len(maps) > 1:
        maps = [machine.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return machine.finish(maps[0]) if maps else 0


def test_counts_equal_the_library(machine, library):
    rng = random.Random(4)
    texts = ["".join(rng.choices(ODD_CHARACTERS, k=rng.randint(0, 60))) for _ in range(1500)]
    texts += ["<|endoftext|>", "a<|startoftext|>b <|endoftext|", "<|ENDOFTEXT|>", "it's they'LL I've", "", " ", "x" * 3000, "the " * 500]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    for size in (5, 64, 1 << 16):
        assert [in_chunks(machine, t, size) for t in texts] == want


def test_boundaries_equal_merging(machine):
    rng = random.Random(5)
    inner = [t for t in machine.known if not t.endswith(machine.end) and machine.whole(t)]
    right = [t for t in machine.known if machine.whole(t)]
    for _ in range(3000):
        a, b = rng.choice(inner), rng.choice(right)
        assert machine.stands(a, b) == (machine.merged(machine.symbols_of(a) + machine.symbols_of(b)) == [a, b])


def test_table_and_odd_rows(spark, docs, odd, empty, library):
    for frame in (docs, odd):
        texts = [(r["doc_id"], r["text"] or "") for r in frame.collect()]
        want = sorted(((i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts), key=repr)
        got = X.token_counts(frame, FILE).collect()
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=repr) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert len(ODD) == odd.count() and X.token_counts(empty, FILE).count() == 0
