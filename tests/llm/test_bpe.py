import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe
from tidemark.llm.bpe import Vocabulary, bpe_decode, bpe_encode

PATH = public_tokenizers.path("word_bpe_49k.json")
# what the two sides may see differently are letters newer than Python's tables; none here
POOL = "abcdefghijklmnopqrstuvwxyzABCDEÉÜßñ'’.,!?-_<|>0123456789 \t\n\r\x0b\x0c\x1c\x1e\x85\xa0 ​ 　ΣσςİıǅÅ中文字😀🏽́ﬁⅣ²﻿\x00\x7f"


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(2)
    out = ["".join(draw.choice(POOL) for _ in range(draw.randrange(50))) for _ in range(3000)]
    out += ["".join(draw.choice("abehinrst") for _ in range(draw.randrange(40))) for _ in range(3000)]
    out += ["".join(draw.choice("ab") for _ in range(draw.randrange(40))) for _ in range(500)] + ["a" * n for n in range(120)]
    out += ["don't I'LL we've", "<|startoftext|>hi <|endoftext|><|endoftext|>", "<|STARTOFTEXT|> <|startoftext|", "x" * 5000, "ΑΣ ΑΣΑ"]
    return out


def test_like_the_library(library, texts, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3000)  # the cache is emptied on the way
    words, cache = Vocabulary(PATH), {}
    for start in range(0, len(texts), 500):
        part = texts[start : start + 500]
        for text, ids in zip(part, words.encode(part, cache), strict=True):
            want = library.encode(text, add_special_tokens=False).ids
            assert ids == want, text
            assert words.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_every_token_is_reached():
    words = Vocabulary(PATH)
    assert words.reached == set(words.ids.values())


def test_tables(awkward, library, spark):
    got = bpe_encode(awkward, "doc_id", "text", PATH, decoded="decoded")
    want = sorted((str(r.doc_id), library.encode(r.text or "", add_special_tokens=False).ids) for r in awkward.collect())
    rows = got.collect()
    assert sorted((str(r.doc_id), r.ids) for r in rows) == want
    assert all(r.n_tokens == len(r.ids) and r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in rows)
    assert bpe_encode(awkward.where("false"), "doc_id", "text", PATH).count() == 0
    ids = spark.createDataFrame([(1, [320, 49407, -5]), (2, []), (3, None)], "k int, ids array<int>")
    assert [r.text for r in bpe_decode(ids, "k", "ids", PATH).orderBy("k").collect()] == ["a</w> <|endoftext|>", "", ""]
