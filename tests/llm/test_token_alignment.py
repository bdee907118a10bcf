import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_bpe import POOL
from tokenizers import Tokenizer

from tidemark.llm import token_alignment
from tidemark.llm.bpe import byte_symbols
from tidemark.llm.token_alignment import align_tokens, link_counts, score_links, tokenizers

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(4)
    out = ["".join(draw.choice(POOL) for _ in range(draw.randrange(40))) for _ in range(1500)]
    out += ["".join(draw.choice("abehinrst ") for _ in range(draw.randrange(80))) for _ in range(500)]
    return out + ["<|endoftext|> it's <s> a </s><unk> text", "two  blanks", " before", "after ", "\n\nlines\n", "▁", "a▁b", "<0x41>", "x\x00y", "😀 中文"]


def slow(libraries, text):
    """Ids of both, cuts and links by comparing all ends; None where the text is changed."""
    a, b = libraries
    if not text:
        return None
    byte = {symbol: i for i, symbol in enumerate(byte_symbols())}
    one = a.encode(" " + text, add_special_tokens=False)
    other = b.encode(text)
    bytes_a = [bytes(byte[c] for c in token) for token in one.tokens]
    pieces = [(i, b.id_to_piece(i)) for i in other]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    ends = [[sum(map(len, parts[: i + 1])) for i in range(len(parts))] for parts in (bytes_a, bytes_b)]
    links = [(i, j) for i, x in enumerate(ends[0]) for j, y in enumerate(ends[1]) if x == y]
    return one.ids, other, links


def text_of(ids_a, ids_b, links):
    groups, i, j = [], 0, 0
    for m, n in links:
        groups.append(",".join(map(str, ids_a[i : m + 1])) + "|" + ",".join(map(str, ids_b[j : n + 1])))
        i, j = m + 1, n + 1
    return ";".join(groups)


def test_same_ids_as_the_libraries(libraries, texts):
    a, b = tokenizers(A, B)
    assert a.encode(texts) == [libraries[0].encode(" " + text, add_special_tokens=False).ids for text in texts]
    assert b.encode(texts) == [libraries[1].encode(text) for text in texts]
    long = ["x" * 300_000, " " * 300_000, "ab " * 100_000, "\n" * 100_000, "é" * 100_000]
    assert a.encode(long) == [libraries[0].encode(" " + text, add_special_tokens=False).ids for text in long]


@pytest.mark.parametrize("broadcast", [500_000, 10])
def test_like_all_ends_compared(spark, table, libraries, texts, monkeypatch, broadcast):
    monkeypatch.setattr(token_alignment, "BROADCAST_PAIRS", broadcast)
    monkeypatch.setattr(token_alignment, "SLICE_BYTES", 500)
    texts = texts[::3] + texts[-10:]
    aligned = align_tokens(table(*enumerate(texts)), "doc_id", "text", A, B).cache()
    counts = link_counts(aligned)
    want = [slow(libraries, text) for text in texts]
    pairs = Counter((x[0][i], x[1][j]) for x in want if x for i, j in x[2])
    most = Counter()
    for (_, b), n in pairs.items():
        most[b] = max(most[b], n)
    assert {(r.link >> 32, r.link & 0xFFFFFFFF): (r["count"], r.best) for r in counts.collect()} == {
        p: (n, n == most[p[1]]) for p, n in pairs.items()
    }
    scored = {r.doc_id: r for r in score_links(aligned, "doc_id", counts).collect()}
    assert any(x is None for x in want) and any(x and len(x[2]) < len(x[0]) for x in want)
    for r in aligned.collect():
        x = want[r.doc_id]
        if x is None:
            assert tuple(r[1:]) == (0, 0, 0, "", [], []) and r.doc_id not in scored
            continue
        ids_a, ids_b, links = x
        linked = [(ids_a[i], ids_b[j]) for i, j in links]
        assert (r.n_a, r.n_b, r.n_groups, r.groups) == (len(ids_a), len(ids_b), len(links), text_of(*x))
        of_row = scored[r.doc_id]
        assert (of_row.n_links, of_row.n_best, of_row.count_sum) == (
            len(linked), sum(pairs[p] == most[p[1]] for p in linked), sum(pairs[p] for p in linked),
        )


def test_awkward(spark, awkward):
    aligned = align_tokens(awkward, "doc_id", "text", A, B)
    rows = aligned.collect()
    assert len(rows) == awkward.count()
    assert all((r.n_a == 0) == (r.groups == "") for r in rows)
    same = [r[1:] for r in rows if r.doc_id == 5] + [r[1:] for r in rows if r.doc_id == 6]
    assert same[0] == same[1] and same[0][0] > 100_000
    empty = align_tokens(awkward.where("false"), "doc_id", "text", A, B)
    assert empty.count() == link_counts(empty).count() == 0
    clash = awkward.select(F.col("text").alias("groups"), F.col("doc_id").alias("links"), F.col("_id").alias("n_a"))
    assert align_tokens(clash.withColumnRenamed("n_a", "k"), "k", "groups", A, B).count() == awkward.count()


def test_other_vocabularies_are_refused():
    with pytest.raises((ValueError, KeyError)):
        token_alignment.ByteTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert re.fullmatch(r"\d+", tokenizers(A, B)[1].names[300])
