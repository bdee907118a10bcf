import hashlib

import numpy as np
import pytest
import sentencepiece
from test_token_alignment import A, B, slow, text_of
from test_whitening import brute
from tokenizers import Tokenizer

from __spark_entry__ import oracle_sql, queries
from check import oracle_connection, rows
from tidemark.llm.oracle import ORACLE
from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(FOLDER)


def test_registered():
    assert sorted({int(name[2:].split("_")[0]) for name in QUERIES}) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(ORACLE) <= set(QUERIES) and set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_like_sql(spark, oracle, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    want = oracle.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op7_line_dedup"])
def test_native(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "ExternalRDD"))


def test_whitening_like_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    deviation, whitened, explained, _ = brute(rows, 8)
    got = {(r.vec_id, r.component): r for r in QUERIES["op11_embedding_whitening"](spark, FOLDER).collect()}
    assert len(got) == 8 * len(rows)
    for j in range(8):
        own = np.array([got[k, j + 1].whitened for k, _ in rows])
        assert np.allclose(own * np.sign(own @ whitened[:, j]), whitened[:, j], atol=1e-8)
        assert [got[k, j + 1].deviation for k, _ in rows] == deviation.tolist()
        assert all(r.identity_error < 1e-4 and abs(r.explained / explained[j] - 1) < 1e-9 for (_, c), r in got.items() if c == j + 1)


def test_alignment_like_all_ends_compared(spark):
    libraries = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    libraries[0].encode_special_tokens = True
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    want = {i: slow(libraries, text if len(text or "") < 5000 else None) for i, text in texts.items()}
    for r in QUERIES["op12_token_alignment"](spark, FOLDER).collect():
        if (x := want[r.doc_id]) is not None:
            digest = hashlib.sha256(text_of(*x).encode()).hexdigest()
            assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (len(x[0]), len(x[1]), len(x[2]), len(x[2]), digest)
            assert 0 <= r.n_best <= r.n_links <= r.count_sum
