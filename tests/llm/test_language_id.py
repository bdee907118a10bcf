import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id
from tidemark.llm.language_id import fit_languages, predict_languages, presence, solve
from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_presence():
    assert presence("") is None and presence(" 12 ?!") is None
    assert presence("Ab  cd!").tolist() == presence(" aB-CD").tolist()
    assert len(presence("a")) == 3  # " a", "a ", " a "
    assert presence("ab" * 40_000).tolist() == presence("ab" * 50).tolist()


def test_scores_are_kernel_products():
    """The folded weights give what kernels with all landmarks and their own weights give."""
    texts = ["the cat sat on the mat", "le chat est sur le tapis", "a dog and the cat", "un chien et un chat", "on the mat", "sur un tapis"]
    langs = ["en", "fr", "en", "fr", "en", "fr"]
    grams = [presence(t) for t in texts]
    model = solve(grams, langs, landmarks=6, ridge=1e-3)
    kernel = np.array([[len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    goal = np.where(np.array(langs) == "en", 1.0, -1.0)
    values, vectors = np.linalg.eigh(kernel)
    features = kernel @ (vectors / np.sqrt(values))
    mean = features.mean(axis=0)
    slope = np.linalg.solve((features - mean).T @ (features - mean) + 1e-3 * np.eye(6), (features - mean).T @ (goal - goal.mean()))
    want = (features - mean) @ slope + goal.mean()
    got = model.score(texts)
    assert [g[0] for g in got] == langs
    np.testing.assert_allclose([g[1] for g in got], np.clip((np.abs(want) + 1) / 2, 0, 1), atol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op1_language_id"](spark, FOLDER)
    assert got.count() == docs.count()
    right, n = got.where("held_out").join(docs, "doc_id").agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 200 and right / n > 0.97
    (mod,) = got.agg(F.count_if((F.crc32(F.col("doc_id").cast("string")) % 4 == 2) != F.col("held_out"))).first()
    assert mod == 0


def test_only_given_rows_are_learnt_from(spark, table):
    docs = table(*[(i, "ab cd " * 9 if i % 2 else "xy zw " * 9, "L" if i % 2 else "R", None) for i in range(40)], (50, None, "X", None), (51, "12", "Y", None), (52, "ab", None, None))
    model = fit_languages(docs, "text", "lang", F.xxhash64("text"))
    assert model.languages == ["L", "R"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict_languages(docs, "doc_id", "text", model).collect()}
    assert got[1][0] == "L" and got[2][0] == "R" and got[50] == got[51] == ("und", 0.0) and got[52][0] == "L"


def test_awkward(awkward):
    model = fit_languages(awkward, "text", "lang", F.xxhash64("text"))
    rows = predict_languages(awkward, "doc_id", "text", model, ["_id"]).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 and r._id == "x" for r in rows)
    nothing = fit_languages(awkward.where("false"), "text", "lang", F.lit(0).cast("long"))
    assert {r.lang_pred for r in predict_languages(awkward, "doc_id", "text", nothing).collect()} == {"und"}
    assert predict_languages(awkward.where("false"), "doc_id", "text", nothing).count() == 0


@pytest.mark.parametrize("n", [1, language_id.BATCH, language_id.BATCH + 1])
def test_batches(n):
    model = solve([presence("abc"), presence("xyz")], ["a", "x"])
    texts = ["abc", "xyz", ""] * n
    assert [name for name, _ in model.score(texts)] == ["a", "x", "und"] * n


def test_copies_do_not_crowd_out_a_language(spark):
    """3,000 texts of one language, four texts with 2,500 copies each of another; both are learned and predicted."""
    draw = random.Random(6)
    words = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["zwrk", "kjhx", "qwvz", "xyzz"]}
    text = lambda lang: " ".join(draw.choices(words[lang], k=20))
    rows = [(text("aa"), "aa") for _ in range(3000)] + [(t, "bb") for t in (text("bb") for _ in range(4)) for _ in range(2500)]
    model = fit_languages(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", F.xxhash64("text"))
    assert model.languages == ["aa", "bb"]
    asked = spark.createDataFrame([(i, text(lang), lang) for i in range(20) for lang in words], "_text long, text string, lang string")
    found = predict_languages(asked, "_text", "text", model, ["lang"]).collect()
    assert all(r.lang_pred == r.lang for r in found)


def test_every_language_is_learned_or_refused(spark):
    rows = [(chr(0x4E00 + 50 * n + k) * 9, f"l{n:03d}") for n in range(90) for k in range(4)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = fit_languages(docs, "text", "lang", F.xxhash64("text"))
    assert len(model.languages) == 90
    with pytest.raises(ValueError):
        fit_languages(docs, "text", "lang", F.xxhash64("text"), languages=89)
    assert fit_languages(docs.where("false"), "text", "lang", F.xxhash64("text")).languages == []
