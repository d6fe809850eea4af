import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import langid

WORDS = {"aa": "the of and thing running", "bb": "der und schön nicht straße", "cc": "el niño que están los", "dd": "le être où garçon les"}


def rows(n=240):
    rng = random.Random(3)
    out = []
    for i in range(n):
        lang = sorted(WORDS)[i % 4]
        out.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(3, 40))), lang))
    return out


@pytest.mark.parametrize("n", [2, 3, 5, 6, 40])
def test_codewords_are_distinct_and_every_bit_splits(n):
    code = langid.codewords(n)
    assert len({tuple(x) for x in code}) == n and set(np.unique(code)) == {-1, 1}
    assert (abs(code.sum(0)) < n).all()
    distance = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
    assert distance >= (1 if n == 2 else 2)


def test_held_out_accuracy_and_undetermined(spark):
    extra = [(1000, None, "aa"), (1001, "123 !? \n", "bb"), (1002, "", None), (1003, "der und schön", None), (None, "the of", "aa"), (7, rows()[7][1], "dd")]
    df = spark.createDataFrame([(*r, "zz") for r in rows() + extra], "doc_id long, text string, lang string, lang_pred string")
    model = langid.train(df, ~langid.held_out())
    assert model.languages == sorted(WORDS)
    got = langid.predict(df, model).withColumn("held_out", langid.held_out()).collect()
    assert len(got) == len(rows()) + len(extra)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 1000 and r["doc_id"] != 7]
    assert len(held) > 50 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    by = {r["doc_id"]: r for r in got if r["doc_id"] and r["doc_id"] >= 1000}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "bb"]
    assert all(0 <= r["score"] <= 1 for r in got)


def test_labels_are_no_input_of_a_prediction_and_training_is_bounded(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    model = langid.train(df, ~langid.held_out(), sample_rows=40)
    a = langid.predict(df.select("doc_id", "text"), model).collect()
    b = langid.predict(df.withColumn("lang", F.lit("x")), model).drop("lang").collect()
    assert sorted(a) == sorted(b)


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame(rows(8), "doc_id long, text string, lang string")
    model = langid.train(df, F.lit(False))
    assert {r["lang_pred"] for r in langid.predict(df, model).collect()} == {"und"}
    assert langid.predict(df.limit(0), langid.train(df.limit(0), F.lit(True))).count() == 0


def test_long_text_in_blocks(monkeypatch):
    text = "schön straße und der " * 500
    whole = langid.features(text)
    monkeypatch.setattr(langid, "_BLOCK", 64)
    assert np.allclose(whole, langid.features(text), atol=2e-3)


def test_decoder_against_brute_force():
    """Bits, losses and scores of texts, worked out one n-gram and one codeword at a time."""
    train = rows(120)
    x = np.array([langid.features(t) for _, t, _ in train])
    model = langid.fit(sorted(WORDS), x, np.array([sorted(WORDS).index(lang) for *_, lang in train]))
    for text in ["the schön of", "niño où", "Running, the thing!", "şx ğ"]:
        data = langid.letters(text)
        grams = [data[i : i + n] for n in (1, 2, 3) for i in range(len(data) - n + 1)]
        ids = [int(langid.ngrams(np.frombuffer(data, np.uint8))[i]) for i in range(len(grams))]
        f = [sum(model.weights[i][bit] for i in ids) / len(ids) + model.bias[bit] for bit in range(model.code.shape[1])]
        loss = [sum(model.trust[b] * np.log1p(np.exp(-model.code[k][b] * f[b])) for b in range(len(f))) for k in range(4)]
        p = [np.exp(-v) for v in loss]
        best = int(np.argmin(loss))
        lang, score, ambiguous = model.decode(text)
        second = sorted(p)[-2]
        assert lang == model.languages[best] and abs(score - p[best] / sum(p)) < 1e-4
        assert ambiguous == bool((p[best] - second) / sum(p) < langid.AMBIGUOUS)


def test_bits_are_weighed_by_rows_kept_back():
    """A bit that can't be told on rows kept from fitting gets the least weight, whatever it learned by heart."""
    rng = np.random.default_rng(1)
    x, y = rng.random((200, 4000)).astype(np.float32), rng.integers(0, 2, 200)
    assert langid.fit(["a", "b"], x, y).trust.max() < 0.6


def test_own_names_of_other_columns_are_kept(spark):
    df = spark.createDataFrame([(1, "the of", 5, 6, 7)], "doc_id long, text string, _d int, row int, said int")
    model = langid.train(spark.createDataFrame(rows(), "doc_id long, text string, lang string"), ~langid.held_out())
    r = langid.predict(df, model).first()
    assert (r["_d"], r["row"], r["said"], r["lang_pred"]) == (5, 6, 7, "aa")


def test_features_come_to_the_driver_small_and_exact():
    import pyarrow as pa

    texts = [t for _, t, _ in rows(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["aa"] * 40)], ["text", "lang"])
    sent = [x.as_py() for b in langid._feature_rows([batch]) for x in b.column(1)]
    assert len(sent) == 40 and max(map(len, sent)) < langid.DIMENSIONS
    assert (langid._matrix(sent) == np.stack([langid.features(t) for t in texts])).all()
