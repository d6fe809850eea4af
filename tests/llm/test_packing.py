import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from colloquy.llm import packing, queries

VOCABULARY = queries.vocabulary()


def texts(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß.,'1") for _ in range(rng.randint(1, 9)))
    gaps = [" "] * 30 + ["\n", "  ", " \n", "\n \n", "\u00a0 ", "\t", " \u2003", "\x1c "]
    return ["".join(word() + rng.choice(gaps) for _ in range(rng.choice([0, 1, 5, 60, 900]))) for _ in range(n)]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def test_word_encoder_equals_whole_text_encoding(tokenizer):
    odd = texts(200) + ["", " ", "  ", " a", "a ", "a  b", "\n a \n\n b", "x <|endoftext|> y", "don't  it's", "\u3000 z", "\x85 q \x85"]
    got = packing.WordEncoder(VOCABULARY).encode(odd)
    for t, ids in zip(odd, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize(("size", "segments", "loss"), [(256, 256, None), (256, 4, None), (128, 8, 50)])
def test_pieces_cover_all_ids_within_all_limits(spark, tokenizer, size, segments, loss):
    rows = [(i, t) for i, t in enumerate(texts(60))] + [(900, None), (901, ""), (902, "twice"), (902, "twice"), (None, "no id")]
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], "doc_id long, text string, marked long, sequence_id string").repartition(3)
    got = packing.pack(df, VOCABULARY, size=size, max_segments=segments, max_loss=loss, loss_tokens="marked" if loss else None).collect()
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    sequences, docs = {}, {}
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append(r)
        docs.setdefault(r["doc_id"], []).append(r)
    for d, pieces in docs.items():
        ids = sorted((p["start"], np.frombuffer(bytes(p["ids"]), "<u4").tolist(), p["doc_tokens"]) for p in pieces)
        if d == 902:
            assert len(ids) >= 2 and sum(len(x[1]) for x in ids) == 2 * len(want[d][0])
            continue
        assert [x for p in ids for x in p[1]] == want[d][0] and all(p[2] == len(want[d][0]) for p in ids)
    assert docs.keys() == want.keys()
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in pieces] == [sum(q["length"] for q in pieces[:i]) for i in range(len(pieces))]
        total = sum(p["length"] for p in pieces)
        assert total <= size and len(pieces) <= segments and sum(p["loss_tokens"] for p in pieces) <= (loss or size)
        assert total == size or total & (total - 1) == 0  # no padding at all


def test_empty_table_and_checksum(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    r = packing.pack(df, VOCABULARY).withColumn("c", F.crc32("ids")).collect()
    assert sum(x["length"] for x in r) == r[0]["doc_tokens"] and r[0]["c"] == zlib.crc32(bytes(r[0]["ids"]))
    assert packing.pack(df.limit(0), VOCABULARY).count() == 0


def test_lettered_words_skip_the_pattern_and_keep_their_ids(tokenizer, monkeypatch):
    rng = random.Random(4)
    letters = "abcdefghiklmnorstuvzABCéßàñÿÀþ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) + rng.choice(["", "", ".", "?!", "...", ";,"]) for _ in range(4000)]
    words += ["don't", "it's.", "x1", "\u00aa", "\u00d7", "\u00ba.", "\u0394x", ".", "!?", "naïve.Ġx", "Ġ", "e\u0301"]
    rng.shuffle(words)
    encoder, bare = packing.WordEncoder(VOCABULARY), []
    joined = packing.WordEncoder._joined
    monkeypatch.setattr(packing.WordEncoder, "_joined", lambda self, some, lettered: (bare.extend(some if lettered else []), joined(self, some, lettered))[1])
    for part in (words[:2000], words[2000:]):
        text = " ".join(part)
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(bare) > 3000 and all(w.isalpha() for w in bare)
