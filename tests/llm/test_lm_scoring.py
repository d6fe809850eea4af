import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import lm_scoring as lm
from colloquy.llm.words import split


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    sounds = ["ba", "ne", "tion", "ö", "ing", "st", "q9"]
    word = lambda: "".join(rng.choice(sounds) for _ in range(rng.randint(1, 3)))
    return [(i, " ".join(rng.choice(["the", "of", "And,"]) if rng.random() < 0.5 else word() for _ in range(rng.choice([1, 8, 40, 900])))) for i in range(n)]


def typed(words, counts=None):
    """Types of words with how often each stands before a blank and before an end."""
    counts = counts or {}
    mid, last = ([counts.get(w, (0, 0))[i] for w in words] for i in (0, 1))
    return lm.Types(list(words), np.array(mid), np.array(last), np.full(len(words), lm.DEPTHS[0]))


def counted(texts):
    mid, last = Counter(), Counter()
    for t in texts:
        w = split(t)
        mid.update(w[:-1])
        last[w[-1] if w else b""] += 1
    return {w: (mid[w], last[w]) for w in {*mid, *last}}


def trained(texts, more=()):
    """Types of all words of the texts and some more, the tables and a mixer that learned from them."""
    counts = counted(texts)
    t = typed(sorted({*counts, *more}), counts)
    tables, mixer = lm.Tables(), lm.Mixer()
    tables.add(t)
    mixer.learn(t, tables.ready())
    return t, tables, mixer, sorted({*counts, *more}), counts


@pytest.mark.parametrize("prefix", [b"", b"ba", b"thin", b"bationne", b"\xc3", b"zzzz"])
def test_probabilities_of_all_continuations_add_up_to_one(prefix):
    inner = [prefix + bytes([i]) for i in range(256) if i not in b" \n"]
    t, tables, mixer, words, _ = trained([t for _, t in corpus(40)], [prefix, *inner])
    body, blank, stop = mixer.costs(t, tables)
    cost = dict(zip(words, body, strict=True))
    at = words.index(prefix)
    total = sum(math.exp(cost[w] - cost[prefix]) for w in inner) + math.exp(blank[at]) + math.exp(stop[at])
    assert math.isclose(total, 1, rel_tol=2e-3)


def test_costs_against_a_plain_replay():
    """The costs of words from plain dictionaries of contexts and bits."""
    texts = [t for _, t in corpus(60)]
    t, tables, mixer, words, counts = trained(texts, [b"unseen", b"banew"])
    number = {b: i for i, b in enumerate(lm.COMMON)}
    seen = Counter()

    def contexts(w, i):
        return [(k, w[max(0, i - k) : i].rjust(k, b"\0")) for k in lm.ORDERS] + [("all", w[:i])]

    def bits(byte):
        c = number.get(byte, lm.OTHER)
        return [(c >> (lm.BITS - 1 - j)) & 1 for j in range(lm.BITS)]

    for w, (mid, last) in counts.items():
        for i in range(len(w) + 1):
            for byte, n in [(w[i], mid + last)] if i < len(w) else [(32, mid), (10, last)]:
                for k, c in enumerate(contexts(w, i)):
                    for j in range(lm.BITS + 1):
                        seen[k, c, tuple(bits(byte)[:j])] += n

    def cost(w, i, byte):
        b, total = bits(byte), 0.0
        known = [lm._known(np.array(seen[k, c, ()])) for k, c in enumerate(contexts(w, i))]
        gate = known[-1] * 4 + known[-2]
        for j in range(lm.BITS):
            odds = [math.log((seen[k, c, (*b[:j], 1)] + 0.2) / (seen[k, c, (*b[:j], 0)] + 0.2)) for k, c in enumerate(contexts(w, i))]
            x = min(14, max(-14, sum(o * v for o, v in zip(odds, mixer.weights[gate, j], strict=True))))
            node = 1
            for z in b[:j]:
                node = 2 * node + z
            ones = mixer.map[node, int(x * 16 / 14 + 16.5)]
            p = (1 / (1 + math.exp(-x)) + ones[1] / ones.sum()) / 2
            total += math.log(p if b[j] else 1 - p)
        return total

    body, blank, stop = mixer.costs(t, tables)
    checked = 0
    for i, w in enumerate(words):
        if all(byte in number for byte in w):
            want = sum(cost(w, j, byte) for j, byte in enumerate(w))
            assert math.isclose(body[i], want, rel_tol=2e-2, abs_tol=2e-3)
            assert math.isclose(blank[i], cost(w, len(w), 32), rel_tol=2e-2, abs_tol=2e-3) and math.isclose(stop[i], cost(w, len(w), 10), rel_tol=2e-2, abs_tol=2e-3)
            checked += 1
    assert checked > 50


def test_weights_are_learned_from_all_training_tokens():
    texts = [t for _, t in corpus(80)]
    _, _, mixer, _, _ = trained(texts)
    assert mixer.bits == lm.BITS * sum(len(b" ".join(split(t))) + 1 for t in texts)


def test_costs_are_the_same_in_chunks_of_few_beginnings(monkeypatch):
    t, tables, mixer, _, _ = trained([t for _, t in corpus(40)], [b"unseen", b"", b"bationne"])
    whole = mixer.costs(t, tables)
    monkeypatch.setattr(lm, "TABLE_ROWS", 7)
    assert all(np.allclose(a, b, rtol=1e-6) for a, b in zip(whole, mixer.costs(t, tables), strict=True))


def test_rounds_of_one_task_are_one_online_pass(spark):
    """A round goes on from what the rounds before have learned."""
    counts = counted([t for _, t in corpus(80)])
    words = lm._dealt(spark.createDataFrame([(w, *n) for w, n in counts.items()], "word binary, mid long, last long"))
    tables = lm._shared_tables(words)
    got = lm.learn(words, spark.sparkContext.broadcast(tables), "one", 1)
    ready, plain, sizes = tables.ready(), lm.Mixer(), []
    for number in range(len(lm.ROUNDS) - 1):
        mine = sorted(bytes(r["word"]) for r in lm.round_of(words, number).collect())
        sizes.append(len(mine))
        if mine:
            plain.learn(typed(mine, counts), ready)
    assert sum(sizes) == len(counts) and sum(n > 0 for n in sizes) > 1
    assert got.bits == plain.bits
    assert np.allclose(got.weights, plain.weights, rtol=1e-6) and np.allclose(got.map, plain.map, rtol=1e-6)


def test_held_out_words_cost_little_more_than_their_entropy():
    rng = random.Random(8)
    sounds = ["ba", "ne", "tion", "ing", "st", "or", "che", "mi", "lu"]
    text = lambda: " ".join("".join(rng.choice(sounds) for _ in range(rng.randint(3, 6))) for _ in range(400))
    train, held = [text() for _ in range(150)], [text() for _ in range(10)]
    own = counted(held)
    t, tables, mixer, words, _ = trained(train, own)
    body, blank, stop = mixer.costs(t, tables)
    cost = sum((m + n) * body[i] + m * blank[i] + n * stop[i] for i, (m, n) in ((words.index(w), c) for w, c in own.items()))
    bits, entropy = -cost / math.log(2) / 4000, 4.5 * math.log2(9) + 2
    assert 0.99 * entropy < bits < 1.08 * entropy


def test_sentences_end_by_their_own_words():
    w = lambda n, stop="": [b"w"] * (n - 1) + [b"w" + stop.encode()]
    assert lm.sentences([]) == [] and lm.sentences(w(3, ".")) == [3]
    assert lm.sentences(w(5, ".") + w(5, "!") + w(9, "?") + w(2)) == [10, 19, 21]
    assert lm.sentences(w(300)) == [128, 256, 300] and lm.sentences(w(130, ".") + w(8, ".")) == [128, 138]
    rng = random.Random(4)
    for _ in range(200):
        words = [rng.choice([b"a", b"b.", b"c"]) if rng.random() < 0.3 else b"x" for _ in range(rng.randint(0, 400))]
        cuts = lm.sentences(words)
        assert cuts == sorted(set(cuts)) and (not words or cuts[-1] == len(words))
        # the first sentence is the same whatever follows it
        if len(cuts) > 1:
            assert lm.sentences(words[: cuts[0]] + [b"other."] * 9)[0] == cuts[0]


def test_whole_text_adds_up_both_ways():
    share = 0.25
    plain = lm.whole_text([-5.0, -7.0], {}, share)
    assert math.isclose(plain, -12 + math.log(0.75) + math.log(1 - 0.5 / 3))
    both = lm.whole_text([-50.0], {0: -3.0}, share)
    assert math.isclose(both, math.log(0.75 * math.exp(-50) + 0.25 * math.exp(-3)))
    assert lm.whole_text([-50.0, -50.0], {0: -3.0, 1: -3.0}, share) > 2 * both


@pytest.mark.parametrize("head", [lm.HEAD_WORDS, 3, 0])
def test_contract_against_brute_force(spark, head, monkeypatch):
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    rows = corpus() + [(500, None), (501, ""), (502, "ONE\x0btwo three"), (500, None), (None, "the of"), (503, "word" * 40_000), (504, "Ωμέγα \x00 the")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(3)
    got = lm.score(df, ~lm.held_out()).withColumn("held", lm.held_out()).collect()
    import zlib

    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    counts = Counter()
    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            counts.update([*split(t), b"\n"])
    n, v = sum(counts.values()), len(counts)
    want = []
    for (d, t), h in zip(rows, held, strict=True):
        w = [*split(t), b"\n"]
        want.append((d, h, len(w), sum(x in counts for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)))
    assert sorted(((r["doc_id"], r["held"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == sorted(want, key=str)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    fit = [r for r in got if r["held"] and r["n_tokens"] > 30]
    assert all(r["bits_per_byte"] < 6 for r in fit)


def test_no_training_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    r = lm.score(df, F.lit(False)).first()
    assert (r["n_known"], r["train_tokens"], r["base_score"]) == (0, 0, 0.0) and math.isfinite(r["score"])
    assert lm.score(df.limit(0), F.lit(True)).count() == 0


def test_scores_depend_on_no_split_of_rows_or_words(spark, monkeypatch):
    """The same however many words are looked up in the tasks, how rows lie in files, and how words are dealt."""
    rows = [*corpus(60), (500, None), (501, "the of the"), (502, "unseen"), (None, "of unseen"), (503, "unseen of of"), (504, "One of the sentences that come again, once more. " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scores = []
    for head, parts, counted_words in ((lm.HEAD_WORDS, 1, 10**6), (40, 5, 50), (0, 2, 10**6)):
        monkeypatch.setattr(lm, "HEAD_WORDS", head)
        monkeypatch.setattr(lm, "COUNTED_WORDS", counted_words)
        scores.append(sorted((str(r["doc_id"]), r["score"], r["base_score"]) for r in lm.score(df.repartition(parts), ~lm.held_out()).collect()))
    for other in scores[1:]:
        assert [x[0] for x in other] == [x[0] for x in scores[0]]
        assert np.allclose([x[1:] for x in other], [x[1:] for x in scores[0]], rtol=1e-9)


def test_hot_beginnings_are_dealt_by_more_bytes(spark, monkeypatch):
    monkeypatch.setattr(lm, "TASK_WORDS", 20)
    rows = [(i, f"hotword{i % 50}x{i}") for i in range(300)] + [(900, "cold")]
    words = spark.createDataFrame([(t.encode(), 1, 0) for _, t in rows], "word binary, mid long, last long")
    depth = {bytes(r["word"]): r["depth"] for r in lm._dealt(words).collect()}
    assert depth[b"cold"] == 4 and depth[b"hotword1x1"] in (8, 16) and max(depth.values()) == 16
    out = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True)).collect()
    assert len(out) == 301 and all(r["score"] < 0 for r in out)


def test_sentences_of_the_corpus_make_texts_likelier(spark):
    line = "a rather long sentence of quite unusual wording stands here."
    rows = [*corpus(40), *[(1000 + i, f"{line} own{i}") for i in range(10)]]
    df = spark.createDataFrame([*rows, (5000, line), (5001, line.replace("quite", "quiet"))], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score(df, F.col("doc_id") < 5000).collect()}
    assert got[5000] > 0.5 * got[5001] and got[5001] < -20


def test_training_texts_do_not_copy_themselves(spark):
    """A sentence that only its own text has is spelled there as in a held-out text; one that another has is copied."""
    rng = random.Random(12)
    line = lambda: " ".join(rng.choice(["the", "of", "stone", "river", "glass", "north", "summer"]) for _ in range(30)) + "."
    shared = line()
    rows = [*corpus(40), *[(1000 + i, line()) for i in range(60)], (2000, shared), (2001, shared), *[(5000 + i, line()) for i in range(30)]]
    twice = line()
    rows += [(3000, f"{twice} {twice}")]
    got = {r["doc_id"]: r["bits_per_byte"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 5000).collect()}
    trained, held = np.mean([got[1000 + i] for i in range(60)]), np.mean([got[5000 + i] for i in range(30)])
    assert 0.93 * held < trained < 1.02 * held
    assert got[2000] < 0.2 * held and got[2000] == got[2001] and got[3000] > 0.9 * held
