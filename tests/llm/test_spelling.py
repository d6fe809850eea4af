import random
import re
import zlib
from collections import Counter

import pytest
from colloquy.llm import spelling

DOCS = "doc_id long, text string, word string, n int"


def one_edit(a, b):
    """Plain check: whether one inserted, deleted or replaced code point makes a into b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute(vocab, ratio=10):
    forms, near = {}, {}
    for w in vocab:
        near[w] = [v for v in vocab if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-vocab[v], v), default=None)
        forms[w] = best if best is not None and vocab[best] >= ratio * vocab[w] else None
    out = set()
    for w, n in vocab.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.add((w, forms[w], root, n, len(near[w]), vocab.get(forms[w])))
    return out


def brute_words(rows, least=7, slip=31):
    found = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def rows_of(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def check(spark, vocab, **options):
    got = rows_of(spelling.variants(spark.createDataFrame(list(vocab.items()), "word string, n long"), **options))
    assert got == sorted(brute(vocab, **options), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force_on_crowded_words(spark, seed):
    rng = random.Random(seed)
    letters = ["ab", "aÉé", "abcz"][seed]
    vocab = {}
    while len(vocab) < 260:
        vocab["".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))] = rng.choice([1, 2, 9, 10, 20, 20, 200, 5000])
    check(spark, vocab)
    check(spark, vocab, ratio=2)


def test_runs_of_equal_letters_and_every_position(spark):
    base = "aabbbcccd"
    edits = {base[:i] + base[i + 1 :] for i in range(9)} | {base[:i] + x + base[i + d :] for i in range(10) for x in "abz" for d in (0, 1)}
    check(spark, {w: 7 + len(w) * (w < "b") for w in edits})


def test_long_words(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdef") for _ in range(3000))
    mid = "".join(rng.choice("abcdef") for _ in range(100))
    vocab = {long: 1000, long[:1500] + long[1501:]: 3, long[:2999] + "z": 4, "q" + long: 5, mid: 50, mid + "f": 2, mid[1:]: 5, mid[:64] + "x" + mid[65:]: 700}
    check(spark, vocab)


def test_letters_beyond_one_plane_and_hashes_of_hub_words(spark):
    hub = "centre"
    vocab = {hub: 10**6} | {hub[:i] + x + hub[i:]: 1 for i in range(7) for x in "xyz\U0001d400ÿ"}
    check(spark, vocab)


def test_words_of_texts(spark):
    rng = random.Random(9)
    stems = ["".join(rng.choice("abcdeéÀÿK") for _ in range(rng.randint(5, 12))) for _ in range(60)]
    rows = [(d, rng.choice([" ", "\n", "-", "9", "×"]).join(rng.choices(stems, k=300)), "x", 1) for d in range(20)]
    rows += [(None, " ".join(stems), None, None), (3, None, None, 2), (4, "", None, 2), (4, "Kelvins İstanbul straße straße", None, 2), rows[0], (5, "x" * 5000 + " " + "x" * 5000, None, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    vocab = spelling.vocabulary(spelling.occurrences(docs, 7, slip=31), 2)
    expected = brute_words(rows)
    assert {r.word: r.n for r in vocab.collect()} == expected and "x" * 5000 in expected
    assert rows_of(spelling.variants(vocab)) == sorted(brute(expected), key=str)


def test_without_slips(spark):
    docs = spark.createDataFrame([(1, "Wordings wordings wordinG9wording")], "doc_id long, text string")
    assert {r.word: r.n for r in spelling.vocabulary(spelling.occurrences(docs, 7), 1).collect()} == {"wordings": 2, "wording": 2}


def test_empty_null_and_repeated_words(spark):
    empty = spark.createDataFrame([], DOCS)
    assert rows_of(spelling.variants(spelling.vocabulary(spelling.occurrences(empty, 7, slip=31), 2))) == []
    given = spark.createDataFrame([(None, 3, 0), ("", 5, 0), ("word", 1, 0), ("word", 1, 1), ("sword", 20, 0)], "word string, n long, form int")
    assert rows_of(spelling.variants(given)) == [("sword", None, "sword", 20, 1, None), ("word", "sword", "sword", 2, 1, 20)]
    with pytest.raises(ValueError):
        spelling.variants(given, ratio=1)


def test_chains_follow_to_the_last_form(spark):
    words = ["abcdefg"[: 7 - i] for i in range(6)]
    check(spark, {w: 2 * 10**i for i, w in enumerate(words)})
