import random
import zlib
from collections import Counter

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from colloquy.llm import decontamination as dc
from colloquy.llm import langid
from tests.llm import test_decontamination, test_jaccard_join, test_line_dedup


def documents():
    rng = random.Random(7)
    english = "the of and to in is that was for it with as his on be at by this had not are but from or have".split()
    german = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split()
    text = lambda ws, n: " ".join(rng.choice(ws) + rng.choice(["", "", "er", "en", "ing"]) for _ in range(n))
    rows = []
    for i in range(90):
        ws, lang = (english, "en") if i % 3 else (german, "de")
        lines = [text(ws, rng.randint(8, 60)) for _ in range(rng.randint(1, 4))]
        if i % 5 == 0:
            lines.insert(rng.randint(0, 1), "A line that MANY share" + " " * (i % 2))
        rows.append([i, "\n".join(lines), lang, f"s{i % 4}"])
    for i in range(12):
        words = rows[i][1].split(" ")
        words[len(words) // 2] = "changed"
        rows.append([200 + i, " ".join(words) if i % 2 else rows[i][1], rows[i][2], "copy"])
    item = " ".join(f"item{k}" for k in range(25))
    rows += [[300, text(english, 30) + " " + item + " " + text(english, 9), "en", "leak"], [301, "12 34 !?", None, "x"], [302, None, "en", "x"], [303, "", None, "x"]]
    rows += [list(rows[3])]
    return [(d, t, lang, s, len(t or "")) for d, t, lang, s in rows], [(1, item), (2, "short")]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after each stage, and the result."""
    folder = tmp_path_factory.mktemp("sf")
    rows, items = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/after-{name}")
        docs = spark.read.parquet(f"{folder}/after-{name}")
        seen[name] = docs
    return rows, items, seen, corpus_pipeline.run(spark, str(folder)).collect()


def test_columns_stay_until_the_last_stage(stages):
    for name, docs in stages[2].items():
        assert name == "packing" or docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_stages_equal_brute_force(stages):
    rows, items, seen, result = stages
    plain = lambda name: sorted((r["doc_id"], r["text"] or "") for r in seen[name].collect())
    now = [(d, t) for d, t, *_ in rows if langid.letters(t)]
    assert plain("language_id") == sorted(now)
    now = [(d, t) for d, _, _, t in test_line_dedup.brute(now, corpus_pipeline.MIN_DOCS)]
    assert plain("line_dedup") == sorted(now)
    first = {(d, c) for d, _, c in test_jaccard_join.brute(now)}
    now = list(dict.fromkeys(x for x in now if (x[0], x[0]) in first))
    assert plain("jaccard_join") == sorted(now)
    ids = dc.PlainWords()
    leaks = {d for d, t in now for _, b in items if len(ids.sequence(b)) >= dc.MIN_WORDS and test_decontamination.distance(ids.sequence(b).tolist(), ids.sequence(t).tolist()) <= dc.allowed_edits(len(ids.sequence(b)))}
    assert leaks == {300}
    now = [x for x in now if x[0] not in leaks]
    assert plain("decontamination") == sorted(now)
    tok = Tokenizer.from_file(corpus_pipeline.vocabulary())
    pieces = {}
    for r in result:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert Counter(pieces) .keys() == Counter(d for d, _ in now).keys()
    import numpy as np

    for d, t in now:
        want = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(want[r["start"] : at].tobytes())
        assert at == len(want)


def test_n_chars_follow_the_text(stages):
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2]["line_dedup"].collect())


def test_documents_without_any_language_stay(spark):
    rows = [(1, "some words here"), (2, "12 34"), (3, None), (4, "Ωμέγα")]
    docs = spark.createDataFrame([(d, t, None, "s", 1) for d, t in rows], SCHEMA)
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_identified(spark, docs, "").collect()) == [1, 4]


def test_one_row_of_a_class_stays_though_ids_repeat_or_are_null(spark):
    rng = random.Random(3)
    base = lambda: [f"w{rng.randint(0, 10**6)}" for _ in range(80)]
    near = lambda ws: " ".join([*ws[:-1], "other"])
    a, b, c, d, e = (base() for _ in range(5))
    plain = " ".join
    # near copies with one id, near copies without id, a class with and without id, unrelated texts of one id
    rows = [(1, plain(a)), (1, near(a)), (None, plain(b)), (None, near(b)), (None, plain(c)), (2, near(c)), (5, plain(d)), (5, plain(e))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = Counter((r["doc_id"], r["text"].split()[0]) for r in corpus_pipeline.keep_one_of_each_class(spark, docs, "").collect())
    assert got == Counter([(1, a[0]), (None, b[0]), (2, c[0]), (5, d[0]), (5, e[0])])


MORE = SCHEMA + ", _key int, _id int, _text_key int, key int, row int, `class` int, _hit int"


def test_further_columns_of_any_name_pass_through(spark):
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60))
    one = text()
    rows = [(i, t, "en", "s", len(t), *range(7 * i, 7 * i + 7)) for i, t in enumerate([one, one, text(), text()])]
    docs = spark.createDataFrame(rows, MORE)
    for name, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, "")
        assert docs.columns == [c.strip().split()[0].strip("`") for c in MORE.split(",")], name
    assert sorted(tuple(r) for r in docs.collect()) == [r for i, r in enumerate(rows) if i != 1]


def test_empty_tables_pass_all_stages(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0, name


def test_null_ids_and_texts_pass_all_stages(spark, tmp_path):
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(None, None, None, None, None), (None, "some plain words", "en", None, 1), (2, "", None, "s", 0), (3, "other plain words", "en", "s", None)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert Counter(r["doc_id"] for r in docs.select("doc_id").distinct().collect()) == Counter([None, 3])
