"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import chat_format, decontamination, fingerprints, jaccard_join, langid, licenses, line_dedup, lm_scoring, packing, spelling, topk_search, warc, whitening
from colloquy.session import table


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_key")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.find(docs, table(spark, sf_dir, "benchmark"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = lm_scoring.held_out()
    out = lm_scoring.score(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(table(spark, sf_dir, "pages"), min_bytes=0)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_conversations(turns.unionByName(extra)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, ~langid.held_out())
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def vocabulary() -> str:
    """Where the public vocabulary of the packing query lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack(docs, vocabulary, size=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = spelling.occurrences(docs, min_length=7, slip=31)
    return spelling.variants(spelling.vocabulary(words, min_count=2), ratio=10)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)
    # null only where the exact number exceeds a long
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_decontamination": op2_decontamination,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_warc": op4_warc,
    "op5_licenses": op5_licenses,
    "op6_chat_format": op6_chat_format,
    "op8_language_id": op8_language_id,
    "op9_packing": op9_packing,
    "op7_line_dedup": op7_line_dedup,
    "op10_fingerprints": op10_fingerprints,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_whitening": op12_whitening,
    "op13_topk_search": op13_topk_search,
}

_KEYED_LINES = """
    split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs}),
    lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM split),
    keyed AS (
        SELECT doc_id, line, i,
            translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM lines),
    frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
"""

ORACLE_SQL = {
    "op1_jaccard_join": """
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS shingles
            FROM worded),
        sized AS (SELECT doc_id, len(shingles) AS n FROM sets),
        each AS (SELECT doc_id, unnest(shingles) AS shingle FROM sets),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        least_of AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
        named AS (SELECT doc_id, n, least(doc_id, coalesce(least, doc_id)) AS component_id FROM sized LEFT JOIN least_of ON a = doc_id)
        SELECT doc_id, n AS n_shingles, component_id, count(*) OVER (PARTITION BY component_id) AS class_size FROM named
    """,
    "op4_warc": """
        WITH payload AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        digest AS (SELECT page_id, strlen(html) AS n, sha1(html) AS hex FROM payload),
        named AS (
            SELECT *, array_to_string(list_transform(range(32), lambda i:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, i // 4 * 5 + 1, 5))::BIGINT >> (15 - i % 4 * 5)) & 31) + 1, 1)), '') AS payload_digest
            FROM digest),
        first AS (SELECT payload_digest, n, min(page_id) AS first FROM named GROUP BY ALL)
        SELECT page_id, n AS payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id > first THEN first END AS refers_to
        FROM named JOIN first USING (payload_digest, n)
    """,
    "op6_chat_format": """
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
        sized AS (
            SELECT *, CASE WHEN contains(text, '###') OR contains(text, '</turn>')
                THEN 1 + length(replace(replace(replace(text, '\\', '\\\\'), '#', '\\#'), '<', '\\<'))
                ELSE length(text) END AS shown
            FROM turns)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(4 + length(role) + 2 + shown + length('</turn>') + 1) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id
    """,
    "op7_line_dedup": f"""
        WITH {_KEYED_LINES.format(docs="documents")},
        flagged AS (SELECT keyed.*, frequent.key IS NOT NULL AS gone FROM keyed LEFT JOIN frequent USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM flagged GROUP BY doc_id
    """,
    "op11_spelling_variants": """
        WITH RECURSIVE crc_steps(i, k, c) AS (
            SELECT i, 0, i FROM range(256) t(i)
            UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM crc_steps WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS steps FROM crc_steps WHERE k = 8),
        runs AS (
            SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
        lowered AS (
            SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
            FROM runs WHERE length(run) >= 7 GROUP BY ALL),
        spelled AS (SELECT run, k, hex(encode(doc_id || ':' || run)) AS digits FROM lowered),
        hashed AS (
            SELECT run, k, xor(4294967295, list_reduce(
                list_prepend(4294967295, list_transform(range(length(digits) // 2), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::BIGINT)),
                lambda h, b: xor(h >> 8, steps[(xor(h, b) & 255) + 1]))) AS h
            FROM spelled, crc),
        slipped AS (
            SELECT k, CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word
            FROM hashed),
        vocab AS (SELECT word, sum(k)::BIGINT AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
        shorter AS (
            SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
        pairs AS (
            SELECT a.word, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT s.word, v.word, v.n FROM shorter s JOIN vocab v ON s.rest = v.word
            UNION SELECT v.word, s.word, s.n FROM shorter s JOIN vocab v ON s.rest = v.word),
        best AS (
            SELECT word, count(*) AS n_near, max(near_n) AS most FROM pairs GROUP BY word),
        named AS (
            SELECT best.word, n_near, most, min(near) AS near FROM best JOIN pairs ON pairs.word = best.word AND near_n = most GROUP BY ALL),
        forms AS (
            SELECT vocab.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN near END AS form,
                CASE WHEN most >= 10 * n THEN most END AS form_n
            FROM vocab LEFT JOIN named USING (word)),
        chains(word, root, step) AS (
            SELECT word, form, 1 FROM forms WHERE form IS NOT NULL
            UNION ALL SELECT chains.word, form, step + 1 FROM chains JOIN forms ON forms.word = root WHERE form IS NOT NULL),
        ends AS (SELECT word, arg_max(root, step) AS root FROM chains GROUP BY word)
        SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)
    """,
    "op13_topk_search": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, p.vec_id, list_inner_product(q.x, p.x)::BIGINT AS score
            FROM whole q JOIN whole p ON q.vec_id % 100 = 0 AND q.vec_id <> p.vec_id),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
}
