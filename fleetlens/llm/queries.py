"""The registered queries of this package, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import chat_format, decontamination, exact_search, lexical_search, licences, line_dedup, merkle, neighbour_graph, ngram_join, packing, sampled_pieces, substring_dedup, toxicity
from fleetlens.llm.common import LOWER, UPPER, table

ORACLE: dict[str, str] = {}

ORACLE["op2_chat_formatting"] = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
    SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\])', '\1\\\2\3', 'g'))
            + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\])', '\1\\\2\3', 'g')) + 14 AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id"""


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.digests(chat_format.format_chats(chat_format.records_of_turns(rows), "conv_id", "record"), "conv_id")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    said = docs.select("doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("crc")).groupBy("doc_id").agg(F.collect_set("crc").alias("said"))
    got = sampled_pieces.checksums(sampled_pieces.encode_samples(docs))
    return got.join(said, "doc_id").select("doc_id", "sample", "n_pieces", "score", "inclusion", "ids_crc32", F.array_contains("said", F.col("text_crc32")).alias("round_trip"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = licences.documents_with_licences(docs, licences.fit(docs))
    return got.select("doc_id", "n_paragraphs", "n_licences", F.array_join("families", ",").alias("families"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = toxicity.score(docs, toxicity.fitted(spark, docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return got.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_graph.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE["op9_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda x: x[1] * x[2])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.top_products(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_WORDS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE["op11_lexical_search"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, words, len(words) AS n FROM (SELECT doc_id, {_WORDS} AS words FROM documents WHERE text IS NOT NULL) WHERE len(words) > 0),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM docs),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM docs) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term, docs),
asked AS (SELECT DISTINCT item_id, unnest(words) AS term FROM (SELECT item_id, {_WORDS} AS words FROM benchmark WHERE text IS NOT NULL)),
scores AS (SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * corpus.docs) // length)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN docs USING (r), corpus GROUP BY item_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM scores JOIN docs USING (r) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) <= 10"""


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLE["op12_decontamination"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS words FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (SELECT DISTINCT item, size, list_slice(words, spot, spot + size - 1) AS w FROM (SELECT item, words, least(len(words), 10) AS size, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS spot FROM items WHERE len(words) > 0)),
runs AS (SELECT r, spot, size, list_slice(words, spot, spot + size - 1) AS w FROM (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS spot FROM docs, (SELECT DISTINCT size FROM windows))),
met AS (SELECT r, spot, size, item FROM runs JOIN windows USING (size, w)),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(spot, spot + size)) AS place FROM met) GROUP BY r),
said AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN said USING (r)"""


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontamination.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_FIELDS = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
ORACLE["op13_merkle_manifest"] = f"""
WITH RECURSIVE
    step(i, bit, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, bit + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE bit < 8),
    crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE bit = 8),
    rows AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 3 = 0 AS tampered FROM documents, crc),
    found AS (SELECT *, CASE WHEN tampered THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS late FROM rows),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM (
        SELECT doc_id, lang, sha256({_FIELDS} || {_FIELD.format("text")}) AS leaf, sha256({_FIELDS} || {_FIELD.format("late")}) AS seen FROM found)),
    nodes(lang, level, pos, digest, n) AS (SELECT lang, 0, pos, leaf, n FROM leaves
        UNION ALL SELECT lang, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 7) // 8 FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 8),
    subroots AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS top, count(*) OVER () AS n FROM nodes WHERE n = 1),
    tops(level, pos, digest, n) AS (SELECT 0, top, subroot, n FROM subroots
        UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, pos // 8),
    numbered AS (SELECT *, row_number() OVER () AS row FROM leaves JOIN (SELECT lang AS named, subroot, top FROM subroots) s ON lang IS NOT DISTINCT FROM named),
    sides AS (SELECT row, level, coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos < mine), '') AS before, coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos > mine), '') AS after FROM (
        SELECT row, level, k.pos, digest, CAST(floor(r.pos / pow(8, level)) AS BIGINT) AS mine FROM numbered r JOIN nodes k ON r.lang IS NOT DISTINCT FROM k.lang AND k.n > 1 AND k.pos // 8 = CAST(floor(r.pos / pow(8, level + 1)) AS BIGINT)
        UNION ALL SELECT row, 100 + level, k.pos, digest, CAST(floor(top / pow(8, level)) AS BIGINT) FROM numbered JOIN tops k ON k.n > 1 AND k.pos // 8 = CAST(floor(top / pow(8, level + 1)) AS BIGINT)) GROUP BY row, level),
    paths AS (SELECT row, list(struct_pack(b := before, a := after) ORDER BY level) AS path, string_agg(before || after, '' ORDER BY level) AS proof FROM sides GROUP BY row),
    folds(row, k, digest, path) AS (SELECT row, 0, seen, coalesce(path, []) FROM numbered LEFT JOIN paths USING (row)
        UNION ALL SELECT row, k + 1, sha256(path[k + 1].b || digest || path[k + 1].a), path FROM folds WHERE k < len(path))
SELECT doc_id, leaf, subroot, tops.digest AS root, sha256(coalesce(proof, '')) AS proof_sha256, folds.digest AS folded_root, folds.digest = tops.digest AS verified
FROM numbered JOIN folds USING (row) LEFT JOIN paths USING (row) JOIN tops ON tops.n = 1 WHERE k = len(folds.path)"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    late = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    got = merkle.manifest(docs, seen={"text": late})
    return got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: function for name, function in globals().items() if name.startswith("op") and callable(function)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
