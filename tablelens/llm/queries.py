"""Registered queries of the operators, with SQL twins where SQL can express them."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    decontaminate,
    embeddings,
    html_extract,
    langid,
    near_dup,
    pii,
    prefix_trie,
    ranked_search,
    repeats,
    secrets,
    token_counts,
    toxicity,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), width=4)


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "token_ends"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "probability")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.annotate(docs, _table(spark, sf_dir, "benchmark")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    profiles = langid.learn(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), profiles).drop("text")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).drop("text")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ends = prefix_trie.build(_table(spark, sf_dir, "conversations"))
    found = nodes.join(prefix_trie.end_digests(ends), "node", "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(
        _table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), limit=2048
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(_table(spark, sf_dir, "documents"))
    return ranked_search.search(index, _table(spark, sf_dir, "benchmark"), k=50)


QUERIES = {
    "op1_pii": op1_pii,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_html_extract": op3_html_extract,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_secret_scan": op7_secret_scan,
    "op8_decontaminate": op8_decontaminate,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_token_counts": op12_token_counts,
    "op13_ranked_search": op13_ranked_search,
}

# crc32 of the decimal digits, eight shifts a byte
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

_OP11 = f"""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
         {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT c, count(*) AS n FROM own GROUP BY c),
convs AS (
  SELECT s.c, s.c - s.c % 20 AS base, h, least(h, coalesce(b.n, 0)) AS taken
  FROM (SELECT c, {_CRC32} % 4 AS h FROM sizes) s LEFT JOIN sizes b ON b.c = s.c - s.c % 20),
rebuilt AS (
  SELECT o.c, o.pos - v.h + v.taken AS pos, o.x FROM own o JOIN convs v ON o.c = v.c WHERE o.pos >= v.h
  UNION ALL
  SELECT v.c, o.pos, o.x FROM convs v JOIN own o ON o.c = v.base WHERE o.pos < v.taken),
paths AS (
  SELECT v.c, coalesce(list(r.x ORDER BY r.pos) FILTER (r.c IS NOT NULL), []) AS path
  FROM convs v LEFT JOIN rebuilt r ON r.c = v.c GROUP BY v.c),
members AS (SELECT c, path, unnest(range(0, len(path) + 1)) AS depth FROM paths),
nodes AS (
  SELECT path[1:depth] AS node, depth, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(path) = depth), '')) AS ends_sha256
  FROM members GROUP BY 1, 2),
children AS (SELECT node[1:depth - 1] AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
valued AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children,
         CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.node[depth].text, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM nodes n LEFT JOIN children k ON k.node = n.node),
below AS (
  SELECT node[1:d] AS node, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM valued) GROUP BY 1)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, b.n_leaves,
       b.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM valued v JOIN below b ON b.node = v.node
LEFT JOIN valued p ON v.depth > 0 AND p.node = v.node[1:v.depth - 1]"""

_TERM = "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP13 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, {_TERM}) AS words FROM documents WHERE text IS NOT NULL),
total AS (SELECT count(*) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM docs WHERE len(words) > 0),
postings AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM docs) GROUP BY 1, 2),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY 1), total),
items AS (
  SELECT i, item_id, unnest(list_distinct(regexp_extract_all({_LOWERED}, {_TERM}))) AS term
  FROM (SELECT row_number() OVER () AS i, * FROM benchmark WHERE text IS NOT NULL)),
scores AS (
  SELECT i, item_id, p.r, any_value(d.doc_id) AS doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(d.words) * n_docs) // n_terms))))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN postings p USING (term) JOIN docs d ON d.r = p.r, total
  GROUP BY i, item_id, p.r)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 50"""

# components by the smallest id reachable over links (a, b), both ways
_REACHED = """
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS x, b AS y FROM both_ways UNION SELECT r.x, l.b FROM reach r JOIN both_ways l ON l.a = r.y),
component AS (SELECT x, least(min(y), x) AS c FROM reach GROUP BY x)"""

_OP2 = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN w ELSE w[i:i + 3] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
links AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN sizes na ON na.doc_id = p.a JOIN sizes nb ON nb.doc_id = p.b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
{_REACHED.strip()}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN component ON x = d.doc_id"""

_OP5 = f"""
WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM sound p JOIN sound q
  ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.v) = len(q.v) AND list_cosine_similarity(p.v, q.v) >= 0.93),
{_REACHED.strip()},
degrees AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY 1)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(c, e.vec_id) AS component_id, coalesce(c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN degrees ON id = e.vec_id LEFT JOIN component ON x = e.vec_id"""

_OP8 = f"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWERED}, {_TERM}), []) AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWERED}, {_TERM}) AS w FROM benchmark WHERE text IS NOT NULL),
searched AS (
  SELECT DISTINCT item, CASE WHEN len(w) < 10 THEN w ELSE w[i:i + 9] END AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
windows AS (
  SELECT doc_id, size, i, w[i:i + size - 1] AS s
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT len(s) AS size FROM searched) WHERE len(w) >= size)),
found AS (SELECT doc_id, size, i, item FROM windows JOIN searched USING (s)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY 1),
owners AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(owners.n, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM docs d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN owners ON owners.doc_id = d.doc_id"""

#: The others need a trained model, a digest over bytes, or a library.
SQL: dict[str, str] = {
    "op2_minhash_near_dedup": _OP2,
    "op5_embedding_near_dedup": _OP5,
    "op8_decontaminate": _OP8,
    "op11_conversation_trie": _OP11,
    "op13_ranked_search": _OP13,
}
