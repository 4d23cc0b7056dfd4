"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(f):
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


@_query
def op1_quality_rules(spark, sf_dir):
    from .rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


@_query
def op2_token_shards(spark, sf_dir):
    from .sstable import token_shards

    return token_shards(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op3_token_counts(spark, sf_dir):
    from .tokens import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op4_line_dedup(spark, sf_dir):
    from .lines import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


@_query
def op5_sentencepiece(spark, sf_dir):
    from .segments import sampled_segmentations

    return sampled_segmentations(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op6_decontamination(spark, sf_dir):
    from .leaks import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


@_query
def op7_language(spark, sf_dir):
    from .language import detect, fit_languages

    docs = _table(spark, sf_dir, "documents")
    return detect(docs, fit_languages(docs, public_tokenizers.path("piece_bpe_32k.model")))


@_query
def op8_warc(spark, sf_dir):
    from .warc import page_archive

    return page_archive(_table(spark, sf_dir, "pages"))


@_query
def op9_minhash_near_dedup(spark, sf_dir):
    from .neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), k=4).drop("text_hash")


@_query
def op10_quality_classifier(spark, sf_dir):
    from .quality import fit_quality, score_quality

    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))


@_query
def op11_merkle_manifest(spark, sf_dir):
    from .merkle import document_manifest

    return document_manifest(_table(spark, sf_dir, "documents"))


@_query
def op12_match_fingerprints(spark, sf_dir):
    from .lexicons import match_fingerprints

    return match_fingerprints(_table(spark, sf_dir, "documents"))


@_query
def op13_vector_codes(spark, sf_dir):
    from .vectorcodes import vector_codes

    return vector_codes(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_token_shards, op3_token_counts, op4_line_dedup, op5_sentencepiece, op6_decontamination, op7_language, op8_warc, op9_minhash_near_dedup, op10_quality_classifier, op11_merkle_manifest, op12_match_fingerprints, op13_vector_codes)}

#: The largest page_id of equal payloads is the response. Base32 of a SHA-1: eight groups of five hex digits, four characters each.
_ARCHIVE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
q AS (SELECT page_id, strlen(t) AS n, upper(sha1(t)) AS x, max(page_id) OVER (PARTITION BY t) AS top FROM p),
d AS (SELECT *, list_transform(range(0, 8), lambda k: (strpos('0123456789ABCDEF', substr(x, (5 * k + 1)::INT, 1)) - 1) * 65536
  + (strpos('0123456789ABCDEF', substr(x, (5 * k + 2)::INT, 1)) - 1) * 4096 + (strpos('0123456789ABCDEF', substr(x, (5 * k + 3)::INT, 1)) - 1) * 256
  + (strpos('0123456789ABCDEF', substr(x, (5 * k + 4)::INT, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(x, (5 * k + 5)::INT, 1)) - 1) AS v FROM q)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((v[(k // 4 + 1)::INT] >> (15 - 5 * (k % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""

#: Links on full sets of 4-word shingles; each number goes along links to larger ones, and the least that arrives is the component.
_NEAR = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(g) AS n FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id),
both_in AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_in JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
walk(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT edge.b, walk.c FROM walk JOIN edge ON edge.a = walk.doc_id WHERE walk.c < edge.b),
least AS (SELECT doc_id, min(c) AS component_id FROM walk GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN least USING (doc_id)
"""

#: The polynomial of CRC-32 and its start. Levels of nodes come one after the other; siblings of a leaf's ancestors, by level, are its proof.
_MANIFEST = """
WITH RECURSIVE crc_table AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY n) AS t FROM range(256) r(n)),
d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, n_chars, text, CAST(doc_id AS VARCHAR) AS id FROM documents),
crc AS (SELECT r, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(id, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) % 256 + 1)::INT], c // 256)), 4294967295) AS c FROM d, crc_table WHERE id IS NOT NULL),
f AS (SELECT d.*, coalesce(c % 2 = 0, false) AS changed, concat(coalesce(concat(strlen(id), ':', id), '-'), coalesce(concat(strlen(source), ':', source), '-'), coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars), '-')) AS head, replace(text, chr(10), '') AS less FROM d LEFT JOIN crc USING (r)),
l AS (SELECT r, doc_id, source, sha256(concat(head, coalesce(concat(strlen(text), ':', text), '-'))) AS leaf, sha256(concat(head, coalesce(CASE WHEN changed THEN concat(strlen(less), ':', less) ELSE concat(strlen(text), ':', text) END, '-'))) AS told FROM f),
leaves AS MATERIALIZED (SELECT *, coalesce('1' || source, '0') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
tree AS (SELECT g, 0 AS lvl, i AS idx, leaf AS h FROM leaves UNION ALL SELECT g, lvl, idx, h FROM (SELECT g, lvl + 1 AS lvl, idx // 3 AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h, max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM tree) GROUP BY g, lvl, idx // 3) WHERE n > 1),
roots AS MATERIALIZED (SELECT g, arg_max(h, lvl) AS subroot, max(lvl) AS top, row_number() OVER (ORDER BY g) - 1 AS i FROM tree GROUP BY g),
upper AS (SELECT 0 AS lvl, i AS idx, subroot AS h FROM roots UNION ALL SELECT lvl, idx, h FROM (SELECT lvl + 1 AS lvl, idx // 3 AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h, max(n) AS n FROM (SELECT *, count(*) OVER () AS n FROM upper) GROUP BY lvl, idx // 3) WHERE n > 1),
every AS MATERIALIZED (SELECT g, lvl, idx, h FROM tree UNION ALL SELECT '', lvl, idx, h FROM upper),
ways AS (SELECT r, leaves.g AS g, lvl, lvl AS nth, leaves.i // CAST(pow(3, lvl) AS BIGINT) AS own FROM leaves JOIN roots USING (g), range(40) k(lvl) WHERE lvl < top
  UNION ALL SELECT r, '', lvl, 100 + lvl, roots.i // CAST(pow(3, lvl) AS BIGINT) FROM leaves JOIN roots USING (g), range(40) k(lvl) WHERE lvl < (SELECT max(lvl) FROM upper)),
sides AS (SELECT w.r, w.nth, coalesce(string_agg(e.h, '' ORDER BY e.idx) FILTER (e.idx < w.own), '') AS a, coalesce(string_agg(e.h, '' ORDER BY e.idx) FILTER (e.idx > w.own), '') AS b FROM ways w JOIN every e ON e.g = w.g AND e.lvl = w.lvl AND e.idx // 3 = w.own // 3 GROUP BY w.r, w.nth),
packed AS (SELECT r, string_agg(a || b, '' ORDER BY nth) AS others, list(a || '|' || b ORDER BY nth) AS steps FROM sides GROUP BY r),
made AS (SELECT doc_id, leaf, subroot, (SELECT arg_max(h, lvl) FROM upper) AS root, sha256(coalesce(others, '')) AS proof_sha256,
  list_reduce(list_prepend(told, coalesce(steps, [])), lambda acc, x: sha256(concat(split_part(x, '|', 1), acc, split_part(x, '|', 2)))) AS folded_root FROM leaves JOIN roots USING (g) LEFT JOIN packed USING (r))
SELECT *, folded_root = root AS verified FROM made
"""

#: A part of every vector and an entry of every codebook meet in each round; squared distances of integers are exact in doubles.
_VECTORS = """
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS FIRST, label NULLS FIRST) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, v[(p * (len(v) // 4) + 1)::INT:((p + 1) * (len(v) // 4))::INT] AS x FROM kept, range(4) q(p)),
placed AS MATERIALIZED (SELECT r, p, unnest(x) AS y, generate_subscripts(x, 1) AS pos FROM parts),
book0 AS MATERIALIZED (SELECT p, r - 1 AS k, x AS e FROM parts WHERE r <= 256)
{rounds},
found AS ({final}),
codes AS (SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM found GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(e, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, k)) FROM book4) AS codebooks_sha256 FROM kept JOIN codes USING (r)
"""
_NEAREST = "SELECT r, p, m.d AS d, m.k AS k FROM (SELECT r, p, min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, e) + list_inner_product(e, e), 'k': k}}) AS m FROM parts JOIN {0} USING (p) GROUP BY r, p)"
_ROUND = """,
near{0} AS MATERIALIZED ({1}),
mean{0} AS (SELECT p, k, list(y ORDER BY pos) AS e FROM (SELECT p, k, pos, floor(sum(y) / count(*)) AS y FROM placed JOIN near{0} USING (r, p) GROUP BY p, k, pos) GROUP BY p, k),
book{2} AS MATERIALIZED (SELECT p, k, coalesce(m.e, b.e) AS e FROM book{0} b LEFT JOIN mean{0} m USING (p, k))"""
_CODES = _VECTORS.format(rounds="".join(_ROUND.format(i, _NEAREST.format(f"book{i}"), i + 1) for i in range(4)), final=_NEAREST.format("book4"))

ORACLE_SQL: dict[str, str] = {"op8_warc": _ARCHIVE, "op9_minhash_near_dedup": _NEAR, "op11_merkle_manifest": _MANIFEST, "op13_vector_codes": _CODES}
