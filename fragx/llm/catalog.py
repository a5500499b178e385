"""Registered queries of the operators in this package, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from fragx.llm import ann, bpe, extract, langid, lexical, merkle, neardup, ngramjoin, packing, quality, repeats, secrets, warc
from fragx.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_posting_lists(spark, sf_dir) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op2_packing(spark, sf_dir) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op3_quality_rules(spark, sf_dir) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_language_id(spark, sf_dir) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


@query
def op5_near_duplicates(spark, sf_dir) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_warc(spark, sf_dir) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


ORACLES["op6_warc"] = """
WITH p AS (SELECT page_id, sha1(COALESCE(html, '')) AS payload_digest, CAST(strlen(COALESCE(html, '')) AS BIGINT) AS payload_bytes FROM pages),
m AS (SELECT *, MAX(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
 CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM m
"""


@query
def op7_secrets(spark, sf_dir) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query
def op8_bpe(spark, sf_dir) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op9_html_text(spark, sf_dir) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


@query
def op10_repeated_passages(spark, sf_dir) -> DataFrame:
    found = repeats.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[_rendered(c).alias(c) for c in ("spans", "later")], _covered("spans").alias("repeated_chars"), _covered("later").alias("later_chars"))


def _rendered(spans: str):
    """start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")


def _covered(spans: str):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


@query
def op11_ngram_join(spark, sf_dir) -> DataFrame:
    return ngramjoin.ngram_join(table(spark, sf_dir, "documents"))


ORACLES["op11_ngram_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, GREATEST(CASE WHEN len(w) > 0 THEN 2 ELSE 1 END, len(w) - 1))]) AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, UNNEST(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * LEAST(a.n, b.n) >= 90 * GREATEST(a.n, b.n)
 GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * COUNT(*) >= 90 * (a.n + b.n - COUNT(*))),
r AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, LEAST(s.doc_id, COALESCE(m.low, s.doc_id)) AS component_id FROM s LEFT JOIN (SELECT doc_id, MIN(other) AS low FROM r GROUP BY doc_id) m ON m.doc_id = s.doc_id
"""


@query
def op13_merkle_manifest(spark, sf_dir) -> DataFrame:
    return merkle.proofs(table(spark, sf_dir, "documents"))


# levels of all trees by recursion; CRC-32 bit by bit over the digits of doc_id
ORACLES["op13_merkle_manifest"] = """
WITH RECURSIVE d AS (SELECT doc_id, lang, text,
  CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END ||
  CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN regexp_extract_all(doc_id::VARCHAR, '.')])),
   lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END) END)) AS crc FROM documents),
l AS (SELECT doc_id, lang, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
  CASE WHEN crc % 3 = 0 AND text IS NOT NULL THEN sha256(head || strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) END AS other FROM d),
p AS (SELECT *, COALESCE(':' || lang, '-') AS tree, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
n AS (SELECT tree, 0 AS lvl, pos, leaf AS h, COUNT(*) OVER (PARTITION BY tree) AS size FROM p UNION ALL
 SELECT tree, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), COUNT(*) OVER (PARTITION BY tree) FROM n WHERE size > 1 GROUP BY tree, lvl, pos // 8),
r AS (SELECT tree, h AS subroot, ROW_NUMBER() OVER (ORDER BY tree) - 1 AS pos FROM n WHERE size = 1),
t AS (SELECT 0 AS lvl, pos, subroot AS h, COUNT(*) OVER () AS size FROM r UNION ALL
 SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), COUNT(*) OVER () FROM t WHERE size > 1 GROUP BY lvl, pos // 8),
s AS (SELECT p.tree, p.pos, n.lvl, COALESCE(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos < p.pos >> (3 * n.lvl)), '') AS a, COALESCE(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos > p.pos >> (3 * n.lvl)), '') AS b
 FROM (SELECT tree, pos::BIGINT AS pos FROM p) p JOIN n ON n.tree = p.tree AND n.size > 1 AND n.pos // 8 = p.pos >> (3 * n.lvl + 3) GROUP BY ALL UNION ALL
 SELECT p.tree, p.pos, 1000 + t.lvl, COALESCE(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < r.pos >> (3 * t.lvl)), ''), COALESCE(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > r.pos >> (3 * t.lvl)), '')
 FROM p JOIN r USING (tree) JOIN t ON t.size > 1 AND t.pos // 8 = r.pos >> (3 * t.lvl + 3) GROUP BY ALL),
g AS (SELECT tree, pos, list(a || '|' || b ORDER BY lvl) AS steps FROM s GROUP BY tree, pos),
f AS (SELECT p.doc_id, p.leaf, r.subroot, (SELECT h FROM t WHERE size = 1) AS root, COALESCE(g.steps, []) AS steps, COALESCE(p.other, p.leaf) AS start FROM p JOIN r USING (tree) LEFT JOIN g ON g.tree = p.tree AND g.pos = p.pos),
o AS (SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256,
 list_reduce(list_prepend(start, steps), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root FROM f)
SELECT *, folded_root = root AS verified FROM o
"""


@query
def op12_lexical_search(spark, sf_dir) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op12_lexical_search"] = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
d AS (SELECT ROW_NUMBER() OVER () AS row, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM t WHERE len(terms) > 0),
s AS (SELECT COUNT(*) AS docs, CAST(SUM(n) AS BIGINT) AS total FROM d),
p AS (SELECT row, term, COUNT(*) AS tf FROM (SELECT row, UNNEST(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(FLOOR(1000 * LN((2 * docs + 2)::DOUBLE / (2 * COUNT(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
i AS (SELECT item, item_id, term, COUNT(*) AS times FROM (SELECT item, item_id, UNNEST(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT ROW_NUMBER() OVER () AS item, * FROM (SELECT DISTINCT item_id, text FROM benchmark))) GROUP BY ALL),
m AS (SELECT row, doc_id, 75 + (25 * n * docs) // total AS m FROM d, s),
c AS (SELECT item, item_id, doc_id, CAST(SUM(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM i JOIN w USING (term) JOIN p USING (term) JOIN m USING (row) GROUP BY item, item_id, row, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM c WHERE score > 0) WHERE rank <= 20
"""
