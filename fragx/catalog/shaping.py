"""Sharding, batching, chunking and token expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragx.catalog.registry import register
from fragx.fixtures import table
from fragx.functions import sequence as S
from fragx.operators import ordering as O, shaping as H


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")




@register("shard_contiguous", "SELECT doc_id, CAST(NTILE(7) OVER (ORDER BY doc_id) - 1 AS BIGINT) AS shard FROM documents")
def shard_contiguous(spark, sf_dir):
    return H.shard_contiguous(docs(spark, sf_dir).select("doc_id"), [F.col("doc_id")], 7)


@register("shard_strided", "SELECT doc_id, CAST((ROW_NUMBER() OVER (ORDER BY doc_id) - 1) % 7 AS BIGINT) AS shard FROM documents")
def shard_strided(spark, sf_dir):
    return H.shard_strided(docs(spark, sf_dir).select("doc_id"), [F.col("doc_id")], 7)


@register(
    "shard_strided_padded",
    """SELECT doc_id, CAST(i % 7 AS BIGINT) AS shard FROM (SELECT doc_id, rn AS i FROM (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY doc_id) - 1 AS rn FROM documents) d
     UNION ALL SELECT doc_id, rn + (SELECT COUNT(*) FROM documents) FROM (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY doc_id) - 1 AS rn FROM documents) d
      WHERE rn < (7 - (SELECT COUNT(*) FROM documents) % 7) % 7) x""",
)
def shard_strided_padded(spark, sf_dir):
    return H.shard_strided(docs(spark, sf_dir).select("doc_id"), [F.col("doc_id")], 7, pad=True)


@register(
    "batches",
    "SELECT doc_id, CAST((rn - 1) // 48 AS BIGINT) AS batch FROM (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY doc_id) AS rn, COUNT(*) OVER () AS n FROM documents) d WHERE rn <= n - n % 48",
)
def batches(spark, sf_dir):
    return H.batches(docs(spark, sf_dir).select("doc_id"), [F.col("doc_id")], 48, drop_last=True)


@register("batches_all", "SELECT doc_id, CAST((ROW_NUMBER() OVER (ORDER BY doc_id) - 1) // 48 AS BIGINT) AS batch FROM documents")
def batches_all(spark, sf_dir):
    return H.batches(docs(spark, sf_dir).select("doc_id"), [F.col("doc_id")], 48)


@register(
    "chunk_documents",
    """SELECT doc_id, CAST(k AS BIGINT) AS chunk, CAST(LEAST(k * 256, GREATEST(n_chars - 2 - 256, 0)) AS BIGINT) AS "offset" FROM
      (SELECT doc_id, n_chars, unnest(range(0, CAST(CEIL((n_chars - 1) / 256.0) AS BIGINT))) AS k FROM documents WHERE n_chars >= 10) c""",
)
def chunk_documents(spark, sf_dir):
    return H.chunk_documents(docs(spark, sf_dir), "n_chars", 256, 10).select("doc_id", "chunk", "offset")


@register(
    "pack_sequences",
    """SELECT CAST(s AS BIGINT) AS sample, doc_id, CAST(s * 512 - b AS BIGINT) AS "offset" FROM (SELECT doc_id, n_chars, SUM(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_chars AS b FROM documents) d
      JOIN (SELECT unnest(range(0, CAST(FLOOR((SUM(n_chars) - 1) / 512) AS BIGINT))) AS s FROM documents) x ON x.s * 512 >= d.b AND x.s * 512 < d.b + d.n_chars""",
)
def pack_sequences(spark, sf_dir):
    return H.pack_sequences(docs(spark, sf_dir), "doc_id", "n_chars", 512, [F.col("doc_id")])


@register("token_lengths", "SELECT lang, COUNT(*) AS items, CAST(SUM(LENGTH(text)) AS BIGINT) AS total, MIN(LENGTH(text)) AS shortest, MAX(LENGTH(text)) AS longest FROM documents GROUP BY lang")
def token_lengths(spark, sf_dir):
    return H.token_lengths(table(spark, sf_dir, "documents"), "text", ["lang"])


@register("sub_span", "SELECT doc_id, substring(text, CAST(doc_id % 50 AS BIGINT) + 1, CAST(doc_id % 90 AS BIGINT)) AS part FROM documents")
def sub_span(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", H.sub_span("text", F.col("doc_id") % 50, F.col("doc_id") % 90).alias("part"))


@register("center_crop", "SELECT doc_id, CASE WHEN LENGTH(text) > 200 THEN substring(text, (LENGTH(text) - 200) // 2 + 1, 200) ELSE text END AS middle FROM documents")
def center_crop(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.center_crop("text", 200).alias("middle"))


@register(
    "pad_arrays",
    """SELECT doc_id, batch, array_to_string(list_concat(w, list_transform(range(0, MAX(len(w)) OVER (PARTITION BY batch) - len(w)), lambda x: '<pad>')), '|') AS padded
     FROM (SELECT doc_id, doc_id // 32 AS batch, string_split(substring(text, 1, LENGTH(text)), ' ') AS w FROM documents) d""",
)
def pad_arrays(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 32).alias("batch"), F.split("text", " ").alias("w"))
    out = H.pad_arrays(d, "batch", "w", F.lit("<pad>"))
    return out.select("doc_id", "batch", F.array_join("padded", "|").alias("padded"))



@register(
    "encode_chars",
    """SELECT contig, array_to_string(list_concat(t, list_transform(range(0, GREATEST(1000 - len(t), 0)), lambda x: 1)), ' ') AS ids FROM (SELECT contig, list_slice(list_concat([0],
      list_transform(string_split(seq, ''), lambda c: CASE c WHEN 'A' THEN 4 WHEN 'C' THEN 5 WHEN 'G' THEN 6 WHEN 'T' THEN 7 ELSE 3 END), [2]), 1, 1000) AS t
      FROM genome WHERE seq <> '') g""",
)
def encode_chars(spark, sf_dir):
    g = table(spark, sf_dir, "genome").filter(F.col("seq") != "")
    ids = S.encode_chars("seq", bos=True, eos=True, max_length=1000, pad=True)
    return g.select("contig", F.array_join(F.transform(ids, lambda i: i.cast("string")), " ").alias("ids"))


@register(
    "encode_chars_whole",
    """SELECT contig, array_to_string(list_concat([0], list_transform(string_split(seq, ''), lambda c: CASE c WHEN 'A' THEN 4 WHEN 'C' THEN 5 WHEN 'G' THEN 6 WHEN 'T' THEN 7 ELSE 3 END), [2]), ' ') AS ids
      FROM genome g WHERE seq <> ''""",
)
def encode_chars_whole(spark, sf_dir):
    g = table(spark, sf_dir, "genome").filter(F.col("seq") != "")
    ids = S.encode_chars("seq", bos=True, eos=True)
    return g.select("contig", F.array_join(F.transform(ids, lambda i: i.cast("string")), " ").alias("ids"))


@register("decode_tokens", "SELECT contig, seq AS text FROM genome")
def decode_tokens(spark, sf_dir):
    g = table(spark, sf_dir, "genome")
    return g.select("contig", S.decode_tokens(S.encode_chars("seq")).alias("text"))


@register("shuffle_rows", "SELECT doc_id, n_chars, lang, ROW_NUMBER() OVER (ORDER BY md5(CONCAT(CAST(doc_id AS VARCHAR), ':7')), doc_id) AS place FROM documents")
def shuffle_rows(spark, sf_dir):
    shuffled = O.shuffle_rows(docs(spark, sf_dir), "doc_id", 7)
    return O.row_numbers(shuffled, [O.shuffle_key("doc_id", 7), F.col("doc_id")], name="place")


@register(
    "blend",
    """WITH s AS (SELECT 0 AS source, doc_id AS id, LENGTH(text) AS size, ROW_NUMBER() OVER (ORDER BY doc_id) AS rn, COUNT(*) OVER () AS n, 1.0::DOUBLE AS w, 0.0::DOUBLE AS start FROM documents
      UNION ALL SELECT 1, item_id, LENGTH(text), ROW_NUMBER() OVER (ORDER BY item_id), COUNT(*) OVER (), 3.0::DOUBLE, (SELECT COUNT(*) FROM documents)::DOUBLE FROM benchmark),
     d AS (SELECT draw, CAST(CONCAT('0x', substring(md5(CONCAT(CAST(draw AS VARCHAR), ':42')), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE
       * ((SELECT COUNT(*) FROM documents) + 3.0 * (SELECT COUNT(*) FROM benchmark))::DOUBLE AS u FROM range((SELECT COUNT(*) FROM s)) r(draw))
     SELECT d.draw, CAST(s.source AS INTEGER) AS source, s.id, CAST(s.size AS BIGINT) AS size FROM d JOIN s ON s.source = CASE WHEN d.u < (SELECT COUNT(*) FROM documents) THEN 0 ELSE 1 END
      AND s.rn = LEAST(CAST(FLOOR((d.u - s.start) / s.w) AS BIGINT), s.n - 1) + 1""",
)
def blend(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("size"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.length("text").cast("long").alias("size"))
    return H.blend(spark, [d, b], [1.0, 3.0], [F.col("id")])
