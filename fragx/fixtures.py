"""Derived tables over the test data, in SQL that Spark and DuckDB both run.

``{orders}`` and the like stand for base tables. The few places where the two
dialects differ use ``{G}`` (regexp flag), ``{QUAL}``, ``{CLASSES}``. The test
tables are single files, so hints deal the heavier ones over tasks, as the
splits of a large table would; DuckDB reads the hints as comments.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

FIXTURES: dict[str, str] = {}

FIXTURES["contigs"] = """
SELECT DISTINCT CONCAT('chr', CAST(1 + o_orderkey % 22 AS STRING)) AS contig, CAST(20000000 AS BIGINT) AS len,
 CAST(8000000 AS BIGINT) AS p_end, CAST(10000000 AS BIGINT) AS q_start FROM {orders}
"""

FIXTURES["numbered"] = """
SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM {lineitem}
"""

FIXTURES["reads"] = """
SELECT l_orderkey * 100 + rn AS rid,
 CONCAT('s', CAST(l_suppkey % 8 AS STRING)) AS sample_id,
 CONCAT('q', CAST(l_orderkey AS STRING), '_', CAST(CAST(FLOOR((rn - 1) / 2.0) AS BIGINT) AS STRING)) AS qname,
 CONCAT('chr', CAST(1 + l_orderkey % 22 AS STRING)) AS contig,
 (l_orderkey * 104729) % 19990000 + (rn - 1) * 60 + l_partkey % 20 AS pos,
 CAST(l_quantity AS INT) + 10 AS mapq,
 CASE WHEN l_orderkey % 2 = 0 THEN CASE WHEN rn % 2 = 1 THEN 99 ELSE 147 END
      ELSE CASE WHEN rn % 2 = 1 THEN 163 ELSE 83 END END
  + CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 1024 ELSE 0 END
  + CASE WHEN CAST(ROUND(l_tax * 100) AS INT) = 8 THEN 512 ELSE 0 END AS flag,
 CASE l_linenumber WHEN 2 THEN '5S95M' WHEN 3 THEN '60M2D40M' WHEN 4 THEN '50M3I47M' WHEN 6 THEN '95M5S'
  WHEN 7 THEN '30M10N70M' ELSE '100M' END AS cigar,
 CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(ROUND(l_discount * 100) AS INT) % 5 END AS nm,
 CASE WHEN rn % 2 = 1 THEN 1 ELSE -1 END * (CAST(l_quantity AS INT) * 13) AS tlen, 100 AS qlen
FROM numbered
"""

FIXTURES["sites"] = """
SELECT p_partkey AS site_id, CONCAT('chr', CAST(1 + p_partkey % 22 AS STRING)) AS contig,
 (p_partkey * 1000003) % 19990000 AS st, (p_partkey * 1000003) % 19990000 + 500 * p_size AS en,
 CONCAT(p_brand, ',', p_type) AS grp FROM {part}
"""

FIXTURES["cpg"] = """
SELECT o_orderkey AS cpg_id, CONCAT('chr', CAST(1 + o_orderkey % 22 AS STRING)) AS contig,
 (o_orderkey * 104729) % 19990000 + o_custkey % 50 AS st, (o_orderkey * 104729) % 19990000 + o_custkey % 50 + 12 AS en,
 CASE o_orderkey % 4 WHEN 0 THEN 'ACG' WHEN 1 THEN 'TCG' WHEN 2 THEN 'CCG' ELSE 'GCG' END AS ncg,
 CASE o_custkey % 4 WHEN 0 THEN 'CGA' WHEN 1 THEN 'CGT' WHEN 2 THEN 'CGC' ELSE 'CGG' END AS cgn,
 CASE WHEN o_custkey % 3 = 0 THEN 'c1,c2' WHEN o_custkey % 3 = 1 THEN 'c1' ELSE 'c3' END AS cancer,
 CASE WHEN o_orderstatus = 'F' THEN 'hyper' ELSE 'hypo' END AS typ,
 CAST(o_custkey % 101 AS DOUBLE) / 100 AS reference FROM {orders}
"""

# Pending orders carry no call, so a third of the sites has no value.
FIXTURES["calls"] = """
SELECT o_orderkey AS call_id, CONCAT('chr', CAST(1 + o_orderkey % 22 AS STRING)) AS chr,
 (o_orderkey * 104729) % 19990000 + o_custkey % 50 AS position,
 CAST(o_custkey % 1000 AS DOUBLE) / 1000 AS probability, 3 + o_custkey % 40 AS depth
FROM {orders} WHERE o_orderstatus <> 'P'
"""

FIXTURES["genome"] = """
SELECT CONCAT('chr', CAST(doc_id + 1 AS STRING)) AS contig,
 translate(lower(regexp_replace(text, '[^a-zA-Z]', ''{G})), 'abcdefghijklmnopqrstuvwxyz',
  'ACGTACGTACGTACGTACGTACGTAC') AS seq
FROM (SELECT /*+ REPARTITION(16) */ doc_id, text FROM {documents}) d
"""

# Rows of lineitem with the genome contig they live on.
FIXTURES["homed"] = """
SELECT *, CONCAT('chr', CAST(1 + l_orderkey % (SELECT COUNT(*) FROM {documents}) AS STRING)) AS home FROM numbered
"""

FIXTURES["variants"] = """
SELECT DISTINCT contig, pos,
 CASE WHEN l_linenumber = 7 THEN SUBSTRING(seq, CAST(pos + 1 AS INT), 3) ELSE SUBSTRING(seq, CAST(pos + 1 AS INT), 1) END AS ref,
 CASE WHEN l_linenumber = 7 THEN SUBSTRING(seq, CAST(pos + 1 AS INT), 1)
  WHEN l_linenumber = 6 THEN CONCAT(SUBSTRING(seq, CAST(pos + 1 AS INT), 1), 'AC')
  ELSE translate(SUBSTRING(seq, CAST(pos + 1 AS INT), 1), 'ACGT',
   CASE l_suppkey % 3 WHEN 0 THEN 'CGTA' WHEN 1 THEN 'GTAC' ELSE 'TACG' END) END AS alt,
 CASE WHEN l_returnflag = 'R' THEN 'LowQual' ELSE 'PASS' END AS filt,
 CASE WHEN CAST(ROUND(l_tax * 100) AS INT) = 0 THEN 0 WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS gt_a,
 CASE WHEN CAST(ROUND(l_tax * 100) AS INT) = 0 THEN 0 ELSE 1 END AS gt_b,
 CAST(l_quantity * 2 AS INT) AS qual
FROM (SELECT l.*, g.contig, g.seq, (l_partkey * 31 + l_orderkey * 7 + l_linenumber) % LENGTH(g.seq) AS pos
 FROM homed l JOIN genome g ON LENGTH(g.seq) > 0 AND g.contig = l.home) v
"""

# Reads placed on the genome, with sequence and base qualities; one base per read is changed.
FIXTURES["placed"] = """
SELECT n.*, g.contig AS gcontig, g.seq AS gseq,
 (l_orderkey * 104729) % GREATEST(LENGTH(g.seq) - 300, 1) + (rn - 1) * 40 AS gpos
FROM homed n JOIN genome g ON LENGTH(g.seq) > 0 AND g.contig = n.home
"""

FIXTURES["aligned"] = """
SELECT rid, sample_id, qname, contig, pos, mapq, flag, cigar, tlen, qlen,
 CONCAT(SUBSTRING(s, 1, k), translate(SUBSTRING(s, k + 1, 1), 'ACGT', 'CGTA'), SUBSTRING(s, k + 2, 100)) AS seq,
 {QUAL} AS qual
FROM (SELECT l_orderkey * 100 + rn AS rid, CONCAT('s', CAST(l_suppkey % 8 AS STRING)) AS sample_id,
 CONCAT('q', CAST(l_orderkey AS STRING), '_', CAST(CAST(FLOOR((rn - 1) / 2.0) AS BIGINT) AS STRING)) AS qname,
 gcontig AS contig, gpos AS pos, CAST(l_quantity AS INT) + 10 AS mapq,
 CASE WHEN l_orderkey % 2 = 0 THEN CASE WHEN rn % 2 = 1 THEN 99 ELSE 147 END
      ELSE CASE WHEN rn % 2 = 1 THEN 163 ELSE 83 END END
  + CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 1024 ELSE 0 END
  + CASE WHEN CAST(ROUND(l_tax * 100) AS INT) = 8 THEN 512 ELSE 0 END AS flag,
 CASE l_linenumber WHEN 2 THEN '5S95M' WHEN 3 THEN '60M2D40M' WHEN 4 THEN '50M3I47M' WHEN 6 THEN '95M5S'
  WHEN 7 THEN '30M10N70M' ELSE '100M' END AS cigar,
 CASE WHEN rn % 2 = 1 THEN 1 ELSE -1 END * (CAST(l_quantity AS INT) * 13) AS tlen, 100 AS qlen,
 RPAD(SUBSTRING(gseq, CAST(gpos + 1 AS INT), 100), 100, 'N') AS s, CAST(l_partkey % 100 AS INT) AS k FROM placed) a
"""

# Sites on the genome, one per order, at a place its reads can reach.
FIXTURES["loci"] = """
SELECT DISTINCT g.contig, (o_orderkey * 104729) % GREATEST(LENGTH(g.seq) - 300, 1) + 30 + o_custkey % 60 AS locus
FROM (SELECT *, CONCAT('chr', CAST(1 + o_orderkey % (SELECT COUNT(*) FROM {documents}) AS STRING)) AS home FROM {orders}) o
 JOIN genome g ON LENGTH(g.seq) > 0 AND g.contig = o.home
"""

# Class weights: the 64 dimensions folded onto 24 classes, so that every dimension counts.
FIXTURES["weights24"] = """
SELECT vec_id, label, CAST(i % 24 AS INT) AS idx, SUM(ABS(CAST(x AS DOUBLE))) AS w FROM {CLASSES}
GROUP BY vec_id, label, CAST(i % 24 AS INT)
"""

FIXTURES["weights11"] = FIXTURES["weights24"].replace("24", "11")

FIXTURES["probs24"] = """
SELECT vec_id, label, idx, w / SUM(w) OVER (PARTITION BY vec_id) AS p FROM weights24
"""

FIXTURES["probs11"] = FIXTURES["probs24"].replace("24", "11")

FIXTURES["scores"] = """
SELECT l.doc_id, l.quality AS y, CAST(d.n_chars % 997 AS DOUBLE) / 997 AS score
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
"""

FIXTURES["samples"] = """
SELECT CONCAT('s', CAST(c_custkey AS STRING)) AS sample_id, CAST(20 + c_custkey % 60 AS INT) AS age,
 CAST(c_nationkey % 2 AS INT) AS sex FROM {customer}
"""

# The qualities repeat after 31 letters and 7 * 9 = 1 modulo 31, so those of a read are a slice of one constant array.
QUAL = (
    f"CASE WHEN rid >= 0 THEN slice(array({', '.join(str(7 * k % 31 + 10) for k in range(130))}), CAST(rid % 31 * 9 % 31 AS INT) + 1, 100) "
    "ELSE transform(sequence(0, 99), q -> CAST((rid + q * 7) % 31 + 10 AS INT)) END"
)

DIALECT = {
    "spark": {
        "G": "",
        "QUAL": QUAL,
        "CLASSES": "(SELECT vec_id, label, posexplode(embedding) AS (i, x) FROM {embeddings}) e",
    },
    "duckdb": {
        "G": ", 'g'",
        "QUAL": "list_transform(range(0, 100), lambda q: CAST((rid + q * 7) % 31 + 10 AS INT))",
        "CLASSES": "(SELECT vec_id, label, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM {embeddings}) e",
    },
}


# Spark would spell the genome again for every row that a broadcast join finds on it; behind an exchange it is spelled once.
# Rows that meet the genome are dealt by contig first: an order lies on one contig, so neither its numbering nor the join
# nor what is cut from it is shuffled again.
SPELLED_ONCE = {
    "genome": "SELECT /*+ REPARTITION(16) */ * FROM ({0}) once",
    "homed": """SELECT *, ROW_NUMBER() OVER (PARTITION BY home, l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
 FROM (SELECT /*+ REPARTITION(32, home) */ *, CONCAT('chr', CAST(1 + l_orderkey % (SELECT COUNT(*) FROM {documents}) AS STRING)) AS home FROM {lineitem}) h""",
}


def _needed(sql: str, seen: list[str]) -> None:
    for name in FIXTURES:
        if name not in seen and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
            _needed(FIXTURES[name], seen)
            if name not in seen:
                seen.append(name)


def _plain_bytes(sql: str) -> str:
    """Genome letters are ASCII: Spark finds a place in bytes at once, in characters by walking there from the start."""
    sql = re.sub(r"SUBSTRING\((g?seq), (CAST\(g?pos \+ 1 AS INT\)), (\d+)\)", r"STRING(SUBSTRING(BINARY(\1), \2, \3))", sql)
    return sql.replace("LENGTH(g.seq)", "OCTET_LENGTH(g.seq)")


def _render(sql: str, engine: str, sf_dir: str | None = None) -> str:
    if engine == "spark":
        sql = _plain_bytes(sql)
    for key, text in DIALECT[engine].items():
        sql = sql.replace("{" + key + "}", text)
    for table in TABLES:
        source = table if engine == "duckdb" else f"parquet.`{sf_dir}/{table}.parquet`"
        sql = sql.replace("{" + table + "}", source)
    return sql


def _spelled(name: str, sf_dir: str) -> str:
    """The text of a fixture for Spark."""
    return _render(SPELLED_ONCE.get(name, "{0}").replace("{0}", FIXTURES[name]), "spark", sf_dir)


def with_fixtures(sql: str, extra: dict[str, str] | None = None) -> str:
    """DuckDB text: ``sql`` behind the fixtures (and named extra tables) it mentions."""
    extra = extra or {}
    names: list[str] = []
    used = [e for e in extra]
    for text in [*(extra[e] for e in used), sql]:
        _needed(text, names)
    parts = [f"{n} AS ({_render(FIXTURES[n], 'duckdb')})" for n in names]
    parts += [f"{n} AS ({_render(extra[n], 'duckdb')})" for n in used]
    body = _render(sql, "duckdb")
    return f"WITH {', '.join(parts)} {body}" if parts else body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a fixture as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    names: list[str] = []
    _needed(FIXTURES[name], names)
    parts = [f"{n} AS ({_spelled(n, sf_dir)})" for n in names]
    head = f"WITH {', '.join(parts)} " if parts else ""
    return spark.sql(head + _render(FIXTURES[name], "spark", sf_dir))
