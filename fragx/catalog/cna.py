"""Copy number on the reads of all samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragx.catalog.bins import COUNTS, dense
from fragx.catalog.registry import register
from fragx.fixtures import table
from fragx.functions.common import round6
from fragx.operators import cna as C
from fragx.operators.ordering import genome_order
from fragx.plans.copy_number import copy_number as copy_number_plan
from fragx.session import materialize

TRACK = """CAST(((start // 1000000) * 37) % 60 + 20 AS DOUBLE) / 100 - CASE WHEN (start // 1000000) % 11 = 0 THEN 1 ELSE 0 END AS gc_raw,
  CAST(((start // 1000000) * 53) % 100 AS DOUBLE) / 100 AS map"""

CNA = {
    **COUNTS,
    "armed": """SELECT d.*, CONCAT(d.contig, CASE WHEN d."end" <= p_end THEN 'p' WHEN d.start >= q_start THEN 'q' END) AS arm_any,
      CASE WHEN d."end" <= p_end THEN CONCAT(d.contig, 'p') WHEN d.start >= q_start THEN CONCAT(d.contig, 'q') END AS arm FROM dense d JOIN contigs c ON c.contig = d.contig""",
    "tracked": f"SELECT *, GREATEST(gc_raw, 0.0) AS gc FROM (SELECT *, {TRACK} FROM armed) t",
    "flagged": "SELECT *, reads > 0 AND gc >= 0 AS valid, reads > 0 AND gc >= 0 AND map >= 0.5 AS ideal FROM tracked",
    "arms": "SELECT sample_id, arm, CAST(SUM(CASE WHEN reads > 0 THEN reads ELSE 0 END) AS DOUBLE) AS total FROM flagged WHERE arm IS NOT NULL GROUP BY sample_id, arm",
    "shares": """SELECT sample_id, 'arm' AS level, arm AS key, COALESCE(total / NULLIF(SUM(total) OVER (PARTITION BY sample_id), 0), 0) * 100 + 1e-10 AS share FROM arms
      UNION ALL SELECT sample_id, 'bin', CONCAT(contig, ':', start, '-', "end"), COALESCE(reads / NULLIF(SUM(reads) OVER (PARTITION BY sample_id), 0), 0) * 100 + 1e-10 FROM flagged WHERE ideal""",
    "grid": "SELECT s.sample_id, k.level, k.key FROM (SELECT DISTINCT sample_id FROM shares) s, (SELECT DISTINCT level, key FROM shares) k",
    "filled": "SELECT g.*, COALESCE(s.share, 1e-10) AS share FROM grid g LEFT JOIN shares s USING (sample_id, level, key)",
    "panel": "SELECT level, key, AVG(share) AS mean, STDDEV_SAMP(share) AS std FROM filled GROUP BY level, key",
    "z": "SELECT g.sample_id, g.level, g.key, (s.share - p.mean) / NULLIF(p.std, 0) AS z FROM grid g JOIN panel p USING (level, key) LEFT JOIN shares s USING (sample_id, level, key)",
}


def lowess_tables(frac: float = 0.5, passes: int = 3) -> dict[str, str]:
    """The robust local regression of reads on GC as SQL: counts and moments per distinct GC, one set of tables per pass."""
    tables = {
        "fit_rows": "SELECT sample_id, contig, start, CAST(reads AS DOUBLE) AS y, gc AS x FROM flagged WHERE ideal",
        "fit_xs": "SELECT sample_id, x, COUNT(*) AS c FROM fit_rows GROUP BY sample_id, x",
        "fit_k": f"SELECT sample_id, GREATEST(CAST(floor({frac} * COUNT(*) + 1e-10) AS BIGINT), 1) AS k FROM fit_rows GROUP BY sample_id",
        "fit_near": """SELECT a.sample_id, a.x, b.x AS bx, abs(b.x - a.x) AS d, SUM(b.c) OVER (PARTITION BY a.sample_id, a.x ORDER BY abs(b.x - a.x)) AS upto
          FROM fit_xs a JOIN fit_xs b ON a.sample_id = b.sample_id""",
        "fit_radius": "SELECT n.sample_id, n.x, MIN(n.d) AS h FROM fit_near n JOIN fit_k k ON k.sample_id = n.sample_id WHERE n.upto >= k.k GROUP BY n.sample_id, n.x",
        "fit_tri": """SELECT n.sample_id, n.x, n.bx, CASE WHEN h > 0 AND d / h < 1 THEN pow(1 - pow(d / h, 3), 3) WHEN h > 0 THEN 0.0 WHEN d = 0 THEN 1.0 ELSE 0.0 END AS tri
          FROM fit_near n JOIN fit_radius r ON r.sample_id = n.sample_id AND r.x = n.x""",
        "fit_w0": "SELECT *, CAST(1 AS DOUBLE) AS robust FROM fit_rows",
    }
    for i in range(passes + 1):
        tables |= {
            f"fit_m{i}": f"SELECT sample_id, x, SUM(robust) AS mass, SUM(robust * y) AS moment, AVG(y) AS plain FROM fit_w{i} GROUP BY sample_id, x",
            f"fit_c{i}": f"""SELECT t.sample_id, t.x, SUM(tri * mass) AS total, SUM(tri * mass * bx) / NULLIF(SUM(tri * mass), 0) AS center, SUM(tri * moment) / NULLIF(SUM(tri * mass), 0) AS mean_y
              FROM fit_tri t JOIN fit_m{i} m ON m.sample_id = t.sample_id AND m.x = t.bx GROUP BY t.sample_id, t.x""",
            f"fit_s{i}": f"""SELECT c.sample_id, c.x, c.total, c.center, c.mean_y, SUM(tri * mass * pow(bx - center, 2)) / NULLIF(c.total, 0) AS spread, SUM(tri * moment * (bx - center)) / NULLIF(c.total, 0) AS cov
              FROM fit_c{i} c JOIN fit_tri t ON t.sample_id = c.sample_id AND t.x = c.x JOIN fit_m{i} m ON m.sample_id = t.sample_id AND m.x = t.bx GROUP BY c.sample_id, c.x, c.total, c.center, c.mean_y""",
            f"fit_l{i}": f"""SELECT s.sample_id, s.x, CASE WHEN total > 0 AND spread < 1e-12 THEN mean_y WHEN total > 0 THEN mean_y + cov / spread * (s.x - center) WHEN mass > 0 THEN moment / mass ELSE plain END AS fit
              FROM fit_s{i} s JOIN fit_m{i} m ON m.sample_id = s.sample_id AND m.x = s.x""",
            f"fit_r{i}": f"SELECT w.sample_id, w.contig, w.start, w.y, w.x, l.fit, abs(w.y - l.fit) AS off FROM fit_w{i} w JOIN fit_l{i} l ON l.sample_id = w.sample_id AND l.x = w.x",
            f"fit_w{i + 1}": f"""SELECT r.sample_id, contig, start, y, x, CASE WHEN scale > 0 AND off / scale < 1 THEN pow(1 - pow(off / scale, 2), 2) WHEN scale > 0 OR off > 0 THEN 0.0 ELSE 1.0 END AS robust
              FROM fit_r{i} r JOIN (SELECT sample_id, 6.0 * MEDIAN(off) AS scale FROM fit_r{i} GROUP BY sample_id) q ON q.sample_id = r.sample_id""",
        }
    del tables[f"fit_w{passes + 1}"]
    tables["corrected_bins"] = f"""SELECT f.*, c.corrected FROM flagged f LEFT JOIN
      (SELECT sample_id, contig, start, y / (fit / MEDIAN(fit) OVER (PARTITION BY sample_id)) AS corrected FROM fit_r{passes}) c
      ON f.ideal AND c.sample_id = f.sample_id AND c.contig = f.contig AND c.start = f.start"""
    return tables


UNTIL_FLAGS = {name: CNA[name] for name in (*COUNTS, "armed", "tracked", "flagged")}
CORRECTED = {**UNTIL_FLAGS, **lowess_tables()}
CORRECTED_SCORES = {
    **CORRECTED,
    "arms": "SELECT sample_id, arm, CAST(SUM(CASE WHEN corrected > 0 THEN corrected ELSE 0 END) AS DOUBLE) AS total FROM corrected_bins WHERE arm IS NOT NULL GROUP BY sample_id, arm",
    "shares": CNA["shares"].replace("reads", "corrected").replace("flagged", "corrected_bins"),
    **{name: CNA[name] for name in ("grid", "filled", "panel", "z")},
}


def tracks(bins):
    window = F.floor(F.col("start") / 1_000_000)
    places = bins.select("contig", "start").distinct()
    gc = ((window * 37) % 60 + 20).cast("double") / 100 - F.when(window % 11 == 0, 1).otherwise(0)
    return (
        places.withColumn("gc", gc.cast("double")),
        places.withColumn("map", (((window * 53) % 100).cast("double") / 100)),
    )


def flagged(spark, sf_dir):
    armed = C.assign_arm(dense(spark, sf_dir), table(spark, sf_dir, "contigs"))
    gc, mappability = tracks(armed)
    return C.bin_flags(C.attach_tracks(armed, gc, mappability, ["contig", "start"]), 0.5)


def shares(spark, sf_dir):
    bins = flagged(spark, sf_dir)
    arms = C.arm_totals(bins, ["sample_id"], "reads")
    by_arm = C.percent_of_total(arms, ["sample_id"], "total").select(
        "sample_id", F.lit("arm").alias("level"), F.col("arm").alias("key"), "share"
    )
    label = F.concat("contig", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    by_bin = C.percent_of_total(bins.filter("ideal"), ["sample_id"], "reads").select(
        "sample_id", F.lit("bin").alias("level"), label.alias("key"), "share"
    )
    return by_arm.unionByName(by_bin)


@register("assign_arm", 'SELECT sample_id, contig, start, "end", reads, arm FROM armed', CNA)
def assign_arm(spark, sf_dir):
    return C.assign_arm(dense(spark, sf_dir), table(spark, sf_dir, "contigs"))


@register(
    "attach_tracks",
    "SELECT sample_id, contig, start, reads, ROUND(gc, 6) + 0.0 AS gc, ROUND(map, 6) + 0.0 AS map, valid, ideal FROM flagged",
    CNA,
)
def attach_tracks(spark, sf_dir):
    return flagged(spark, sf_dir).select(
        "sample_id", "contig", "start", "reads", round6("gc").alias("gc"), round6("map").alias("map"), "valid", "ideal"
    )


@register("bin_flags", "SELECT valid, ideal, COUNT(*) AS n, CAST(SUM(reads) AS BIGINT) AS reads FROM flagged GROUP BY valid, ideal", CNA)
def bin_flags(spark, sf_dir):
    return flagged(spark, sf_dir).groupBy("valid", "ideal").agg(F.count(F.lit(1)).alias("n"), F.sum("reads").alias("reads"))


@register("arm_totals", "SELECT sample_id, arm, total FROM arms", CNA)
def arm_totals(spark, sf_dir):
    return C.arm_totals(flagged(spark, sf_dir), ["sample_id"], "reads")


@register("percent_of_total", "SELECT sample_id, level, key, ROUND(share, 6) + 0.0 AS share FROM shares", CNA)
def percent_of_total(spark, sf_dir):
    return shares(spark, sf_dir).select("sample_id", "level", "key", round6("share").alias("share"))


@register("build_panel", "SELECT level, key, ROUND(mean, 6) + 0.0 AS mean, ROUND(std, 6) + 0.0 AS std FROM panel", CNA)
def build_panel(spark, sf_dir):
    p = C.build_panel(materialize(shares(spark, sf_dir)), "sample_id", ["level", "key"])
    return p.select("level", "key", round6("mean").alias("mean"), round6("std").alias("std"))


def scored(spark, sf_dir):
    s = materialize(shares(spark, sf_dir))
    return C.zscore_vs_panel(s, C.build_panel(s, "sample_id", ["level", "key"]), "sample_id", ["level", "key"])


@register("zscore_vs_panel", "SELECT sample_id, level, key, ROUND(z, 5) + 0.0 AS z FROM z", CNA)
def zscore_vs_panel(spark, sf_dir):
    return scored(spark, sf_dir).select("sample_id", "level", "key", (F.round("z", 5) + F.lit(0.0)).alias("z"))


@register(
    "cna_summary",
    """SELECT sample_id, arm, ROUND(AVG(z), 5) + 0.0 AS mean_z, CASE WHEN AVG(z) > 0.3 THEN 'gain' WHEN AVG(z) < -0.3 THEN 'loss' ELSE 'neutral' END AS call
      FROM z JOIN (SELECT DISTINCT CONCAT(contig, ':', start, '-', "end") AS key, arm FROM armed WHERE arm IS NOT NULL) a ON a.key = z.key WHERE level = 'bin' GROUP BY sample_id, arm""",
    CNA,
)
def cna_summary(spark, sf_dir):
    armed = C.assign_arm(dense(spark, sf_dir), table(spark, sf_dir, "contigs")).filter(F.col("arm").isNotNull())
    label = F.concat("contig", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    arms = armed.select(label.alias("key"), "arm").distinct()
    z = scored(spark, sf_dir).filter("level = 'bin'").join(arms, "key")
    out = C.cna_summary(z, ["sample_id"], threshold=0.3)
    return out.select("sample_id", "arm", (F.round("mean_z", 5) + F.lit(0.0)).alias("mean_z"), "call")


@register(
    "median_normalize",
    "SELECT sample_id, contig, start, ROUND(reads / NULLIF(MEDIAN(reads) OVER (PARTITION BY sample_id), 0), 6) + 0.0 AS ratio FROM flagged WHERE ideal",
    CNA,
)
def median_normalize(spark, sf_dir):
    m = C.median_normalize(flagged(spark, sf_dir).filter("ideal"), ["sample_id"], "reads")
    return m.select("sample_id", "contig", "start", round6("ratio").alias("ratio"))


@register("gc_correct", "SELECT sample_id, contig, start, reads, ideal, ROUND(corrected, 6) + 0.0 AS corrected FROM corrected_bins", CORRECTED)
def gc_correct(spark, sf_dir):
    out = C.gc_correct(flagged(spark, sf_dir))
    return out.select("sample_id", "contig", "start", "reads", "ideal", round6("corrected").alias("corrected"))


@register("copy_number", "SELECT sample_id, level, key, ROUND(z, 5) + 0.0 AS z FROM z", CORRECTED_SCORES)
def copy_number(spark, sf_dir):
    bins = materialize(dense(spark, sf_dir))
    gc, mappability = tracks(bins)
    arms = table(spark, sf_dir, "contigs")
    z = copy_number_plan(bins, arms, gc, mappability, mappability_threshold=0.5)
    return z.select("sample_id", "level", "key", (F.round("z", 5) + F.lit(0.0)).alias("z"))
