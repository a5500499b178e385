"""Merkle manifest of a dataset: every row a leaf, a tree per group, a tree over the groups' roots.

1. A leaf is the digest of a row's fields. Leaves are numbered in order within
   their group by range-partitioned slices, so no group is one task.
2. 512 consecutive leaves are an aligned block. It keeps a level as one string
   of digests, 64 letters each: the parents of a level are the digests of its
   fixed-width substrings of 8 digests, and the siblings of a node are the
   substrings left and right of it.
3. A block's top digest is a leaf of the next round, 512 blocks a block, until
   each group has one block. The groups' roots are the leaves of one last tree.

Everything is DataFrame functions; a group of rows has at most 512 digests.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from fragx.llm.common import stored
from fragx.operators.ordering import row_numbers

WIDTH = 64
ARITY = 8
DEPTH = 3
BLOCK = ARITY**DEPTH
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<left:string,right:string>>"


def digest(column: Column) -> Column:
    return F.sha2(column, 256)


def field(column: Column | str) -> Column:
    """A value as its UTF-8 byte count, a colon and the value; null as a dash."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: list[Column | str]) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings, level by level, lead to."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def _piece(level: Column, first: Column, count: Column) -> Column:
    """``count`` digests of a level from number ``first``, fewer at its end."""
    return F.substr(level, (first * WIDTH + 1).cast("int"), (count * WIDTH).cast("int"))


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(level) - 1) / (ARITY * WIDTH)).cast("int")))
    return F.array_join(F.transform(runs, lambda i: digest(_piece(level, i * ARITY, F.lit(ARITY)))), "")


def _siblings(level: Column, place: Column) -> Column:
    """What stands left and right of a node in its run of eight."""
    run = _piece(level, F.floor(place / ARITY) * ARITY, F.lit(ARITY))
    at = F.pmod(place, F.lit(ARITY))
    return F.struct(_piece(run, F.lit(0), at).alias("left"), _piece(run, at + 1, F.lit(ARITY)).alias("right"))


def climb(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, pos from 0, digest, carried) with path and root: their siblings up to the root of their tree.

    A tree of one node is its own root, with an empty path.
    """
    sizes = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("size"))
    member = F.struct("pos", "digest", "carried")
    blocks = nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(member)).alias("members"))
    size = F.col("size")
    depth = F.when(size <= 1, 0).when(size <= ARITY, 1).when(size <= ARITY**2, 2).otherwise(DEPTH)
    blocks = blocks.join(sizes, "tree").withColumn("depth", depth)
    blocks = blocks.withColumn("level0", F.array_join(F.transform("members", lambda m: m["digest"]), ""))
    for k in range(1, DEPTH + 1):
        below = F.col(f"level{k - 1}")
        blocks = blocks.withColumn(f"level{k}", F.when(F.col("depth") >= k, _parents(below)).otherwise(below))
    blocks = stored(blocks)
    tops = blocks.filter(size > BLOCK).select("tree", F.col("block").alias("pos"), F.col(f"level{DEPTH}").alias("digest"), F.lit(None).cast("string").alias("carried"))
    if tops.isEmpty():
        above = blocks.withColumn("above", F.array().cast(PATH)).withColumn("root", F.col(f"level{DEPTH}"))
    else:
        upper = climb(tops).select("tree", F.col("pos").alias("block"), F.col("path").alias("above"), "root")
        above = blocks.join(upper, ["tree", "block"], "left").withColumn("above", F.coalesce("above", F.array().cast(PATH)))
        above = above.withColumn("root", F.coalesce("root", f"level{DEPTH}"))
    rows = above.select("tree", "root", "above", "depth", *[f"level{k}" for k in range(DEPTH)], F.posexplode("members").alias("place", "m"))
    own = F.array(*[_siblings(F.col(f"level{k}"), F.floor(F.col("place") / ARITY**k)) for k in range(DEPTH)])
    path = F.concat(F.slice(own, F.lit(1), F.col("depth")), "above")
    return rows.select("tree", F.col("m.pos").alias("pos"), F.col("m.digest").alias("digest"), F.col("m.carried").alias("carried"), path.alias("path"), "root")


def manifest(leaves: DataFrame) -> DataFrame:
    """The manifest of leaves (id long, group string, leaf string, carried string).

    One row per leaf: id, group, position in the group (from 0), leaf, carried,
    subroot (of the group), root, and path, the siblings level by level up to
    the root. Leaves of a group ascend by id, a null id first, equal ids by
    leaf; groups ascend bytewise, null first, and null is a group of its own.
    An empty table gives no rows.
    """
    tree = F.when(F.col("group").isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), "group"))
    # ":" sorts after "-", so the null group stays first
    keyed = stored(leaves.select(tree.alias("tree"), "id", "leaf", "carried"))
    order = [F.col("id").asc_nulls_first(), F.col("leaf"), F.col("carried")]
    ranked = row_numbers(keyed, order, ["tree"], "pos")
    held = F.struct("id", F.col("carried").alias("other"))
    nodes = ranked.select("tree", (F.col("pos") - 1).alias("pos"), F.col("leaf").alias("digest"), held.alias("carried"))
    low = climb(nodes)
    subroots = low.filter(F.col("pos") == 0).select(F.col("tree").alias("name"), F.col("root").alias("digest"), F.lit("").alias("tree"))
    high = row_numbers(stored(subroots), [F.col("name")], ["tree"], "pos").select("tree", (F.col("pos") - 1).alias("pos"), "digest", F.col("name").alias("carried"))
    high = stored(climb(high).select(F.col("carried").alias("tree"), F.col("path").alias("above"), F.col("root").alias("top")))
    group = F.when(F.col("tree") != "-", F.substr(F.col("tree"), F.lit(2)))
    return low.join(high, "tree").select(
        F.col("carried.id").alias("id"), group.alias("group"), F.col("pos").alias("position"), F.col("digest").alias("leaf"),
        F.col("carried.other").alias("carried"), F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("path", "above").alias("path"),
    )


def proofs(docs: DataFrame) -> DataFrame:
    """The manifest of documents, with each row's proof checked against its text.

    Where 3 divides the CRC-32 of the decimal doc_id, the text is read back with
    A-Z lower-cased; the root folded from such a leaf differs unless the text
    has none of these letters. Nulls are the field "-"; a null doc_id is never
    tampered with. Equal rows are leaves of their own beside each other. A very
    long text costs one digest of it (two if tampered). Further columns are
    ignored; an empty table gives no rows.
    """
    base = docs.select(*[F.col(c).cast(t).alias(c) for c, t in zip(FIELDS, ("long", "string", "string", "long", "string"))])
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    changed = F.when(tampered & F.col("text").isNotNull(), leaf_digest([*FIELDS[:-1], lowered]))
    leaves = base.select(F.col("doc_id").alias("id"), F.col("lang").alias("group"), leaf_digest(FIELDS).alias("leaf"), changed.alias("carried"))
    folded = fold(F.coalesce("carried", "leaf"), F.col("path"))
    proof = digest(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""))
    rows = manifest(leaves).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
