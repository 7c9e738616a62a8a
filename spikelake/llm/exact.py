"""Exact duplicates by deterministic block naming, with DataFrame operations alone.

A text is cut into blocks of a fixed size. Equal blocks get one integer name: the distinct blocks are sorted by a
64-bit hash within hash partitions and numbered, so names are free of collisions and a recomputed task gives the
same ones. While they are made, the least and the greatest block of each hash are compared; should they differ, the
blocks of that hash get names of their own by content. So texts are shuffled once, combined in each task before;
places of blocks take their names by the hash alone. Adjacent names are then named pairwise until one name is
left; with the number of blocks it is the text's identity.

A null text counts as empty, and empty texts are equal. Very long texts are many blocks, in as many rows. The row with
the largest id stays; a null id is the smallest. Rows that agree in id and text are copies of which one is kept. An
empty table gives an empty table. Only the two named columns are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, joined, lower_ascii, tables

BLOCK = 4096
#: Beside the last of an odd number of names; no name is so small.
NONE = -(1 << 62)


def _names(counted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows, one for each distinct value of the keys, with an integer name that holds once they are written."""
    return counted.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _hash(part: Column) -> Column:
    return F.xxhash64(part)


def _named(blocks: DataFrame, keep, hashed=_hash) -> DataFrame:
    """doc_id, sha, n, pos and name of each block, from its row with the text in part."""
    blocks = blocks.withColumn("h", hashed(F.col("part")))
    alike = blocks.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("part").alias("least"), F.max("part").alias("most"))
    names = keep(_names(alike.select("h", "c", (F.col("least") != F.col("most")).alias("clash")), ["h"]))
    places = blocks.select("doc_id", "sha", "n", "pos", "h")
    clashes = names.filter("clash").select("h")
    if clashes.isEmpty():
        return joined(places, names.select("h", "c", "name"), ["h"], "c").drop("h")
    lone = joined(places, names.filter("NOT clash").select("h", "c", "name"), ["h"], "c").filter("name IS NOT NULL").drop("h")
    some = blocks.join(clashes, "h", "left_semi")
    own = keep(_names(some.groupBy("h", "part").agg(F.count(F.lit(1)).alias("c")), ["h", "part"])).withColumn("name", -1 - F.col("name"))
    return lone.unionByName(joined(some, own, ["h", "part"], "c").select("doc_id", "sha", "n", "pos", "name"))


def identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, hashed=_hash) -> DataFrame:
    """doc_id, sha, n (blocks), name and m (equal rows) per row; (n, name) is equal for equal texts only."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), lower_ascii(F.coalesce(F.col(text), F.lit(""))).alias("norm"))
    parts = F.when(F.char_length("norm") <= block, F.array("norm")).otherwise(F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    rows = rows.select("doc_id", F.sha2("norm", 256).alias("sha"), parts.alias("parts"))
    blocks = rows.select("doc_id", "sha", F.size("parts").alias("n"), F.posexplode("parts").alias("pos", "part"))
    with tables(docs.sparkSession) as keep:
        named = keep(_named(blocks, keep, hashed))
        done = named.filter("n = 1").select("doc_id", "sha", "n", "name", F.lit(1).cast("long").alias("m"))
        open_ = named.filter("n > 1").withColumns({"m": F.lit(1).cast("long"), "width": F.col("n")})
        most = named.agg(F.max("n")).first()[0] or 1
        while most > 1:
            even = F.col("pos") % 2 == 0
            pairs = open_.groupBy("doc_id", "sha", "n", "width", F.expr("pos div 2").cast("int").alias("pos")).agg(
                F.max(F.when(even, F.col("name"))).alias("l"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(NONE)).alias("r"),
                F.sum(F.when(even, F.col("m"))).alias("m"),
            )
            pairs = keep(pairs.select("doc_id", "sha", "n", "pos", "l", "r", "m", F.expr("(width + 1) div 2").cast("int").alias("width")))
            names = keep(_names(pairs.groupBy("l", "r").agg(F.count(F.lit(1)).alias("c")), ["l", "r"]))
            open_ = keep(joined(pairs, names, ["l", "r"], "c").drop("l", "r"))
            done = done.unionByName(open_.filter("width = 1").select("doc_id", "sha", "n", "name", "m"))
            open_ = open_.filter("width > 1")
            most = (most + 1) // 2
        return cut(done)


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, hashed=_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row."""
    named = cut(identities(docs, doc_id, text, block, hashed).groupBy("doc_id", "sha", "n", "name").agg(F.sum("m").alias("m")))
    groups = cut(named.groupBy("n", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("m").alias("group_size"), F.count(F.lit(1)).alias("c")))
    rows = joined(named, groups, ["n", "name"], "c").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))
