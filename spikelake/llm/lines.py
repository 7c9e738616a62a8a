"""Remove lines that stand on many sites, keeping each such line once.

A line is what stands between two \\n; lines without a word stay. Lines are told apart by two hashes. A
HyperLogLog sketch of the sites of each line, merged by aggregation, tells how widely it is spread; lines
whose estimate is near the threshold get an exact count of distinct sites. A line on `min_sites` sites or
more stays where it is first (smallest id, a null id first; then smallest line number) and goes elsewhere.

A null text stays null; a null site is a site of its own. Repeated rows (same id and text) are cleaned alike,
so a first occurrence stays in each of them. Of places that tie, all stay. Very long texts take time that grows with
their length. An empty table gives an empty table; columns besides the named ones are kept as they are, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, joined

MIN_SITES = 5
#: log2 of the registers of a sketch; estimates within MARGIN of the threshold (6 standard errors), or 1, are counted exactly.
LG_K, MARGIN = 12, 0.1


def _lines(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    rows = docs.select(
        F.xxhash64(doc_id, text).alias("k"),
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("n")).alias("site"),
        F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"),
    )
    rows = rows.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select("k", "doc_id", "site", "pos", F.xxhash64("line").alias("h"), F.hash("line").alias("g"))


def spread(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h, g, first (its first place) and rows of each line on min_sites sites or more."""
    found = lines.groupBy("h", "g").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"),
        F.count(F.lit(1)).alias("rows"),
        F.min(F.struct("doc_id", "pos")).alias("first"),
    )
    found = cut(found.filter(F.col("rows") >= min_sites))  # fewer rows can't be on so many sites
    margin = max(1, MARGIN * min_sites)
    sure = found.filter(F.col("sites") > min_sites + margin)
    near = found.filter(F.abs(F.col("sites") - min_sites) <= margin)
    some = joined(lines.select("h", "g", "site"), near.select("h", "g", "rows", F.lit(True).alias("near")), ["h", "g"], "rows").filter("near")
    exact = some.groupBy("h", "g", "site").agg(F.lit(1).alias("one")).groupBy("h", "g").agg(F.count("one").alias("exact"))
    near = near.join(exact.filter(F.col("exact") >= min_sites), ["h", "g"], "left_semi")
    return sure.unionByName(near).select("h", "g", "first", "rows")


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, chars: str | None = None, counts: tuple[str, str] | None = None) -> DataFrame:
    """docs without the spread lines; `chars` names a column to hold the new length, `counts` two new columns
    for the numbers of lines before and of lines removed."""
    lines = cut(_lines(docs, doc_id, text, site))
    first = F.struct("doc_id", "pos").eqNullSafe(F.col("first"))
    gone = joined(lines.drop("site"), cut(spread(lines, min_sites)), ["h", "g"], "rows").filter(F.col("first").isNotNull() & ~first)
    key, at, old = fresh(docs, "_key", "_gone", "_lines")
    gone = gone.groupBy(F.col("k").alias(key)).agg(F.collect_set("pos").alias(at))
    rows = docs.withColumn(key, F.xxhash64(doc_id, text)).join(gone, key, "left")
    # explode gives the lines once a row, so that they aren't split again for each place.
    split = F.split(text, "\n", -1)
    rows = rows.withColumn(old, F.explode(F.array(F.when(F.col(at).isNotNull(), split))))
    stay = F.array_except(F.sequence(F.lit(0), F.size(old) - 1), F.col(at))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col(old), i)), "\n")
    new = F.when(F.col(at).isNull(), F.col(text)).otherwise(kept)
    out = {text: new}
    if chars:
        out[chars] = F.when(F.col(at).isNull(), F.col(chars)).otherwise(F.char_length(new).cast(dict(docs.dtypes)[chars]))
    if counts:
        out[counts[0]] = F.coalesce(F.size(split), F.lit(0)).cast("long")
        out[counts[1]] = F.coalesce(F.size(at), F.lit(0)).cast("long")
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in dict.fromkeys([*docs.columns, *(counts or ())])])
