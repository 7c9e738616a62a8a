"""Mix sources to target weights on a low-discrepancy schedule, with DataFrame operations alone.

The words of a source form a stream: its rows in the order of md5(doc_id), cut into blocks of equal size of
which the last may be shorter. The mix is a schedule of slots, a block each. Slot i takes the golden-ratio point
i * GOLDEN modulo 2 ** 32, which the cumulative shares of the sources in all slots map to a source; the r-th slot of
a source takes block r modulo its number of blocks. A source gives what its slots take, which is within a few blocks of
its target, for any run of golden-ratio points falls evenly; no block is taken more than `most` times. A block has
MAX_BLOCK words, or the LEAST_SLOTS-th part of all words if that is less, so that a few blocks are little of a mix of
any size. All arithmetic of the schedule is in whole numbers, or in doubles whose order of operations is fixed.

A null text has no words. Sources are ordered by code point, null last. Rows without words take nothing.
Repeated rows are mixed each by itself, in an order that their columns alone fix; so are ids that tie in their md5. A
very long text lies in many blocks. An empty table gives an empty table. Only the named columns are read by `mixture`;
`mixed` keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh

MAX_BLOCK, LEAST_SLOTS, WEIGHTS, MOST = 1024, 1 << 16, (1, 2, 3), 3
#: Parts of a source's order, of the unit interval and of the schedule, so that no window or join has a hot key.
PARTS, CELLS, CHUNK = 4096, 4096, 8192
#: Sources whose parts of the unit interval are broadcast: at most CELLS rows and two for each.
FEW = 10_000
#: The odd number next to 2 ** 32 divided by the golden ratio.
GOLDEN, UNIT = 2_654_435_769, 1 << 32


def _sizes(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """A row for each document: k, the source as a key that is never null; th, of the text; copy, of equal rows."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")).alias("k"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text).alias("th"),
    )
    equal = Window.partitionBy("doc_id", "k", "size", "th").orderBy(F.lit(0))
    return rows.withColumn("copy", F.row_number().over(equal))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """k, source_size and target of each source.

    The targets are min(most * size, level * weight) for the level at which they sum to all sizes: sources in
    the order of cap / weight are at their cap until the level that the rest would have lies below.
    """
    sources = sizes.groupBy("k", "source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    sources = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "k").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    sources = sources.withColumn("level", level)
    # The first level that holds is the highest that does, for what is assumed to be at its cap beyond lowers it.
    sources = sources.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(whole))
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return sources.select("k", "source_size", target.alias("target"))


def _layout(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows with their targets and the place where each starts in its source's stream."""
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = sizes.withColumn("order", order).withColumn("part", F.conv(F.substring("order", 1, 3), 16, 10).cast("int"))
    inside = Window.partitionBy("k", "part").orderBy("order", "doc_id", "size", "th", "copy").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    parts = sizes.withColumn("order", order).groupBy("k", F.conv(F.substring("order", 1, 3), 16, 10).cast("int").alias("part")).agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("k", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    rows = rows.join(parts, ["k", "part"]).join(sources, "k")
    return rows.select("doc_id", "k", "size", "th", "copy", "source_size", "target", (F.col("offset") + F.col("inside")).alias("start"))


def _point(slot: Column) -> Column:
    """slot * GOLDEN modulo UNIT, in two halves that don't overflow."""
    half = 1 << 16
    high = (F.floor(slot / half) % half * GOLDEN) % UNIT
    return (high * half + slot % half * GOLDEN) % UNIT


def _found(points: DataFrame, cells: DataFrame, few: bool, each: int) -> DataFrame:
    """The points with k and blocks of the source in whose part of the unit interval they lie.

    Of few sources the parts, a row for each cell and some for each source, are broadcast. Else points and the places where
    parts begin are put in order within each cell, and a point takes the last part that has begun: however many sources
    share a cell, nothing is paired.
    """
    if few:
        return points.join(F.broadcast(cells), "cell").filter("u >= lo AND u < hi")
    begins = cells.select("cell", F.greatest(F.col("lo"), F.col("cell") * F.lit(float(each))).alias("u"), F.lit(None).cast("long").alias("id"), F.struct("k", "blocks", "hi").alias("part"))
    rows = points.select("cell", F.col("u").cast("double").alias("u"), "id", F.lit(None).cast(begins.schema["part"].dataType).alias("part")).unionByName(begins)
    so_far = Window.partitionBy("cell").orderBy("u", F.col("id").isNotNull(), "part").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("part", F.last("part", ignorenulls=True).over(so_far)).filter("id IS NOT NULL AND u < part.hi")
    return rows.select("id", "u", "cell", "part.k", "part.blocks")


def schedule(sources: DataFrame, block: int, most: int = MOST, few: int = FEW) -> DataFrame:
    """slot, k, r (the source's how manieth slot it is) and block: all slots of the mix that a source may take.

    sources: k, source_size and target. need: the slots that take a source's target, in blocks; places: of all. Of more than
    `few` sources nothing is broadcast.
    """
    sources = sources.filter("source_size > 0").withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    sources = sources.withColumn("need", F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)).filter("need > 0")
    places = F.sum("need").over(Window.partitionBy())
    upto = F.sum("need").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) / places
    cells = sources.withColumn("hi", upto * F.lit(float(UNIT))).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("k")), F.lit(0.0)))
    each = UNIT // CELLS
    cells = cells.select("k", "blocks", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / each), F.least(F.floor(F.col("hi") / each), F.lit(CELLS - 1)))).alias("cell"))
    points = sources.sparkSession.range(sources.agg(F.sum("need")).first()[0] or 0).withColumn("u", _point(F.col("id")))
    points = _found(points.withColumn("cell", F.floor(F.col("u") / each)), cells, sources.count() <= few, each)
    points = points.select("id", "k", "blocks", F.expr(f"id div {CHUNK}").alias("chunk"))
    counts = points.groupBy("k", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("k", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("k", "chunk").orderBy("id")) - 1
    ranked = points.withColumn("rank", rank).join(counts, ["k", "chunk"]).withColumn("r", F.col("rank") + F.col("offset"))
    return ranked.filter(F.col("r") < most * F.col("blocks")).select(F.col("id").alias("slot"), "k", "r", (F.col("r") % F.col("blocks")).alias("block"))


def block_words(sources: DataFrame) -> int:
    """The words of a block: MAX_BLOCK, or the LEAST_SLOTS-th part of all if that is less."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    return max(1, min(MAX_BLOCK, total // LEAST_SLOTS))


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int | None = None, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Each row's doc_id, k, size, th, copy, source_size, target, taken (words that the mix takes) and slots: those that
    take its first word, in order; empty if none does."""
    sizes = cut(_sizes(docs, doc_id, text, source))
    sources = cut(targets(sizes, weights, most))
    block = block or block_words(sources)
    layout = cut(_layout(sizes, sources))
    pieces = layout.filter("size > 0").select("k", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)
    pieces = pieces.withColumns({"n": words, "first": F.col("start") >= F.col("block") * block})
    played = pieces.join(schedule(sources, block, most), ["k", "block"])
    slots = F.array_sort(F.collect_list(F.when(F.col("first"), F.col("slot"))))  # at most `most`
    taken = played.groupBy("k", "start").agg(F.sum("n").alias("taken"), slots.alias("slots")).withColumn("has", F.lit(True))
    rows = layout.withColumn("has", F.col("size") > 0).join(taken, ["k", "start", "has"], "left")
    slots = F.coalesce("slots", F.array().cast("array<bigint>"))
    return rows.select("doc_id", "k", "size", "th", "copy", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), slots.alias("slots"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", chars: str | None = None, slot: str | None = None, **options) -> DataFrame:
    """The mix itself, with the columns of docs: each text as often as it is taken whole, and the first words
    of a text that is taken in part; `chars` names a column to hold the length of the text, `slot` a new column for the
    place in the schedule at which the text begins: sorted by it, the table is the mix in its order."""
    helpers = fresh(docs, "_id", "_k", "_size", "_th", "_copy", "_taken", "_slots", "_out")
    key, (taken, slots, out) = helpers[:5], helpers[5:]
    plan = mixture(docs, doc_id, text, source, **options).filter("taken > 0")
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    plan = plan.select(own.alias(key[0]), *[F.col(c).alias(k) for c, k in zip(("k", "size", "th", "copy", "taken", "slots"), (*key[1:], taken, slots))])
    rows = docs.withColumns(
        {
            key[0]: F.coalesce(F.col(doc_id).cast("string"), F.lit("")),
            key[1]: F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")),
            key[2]: F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"),
            key[3]: F.xxhash64(text),
        }
    )
    # Rows that agree in id, source, size and text are told apart by all their columns; what still ties is the same row.
    whole_row = F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else F.col(c) for c, kind in docs.dtypes])
    rows = rows.withColumn(key[4], F.row_number().over(Window.partitionBy(*key[:4]).orderBy(whole_row))).join(plan, key)
    whole, rest = F.expr(f"`{taken}` div `{key[2]}`").cast("int"), (F.col(taken) % F.col(key[2])).cast("int")
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, rest), " ")
    texts = F.concat(F.array_repeat(F.col(text), whole), F.when(rest > 0, F.array(head)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn(out, F.explode(F.arrays_zip(texts.alias("text"), F.slice(slots, 1, whole + F.when(rest > 0, 1).otherwise(0)).alias("slot"))))
    kinds = dict(docs.dtypes)
    new = {text: F.col(f"{out}.text")} | ({chars: F.char_length(F.col(f"{out}.text")).cast(kinds[chars])} if chars else {}) | ({slot: F.col(f"{out}.slot")} if slot else {})
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in dict.fromkeys([*docs.columns, *([slot] if slot else [])])])
