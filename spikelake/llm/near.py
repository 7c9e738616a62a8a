"""Near duplicates: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

Words are runs of other characters than ASCII white space, A-Z lower-cased. A text's set are its distinct
runs of `width` words, or the whole sequence if it has fewer; a text without words, or null, has an empty
set and is linked with nothing. Two rows are linked if 100 * |intersection| >= `percent` * |union|.

Equal sets are one node from the start, so copies are never paired. Nodes that share a band are candidates.
Instead of all pairs of a bucket, each member is verified with one leader; components are formed, and only
members that are still apart from their bucket's other members are compared further, so a large group of
near copies costs a few comparisons for each member. What remains is bounded exactly: two texts can't share more
shingles than each shares with any text at all.

Very long texts are hashed in parts of ELEMENTS and verified whole. Repeated rows are one node. A null id is never a component's id, unless all its ids are null. Ties between
leaders go to the smallest hash. An empty table gives an empty table. Only the two named columns are read; `deduplicated` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, hash_words, in_small_batches, joined, mix, slices, tables, windows

WIDTH, PERCENT = 5, 75
#: With 40 bands of 5 rows a link at exactly 0.75 is missed once in 50,000, one at 0.8 once in 8 million.
ROWS, BANDS = 5, 40
#: Elements whose permutations are held at a time.
ELEMENTS = 100_000
#: Rows of a partition of small tables.
PACKED = 200_000
RANK = np.uint64(48)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The sorted 64-bit hashes of a text's set."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(hash_words(words), min(width, len(words))))


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash of each set, as integers: the rank of the minimum above 48 random bits.

    Step j gives each element the j-th place of its own permutation of the m registers, and a random number
    that goes there with rank j. All elements take a step together; a set whose registers all hold smaller
    ranks than the next step's is done and takes no further ones.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    element, owner = np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(len(sets)), sizes)
    permuted = None
    for j in range(m):
        if not len(element):
            break
        random = mix(element + np.uint64(j * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        at = j + (mix(random) % np.uint64(m - j)).astype(np.int64)
        if j:
            row = np.arange(len(element))
            place = permuted[row, at].astype(np.int64)
            permuted[row, at] = permuted[row, j]
        else:
            place = at
        np.minimum.at(flat, owner * m + place, (random >> (np.uint64(64) - RANK)) | (np.uint64(j) << RANK))
        active = out.max(axis=1) >= (np.uint64(j + 1) << RANK)
        on = active[owner]
        if not j and on.any():
            permuted = np.tile(np.arange(m, dtype=np.uint16 if m > 256 else np.uint8), (int(on.sum()), 1))
            permuted[np.arange(len(permuted)), at[on]] = 0
        elif not on.all():
            permuted = permuted[on] if j else None
        element, owner = element[on], owner[on]
    return out


def bands(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band, which holds the band's number."""
    n, m = signatures.shape
    key = np.tile(mix(np.arange(m // rows, dtype=np.uint64)), (n, 1))
    for k in range(rows):
        key = mix(key ^ signatures[:, k::rows][:, : m // rows])
    return key


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, rows: int = ROWS, n_bands: int = BANDS) -> DataFrame:
    """doc_id, th (a hash of the text), n (set size), node (a hash of the set; null if empty) and bands."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, th long, n long, node long, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(x or "", width) for x in batch.column("text").to_pylist()]
            keys, group, size = [], [], 0
            for s in [*sets, None]:
                if group and (s is None or size + len(s) > ELEMENTS):
                    keys.append(bands(superminhash(group, rows * n_bands), rows))
                    group, size = [], 0
                if s is not None:
                    group.append(s)
                    size += len(s)
            keys = np.concatenate(keys).view(np.int64)
            full = np.array([len(s) > 0 for s in sets])
            node = np.array([int(mix(mix(s)).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * n_bands)]).astype(np.int32)), pa.array(keys[full].reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, mask=~full), lists],
                names=["doc_id", "th", "n", "node", "bands"],
            )

    return in_small_batches(docs).mapInArrow(run, schema)


def forest(edges: DataFrame) -> DataFrame:
    """Union-find within each partition: its edges (a, b) as (node, smallest node of its tree)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
            if len(up) > 1_000_000:  # what is known so far goes out; a new forest begins
                yield _trees(up, root)
                up.clear()
        yield _trees(up, root)

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _trees(up: dict[int, int], root) -> pa.RecordBatch:
    pairs = [(x, y) for x in list(up) if (y := root(x)) != x]
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the smallest node of its component, of each node of the edges (a, b).

    Union-find in each partition, then large-star and small-star rounds until nothing changes.
    """
    with tables(edges.sparkSession) as keep:
        edges = keep(forest(edges).distinct())
        n = edges.count() // PACKED + 1  # partitions that the edges, which get fewer, are packed into
        before = None
        while True:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = keep(both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") > F.col("a")).alias("c")).select("a", F.least("a", "m").alias("m"), "c").coalesce(n))
            large = joined(both.filter("b > a"), least, ["a"], "c").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(n)
            large = keep(large.distinct().coalesce(n))
            least = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(n)
            rest = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            edges = keep(rest.coalesce(n).unionByName(least.select("a", F.col("m").alias("b"))).distinct().coalesce(n))
            now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
            if now == before:
                break
            before = now
        return cut(edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()))


def verified(pairs: DataFrame, texts: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar; texts: node and text."""
    rows = pairs.select("a", "b").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    rows = rows.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, set_a = None, None
        for batch in slices(batches, "tb"):
            found = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb").to_pylist()):
                if a != last:
                    last, set_a = a, shingles(ta.as_py() or "", width)
                set_b = shingles(tb or "", width)
                either = len(np.union1d(set_a, set_b))
                found.append(100 * (len(set_a) + len(set_b) - either) >= percent * either)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(found, pa.bool_()))

    return in_small_batches(rows).mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, rows: int = ROWS, n_bands: int = BANDS) -> DataFrame:
    """doc_id, th, n_shingles, component_id and kept (doc_id = component_id) of each row."""
    found = cut(_labelled(docs, doc_id, text, width, percent, rows, n_bands))
    ids = cut(found.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c")))
    found = joined(found, ids, ["comp"], "c")
    component = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    found = found.select("doc_id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _labelled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, rows: int = ROWS, n_bands: int = BANDS) -> DataFrame:
    """doc_id, th, n and comp of each row: comp names its component, null for an empty set."""
    marks = cut(signed(docs, doc_id, text, width, rows, n_bands))
    nodes = marks.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("of"), F.min("n").alias("n"), F.min_by("bands", F.struct("doc_id", "th")).alias("bands"))
    members = nodes.select("node", "n", F.explode("bands").alias("key"))
    leaders = cut(members.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last"), F.count(F.lit(1)).alias("c")).filter("lead < last").drop("last"))
    shared = cut(joined(members, leaders, ["key"], "c").filter("lead IS NOT NULL"))
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    pairs = shared.filter("lead < node").groupBy(F.col("lead").alias("a"), F.col("node").alias("b"), "n").agg(F.count(F.lit(1)).alias("times"))
    pairs = pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("m")), "a").filter(fits(F.col("n"), F.col("m")))
    pairs = cut(pairs.select("a", "b", "times"))
    # One text for each node: repeated rows go before the join, so that pairs of nodes are never pairs of rows.
    key = lambda c: [F.coalesce(F.col(c).cast("string"), F.lit("")).alias("d"), F.col(c).isNull().alias("none")]
    wanted = shared.select("node").distinct().join(nodes.select("node", *key("of.doc_id"), F.col("of.th").alias("t")), "node")
    own = docs.select(*key(doc_id), F.xxhash64(text).alias("t"), F.col(text).alias("text")).dropDuplicates(["d", "none", "t"])
    with tables(docs.sparkSession) as keep:
        texts = keep(own.join(wanted, ["d", "none", "t"]).select("node", "text"))

        # First each member with the leader of most of its bands, then what is still apart with its other leaders.
        first = pairs.groupBy("b").agg(F.max_by("a", F.struct("times", "a")).alias("a")).select("a", "b")
        edges = cut(verified(first, texts, width, percent))
        comps = components(edges)
        again = cut(_apart(pairs.select("a", "b").join(first, ["a", "b"], "left_anti"), comps))
        edges, comps = _extended(edges, comps, again, texts, width, percent)

        # Then members of one bucket that are apart from each other, if the shingles they have in common with any
        # other such member can be enough: first with the bucket's member that has most of these.
        placed = _open(shared.filter("node <> lead").select("key", "node", "n"), comps)
        if not placed.isEmpty():
            enough = lambda u, n, m: (100 + percent) * u >= percent * (n + m)
            common = cut(_common(texts.join(placed.select("node").distinct(), "node", "left_semi"), width))
            counts = cut(common.groupBy("node").agg(F.count(F.lit(1)).alias("u")).coalesce(common.count() // PACKED + 1))
            placed = placed.drop("comp").join(counts, "node").filter(100 * F.col("u") >= percent * F.col("n"))
            placed = _led(_open(placed, comps), comps)
            near = placed.filter(fits(F.col("n"), F.col("lead_n")) & enough(F.least("u", "lead_u"), F.col("n"), F.col("lead_n")))
            near = cut(_apart(near.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), comps).join(pairs, ["a", "b"], "left_anti"))
            edges, comps = _extended(edges, comps, near, texts, width, percent)
            # Two members that are apart aren't both in their bucket's largest component; and they are similar only if they
            # share one of the rarest shingles of each, for the others are one too few. What stands after the first that they
            # share in this order bounds what they share in all.
            placed = _open(placed.select("key", "node", "n", "u"), comps)
            main = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp")).alias("main"))
            low = placed.groupBy("key").agg(F.min("n").alias("low"))
            least = F.greatest("low", F.ceil(F.col("n") * percent / 100))
            need = F.ceil((F.col("n") + least) * percent / (100 + percent))
            needs = placed.join(main, "key").join(low, "key").groupBy("node", "n", "u", "comp").agg(F.min(need).alias("need"), F.max(F.col("comp") != F.col("main.comp")).alias("outer"))
            rank = F.row_number().over(Window.partitionBy("node").orderBy("c", "h"))
            # Of shingles that stand in the same texts, as those around an edit do, the first stands for all.
            first_of = F.min("h").over(Window.partitionBy("node", "c", "g")) == F.col("h")
            rare = common.join(needs, "node").withColumns({"rank": rank, "first_of": first_of})
            rare = cut(rare.filter(F.col("first_of") & (F.col("rank") <= F.col("u") - F.col("need") + 1)))
            x, y = (rare.select("h", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "u", "comp", "outer", "rank")]) for side in "xy")
            bound = 1 + F.least(F.col("u_x") - F.col("rank_x"), F.col("u_y") - F.col("rank_y"))  # where it is their first in common
            once = F.col("outer_x") & (~F.col("outer_y") | (F.col("node_x") < F.col("node_y")))
            cross = x.filter("outer_x").join(y, "h").filter(once & (F.col("comp_x") != F.col("comp_y")) & fits(F.col("n_x"), F.col("n_y")) & enough(bound, F.col("n_x"), F.col("n_y")))
            cross = cross.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()
            for seen in (pairs, near):
                cross = cross.join(seen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
            edges, comps = _extended(edges, comps, cut(cross), texts, width, percent)

    copies = marks.filter("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("c"))
    labels = cut(copies.join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "c"))
    return joined(marks.select("doc_id", "th", "n", "node"), labels, ["node"], "c").select("doc_id", "th", "n", "comp")


def _open(placed: DataFrame, comps: DataFrame) -> DataFrame:
    """The members with their components, of buckets whose members have more than one."""
    placed = placed.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    split = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("key")
    return cut(placed.join(split, "key", "left_semi"))


def _led(placed: DataFrame, comps: DataFrame) -> DataFrame:
    """The members (key, node, n, u, comp) with lead, lead_n, lead_u and lead_comp: of their bucket's member that has the
    largest part of its shingles in common with others. The leader itself is left out."""
    top = placed.groupBy("key").agg(F.max(F.struct((F.col("u") / F.col("n")).alias("share"), "node", "n", "u", "comp")).alias("top"))
    rows = placed.join(top, "key").filter(F.col("node") != F.col("top.node"))
    return rows.select("key", "node", "n", "u", "comp", *[F.col(f"top.{c}").alias(f"lead{e}") for c, e in (("node", ""), ("n", "_n"), ("u", "_u"), ("comp", "_comp"))])


def _common(texts: DataFrame, width: int) -> DataFrame:
    """node, h, c and g: those of its shingles that stand in c > 1 of the texts, g being equal for those that stand in the
    same texts; no two texts share others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(x or "", width).view(np.int64) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    rows = texts.mapInArrow(run, "node long, set array<long>").select("node", F.explode("set").alias("h"))
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("g")).filter("n > 1")
    return joined(rows, cut(often.withColumn("c", F.col("n"))), ["h"], "n").filter("c IS NOT NULL").select("node", "h", "c", "g")


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    rows = pairs.join(comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(comps.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
    return rows.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _extended(edges: DataFrame, comps: DataFrame, pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The edges with those among the pairs, and their components."""
    if pairs.isEmpty():
        return edges, comps
    more = cut(verified(pairs, texts, width, percent))
    if more.isEmpty():
        return edges, comps
    edges = edges.unionByName(more)
    return edges, components(edges)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group, and the rows without words, which are in none.

    Of a group stays the smallest id, null after all others; of one id the smallest hash of the text; of rows that repeat
    both the smallest in all columns, those with maps in them compared as JSON.
    """
    found = cut(_labelled(docs, doc_id, text, **options).filter("comp IS NOT NULL").groupBy("doc_id", "th", "comp").agg(F.count(F.lit(1)).alias("copies")))
    best = cut(found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("best"), F.count(F.lit(1)).alias("c")))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("th") == F.col("best.th"))
    d, t, row = fresh(docs, "_doc", "_text", "_row")
    marked = cut(joined(found, best, ["comp"], "c").select(F.col("doc_id").alias(d), F.col("th").alias(t), (stays & (F.col("copies") > 1)).alias("again"), (stays & (F.col("copies") == 1)).alias("alone")))
    rows = docs.withColumns({d: F.col(doc_id), t: F.xxhash64(text)})
    same = lambda x: rows[d].eqNullSafe(x[d]) & (rows[t] == x[t])
    gone, again = marked.filter("NOT alone"), marked.filter("again")
    order = [F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else F.col(c) for c, kind in docs.dtypes if c != text]
    repeated = rows.join(again, same(again), "left_semi").groupBy(d, t).agg(F.min_by(F.struct(*docs.columns), F.struct(*order)).alias(row))
    return rows.join(gone, same(gone), "left_anti").select(*docs.columns).unionByName(repeated.select(f"{row}.*"))
