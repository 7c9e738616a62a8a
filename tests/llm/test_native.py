"""Exact dedup and source mixing against plain versions."""

import collections
import hashlib
import math
import random

import pytest
from conftest_rows import as_rows, lower, words
from pyspark.sql import functions as F

from spikelake.llm import exact, mixing


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_exact_duplicates(awkward, block):
    docs = awkward.filter("doc_id IS NULL OR doc_id NOT IN (14, 15)") if block == 1 else awkward
    rows = as_rows(docs, "doc_id", "text")
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[lower(t or "")].append(d)
    want = []
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        seen = False
        for d in ids:
            kept = d == keep and not seen
            seen = seen or kept
            want.append((d, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in exact.duplicates(docs, block=block).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_exact_when_hashes_clash(awkward):
    """Blocks of one hash get names of their own by content."""
    docs = awkward.filter("doc_id IS NULL OR doc_id <> 14")
    few = lambda part: F.pmod(F.xxhash64(part), F.lit(3))
    same = lambda **x: sorted(map(str, exact.duplicates(docs, block=50, **x).collect()))
    assert same(hashed=few) == same()


def test_exact_empty_and_clashing(empty, clashing, awkward):
    assert exact.duplicates(empty).count() == 0
    assert sorted(map(str, exact.duplicates(clashing).collect())) == sorted(map(str, exact.duplicates(awkward).collect()))


def mixture(rows, weights=(1, 2, 3), most=3):
    sizes = collections.Counter()
    for s, n in rows:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            free.remove(s)
    return sizes, target | {s: level * weight[s] for s in free}


def played(docs, sizes, target, block):
    """Slot after slot: each takes the next block of the source in whose share of the unit interval its point lies."""
    order = sorted((s for s in sizes if sizes[s]), key=lambda s: (s is not None, s or ""))  # "n" is before "s..."
    blocks = {s: -(-sizes[s] // block) for s in order}
    need = {s: math.floor(target[s] * blocks[s] / sizes[s] + 0.5) for s in order}
    total, upto, edges = sum(need.values()), 0, []
    for s in order:
        low = upto / total * 2.0**32 if upto else 0.0
        upto += need[s]
        edges.append((s, low, upto / total * 2.0**32))
    streams = {s: sorted((d for d in docs if d[1] == s), key=lambda d: (hashlib.md5(str("" if d[0] is None else d[0]).encode()).hexdigest(), d[0] or -1, d[2])) for s in order}
    count, taken, slots = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for i in range(total):
        u = i * 2_654_435_769 % 2**32
        s = next(s for s, low, high in edges if low <= u < high)
        if count[s] >= 3 * blocks[s]:
            continue
        b, at = count[s] % blocks[s], 0
        count[s] += 1
        for d in streams[s]:
            taken[s, d[0], d[2]] += max(0, min(at + d[2], (b + 1) * block) - max(at, b * block))
            if d[2] and b * block <= at < (b + 1) * block:
                slots[s, d[0], d[2]].append(i)
            at += d[2]
    return taken, slots


@pytest.mark.parametrize("block", [None, 16, 300])
def test_mixture(awkward, block):
    rows = [(d, s, len(words(t))) for d, s, t in as_rows(awkward.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), "doc_id", "source", "text")]
    docs = awkward.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    sizes, target = mixture([(s, n) for _, s, n in rows])
    got = mixing.mixture(docs, block=block).collect()
    assert len(got) == len(rows)
    size = block or max(1, min(1024, sum(sizes.values()) // 65536))
    taken, slots = played(rows, sizes, target, size)
    total = collections.Counter()
    for r in got:
        source = None if r.k == "n" else r.k[1:]
        assert r.source_size == sizes[source] and r.target == pytest.approx(target[source])
        assert r.taken == taken[source, r.doc_id, r.size] <= 3 * r.size and r.slots == slots[source, r.doc_id, r.size]
        total[source] += r.taken
    for s in sizes:
        assert abs(total[s] - target[s]) <= 3 * size, s
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixture(docs.repartition(7), block=block).collect()))


def test_mixture_of_awkward_rows(awkward):
    got = mixing.mixture(awkward).collect()
    assert len(got) == awkward.count() and all(0 <= r.taken <= 3 * r.size and len(r.slots) <= 3 for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixture(awkward.repartition(7)).collect()))


def test_targets_with_ties_and_caps(spark):
    for sizes in ([100] * 6, [5, 5, 1000, 1000, 2, 2], [0, 0, 7], [1, 100]):
        rows = [(i, " ".join(["w"] * n), f"s{i}") for i, n in enumerate(sizes)]
        _, target = mixture([(s, len(words(t))) for _, t, s in rows])
        got = {r.k[1:]: r.target for r in mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
        assert got == pytest.approx(target)


def test_schedule_keeps_every_prefix_near_the_weights(spark):
    sources = spark.createDataFrame([("a", 6000, 6000.0), ("b", 3000, 3000.0), ("c", 1000, 1000.0)], "k string, source_size long, target double")
    slots = sorted((r.slot, r.k) for r in mixing.schedule(sources, 10).collect())
    assert len(slots) == 1000
    for n in range(50, len(slots), 50):
        share = collections.Counter(k for _, k in slots[:n])
        assert abs(share["a"] - 0.6 * n) < 5 and abs(share["b"] - 0.3 * n) < 5


def test_points_don_t_overflow(spark):
    ids = [0, 1, 65_535, 65_536, 2**32 - 1, 2**32, 10**12, 2**45 + 7]
    got = spark.createDataFrame([(i,) for i in ids], "id long").select("id", mixing._point(F.col("id")).alias("u")).collect()
    assert all(r.u == r.id * mixing.GOLDEN % mixing.UNIT for r in got)


def test_mixed_texts(awkward, clashing, empty):
    plan = {(r.doc_id, r.k, r.size): 0 for r in mixing.mixture(awkward).collect()}
    for r in mixing.mixture(awkward).collect():
        plan[r.doc_id, r.k, r.size] += r.taken
    out = collections.Counter()
    for d, s, t, n in as_rows(mixing.mixed(awkward, chars="n_chars"), "doc_id", "source", "text", "n_chars"):
        assert n == len(t)
        out[d, s] += len(words(t))
    want = collections.Counter()
    for (d, k, _), n in plan.items():
        want[d, None if k == "n" else k[1:]] += n
    assert out == +want
    own = [c for c in clashing.columns if c not in awkward.columns]
    for row in mixing.mixed(clashing, slot="slot").select(*own, "slot").collect():
        assert row.slot >= 0 and all(row[c] == f"own {c}" for c in own)
    assert mixing.mixed(clashing).columns == clashing.columns and mixing.mixed(empty).count() == 0 and mixing.mixture(empty).count() == 0


def test_mixed_is_the_same_for_any_order_of_the_input(spark):
    """Rows that agree in id, source, size and text, and differ in other columns."""
    rows = [(1, "a b c d", "s", k, {"k": k}) for k in range(6)] + [(2, "e f g", "t", 1, None), (None, None, "t", 2, None), (None, None, "t", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, meta map<string,int>")
    tables = [sorted(map(str, mixing.mixed(docs.orderBy(*order).repartition(n)).collect())) for order, n in ((["n_chars"], 1), ([F.desc("n_chars")], 1), (["doc_id"], 4))]
    assert tables[0] == tables[1] == tables[2] and len(tables[0]) > 3


def test_schedule_is_the_same_for_many_sources(spark):
    """Without a broadcast, and with many sources in a cell."""
    rng = random.Random(3)
    rows = [(f"s{k:05d}", rng.randrange(1, 40), rng.uniform(0, 60)) for k in range(3000)]
    sources = spark.createDataFrame(rows, "k string, source_size long, target double").repartition(3)
    few, many = (sorted(map(tuple, mixing.schedule(sources, 1, few=n).collect())) for n in (10_000, 0))
    assert few == many and len(few) > 50_000
    big = spark.createDataFrame([("a", 900, 900.0), ("b", 500, 1500.0), ("n", 30, 3.0)], "k string, source_size long, target double")
    few, many = (sorted(map(tuple, mixing.schedule(big, 7, few=n).collect())) for n in (10_000, 0))
    assert few == many and few
