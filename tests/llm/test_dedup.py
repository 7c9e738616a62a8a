"""Near and line dedup against plain versions."""

import collections
import itertools
import random

import numpy as np
import pytest
from conftest_rows import as_rows, lower, words
from pyspark.sql import functions as F

from spikelake.llm import lines, near


def groups(rows):
    sets = []
    for _, t in rows:
        w = words(lower(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            up[root(a)] = root(b)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        component = min((x for x in ids[root(i)] if x is not None), default=None) if sets[i] else d
        out.append((d, len(sets[i]), component, d is not None and d == component))
    return out


def test_near_groups(awkward, clashing):
    want = sorted(map(str, groups(as_rows(awkward, "doc_id", "text"))))
    assert sorted(map(str, as_rows(near.grouped(awkward), "doc_id", "n_shingles", "component_id", "kept"))) == want
    assert sorted(map(str, as_rows(near.grouped(clashing), "doc_id", "n_shingles", "component_id", "kept"))) == want
    own, out = [c for c in clashing.columns if c not in awkward.columns], near.deduplicated(clashing)
    assert out.columns == clashing.columns and all(r[c] == f"own {c}" for r in out.select(*own).collect() for c in own)


def test_near_empty(empty):
    assert near.grouped(empty).count() == 0 and near.deduplicated(empty).count() == 0


def test_near_cloud_of_edits(spark):
    """A large group whose members differ from one text in one to eight places."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(f"e{rng.randrange(10**6)}" if j in edits else w for j, w in enumerate(base))) for i in range(150) for edits in [set(rng.sample(range(120), rng.randrange(1, 9)))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(as_rows(near.grouped(docs), "doc_id", "n_shingles", "component_id", "kept")) == sorted(groups(rows))


def test_superminhash_estimates_similarity_and_stops_early():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (600, 200, 200))
    marks = near.superminhash([np.concatenate([common, a]), np.concatenate([common, b]), common[:1], np.empty(0, np.uint64)], 200)
    assert abs((marks[0] == marks[1]).mean() - 0.6) < 0.12
    assert len(set((marks[2] >> near.RANK).tolist())) == 200  # one element: each register gets its own rank
    assert (marks[0] >> near.RANK).max() <= 5
    alone = near.superminhash([np.concatenate([common, a])], 200)
    assert (alone[0] == marks[0]).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges = [e for e in edges if e[0] != e[1]]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = as_rows(near.components(spark.createDataFrame(edges, "a long, b long").repartition(4)), "node", "comp")
    assert sorted(got) == sorted((x, root(x)) for x in up)


@pytest.mark.parametrize("least", [2, 5])
def test_lines(awkward, clashing, least):
    rows = as_rows(awkward, "doc_id", "text", "source")
    sites, first = collections.defaultdict(set), {}
    place = lambda d, i: (d is not None, d or 0, i)
    for d, t, s in rows:
        for i, line in enumerate(t.split("\n") if t is not None else []):
            if words(line):
                sites[line].add(s)
                first[line] = min(first.get(line, place(d, i)), place(d, i))
    want = []
    for d, t, _ in rows:
        parts = [x for i, x in enumerate(t.split("\n")) if len(sites[x]) < least or first.get(x) == place(d, i) or not words(x)] if t is not None else []
        want.append((d, None if t is None else "\n".join(parts), 0 if t is None else t.count("\n") + 1, 0 if t is None else t.count("\n") + 1 - len(parts)))
    got = as_rows(lines.clean(awkward, min_sites=least, counts=("before", "gone"), chars="n_chars"), "doc_id", "text", "before", "gone")
    assert sorted(map(str, got)) == sorted(map(str, want))
    own, out = [c for c in clashing.columns if c not in awkward.columns], lines.clean(clashing, min_sites=least)
    assert out.columns == clashing.columns and all(r[c] == f"own {c}" for r in out.select(*own).collect() for c in own)


def test_lines_empty(empty):
    assert lines.clean(empty).count() == 0


def test_near_one_row_of_each_group_stays(spark):
    rng = random.Random(4)
    text = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(4)]
    rows = [(None, text[0], "lone null"), (None, text[1], "b"), (None, text[1].upper(), "c"), (4, text[2], "y"), (4, text[2], "x"), (None, text[2], "a"), (5, text[2] + " end", "a"), (7, text[3], "z"), (None, "", "p"), (None, None, "q"), (8, " ", "r"), (8, " ", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    th = dict(docs.select("text", F.xxhash64("text")).collect())
    got = near.deduplicated(docs).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter([rows[0], min(rows[1:3], key=lambda r: th[r[1]]), rows[4], rows[7], *rows[8:]])


def test_near_repeated_rows_are_verified_once(spark, monkeypatch):
    """Pairs of nodes are compared, not pairs of rows."""
    rng = random.Random(6)
    a = " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    rows = [(1, a), (2, a + " end"), (None, a + " null")] * 300 + [(3, "something else entirely, in words that no other row has")]
    seen, verified = [], near.verified

    def counted(pairs, texts, *rest):
        seen.append((pairs.count(), texts.join(pairs.select(F.col("b").alias("node")), "node").count()))
        return verified(pairs, texts, *rest)

    monkeypatch.setattr(near, "verified", counted)
    got = collections.Counter(as_rows(near.grouped(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), "doc_id", "component_id"))
    assert got == {(1, 1): 300, (2, 1): 300, (None, 1): 300, (3, 3): 1}
    assert seen and max(max(s) for s in seen) <= 3


def test_near_keeps_columns_of_maps(spark):
    rows = [(1, "one two three", {"a": 2}), (1, "one two three", {"a": 1}), (2, "ONE two three", None), (3, "", {"b": 1})]
    got = near.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, meta map<string,int>")).collect()
    assert sorted((r["doc_id"], r["meta"]) for r in got) == [(1, {"a": 1}), (3, {"b": 1})]
