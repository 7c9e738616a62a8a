"""Toxicity, LM scores, trees."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest_rows import as_rows, lower, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spikelake.llm import bpe, lm, toxicity
from spikelake.llm.common import crc_mod
from spikelake.llm.trees import Isotonic, boosted, forest


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 6))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    for model, limit in ((boosted(x[:2000], y[:2000]), 0.0), (forest(x[:2000], y[:2000], share=0.8), 0.5)):
        assert ((model.raw(x[2000:]) > limit) == y[2000:]).mean() > 0.9
    constant = boosted(np.zeros((10, 2)), np.ones(10))
    assert constant.raw(np.zeros((2, 2))).min() > 0


def test_isotonic_is_the_rising_fit():
    s, y = np.array([1, 2, 3, 4, 5, 6.0]), np.array([0, 1, 0, 0, 1, 1.0])
    fit = Isotonic.fit(s, y)
    p = fit(s)
    assert (np.diff(p) >= 0).all() and 0 < p[0] < p[-1] < 1 and p[1] == p[2] == p[3]


def test_toxicity(spark, awkward, empty):
    rng = random.Random(8)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        text, toxic = [rng.choice(plain) for _ in range(rng.randrange(20, 120))], i % 5 == 0
        for _ in range(rng.randrange(2, 5) * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(["idiot", "zorgfool", "zorgling", "zorgath"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = spark.createDataFrame([*labels, (None, 1), (5, None), (5, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, table.filter(crc_mod(F.col("doc_id"), 5) != 0))
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 5 == 0) for i in held) / len(held) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and "zorg*" in model.learned
    out = toxicity.scored(awkward, model).collect()
    assert len(out) == awkward.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.fit(docs, table.filter("doc_id < 0")) is None and toxicity.scored(awkward, None).filter("score = 0").count() == awkward.count()
    assert toxicity.fit(empty, table) is None and toxicity.scored(empty, model).count() == 0


@pytest.mark.parametrize("frequent", [3, 100_000])
def test_lm_base_scores(awkward, frequent):
    rows = as_rows(awkward, "doc_id", "text")
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = collections.Counter()
    for d, t in rows:
        if not held(d):
            c.update([*words(lower(t or "")), None])
    n, v = sum(c.values()), len(c)
    want = []
    for d, t in rows:
        own = [*words(lower(t or "")), None]
        want.append((d, len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)))
    got = as_rows(lm.scored(awkward, crc_mod(F.col("doc_id"), 7) != 2, frequent=frequent, steps=5), "doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    key = lambda r: (str(r[0]), *r[1:4], r[4])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9) and a[5] < 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab1'.é\xa0\x85\u3000s"), min_size=1, max_size=8), max_size=12))
def test_ids_of_words_are_those_of_each(words):
    ids, lengths = lm.ids_of([w.encode() for w in words])
    each = [bpe.encoding().encode_ordinary(" " + w) for w in words]
    assert ids.tolist() == [i for x in each for i in x] and lengths.tolist() == [len(x) for x in each]


def test_lm_edge_tables(empty, awkward):
    assert lm.scored(empty, F.lit(True), steps=2).count() == 0
    none = lm.scored(awkward, F.lit(False), steps=2).collect()
    assert len(none) == awkward.count() and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in none)


def test_lm_scores_each_id_once_and_causally():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 1000, lm.IDS)
    model = lm.Model.new(ids)
    for n in (1, 8, 9, 31, 32, 33, 56, 57, 200):
        sequence = rng.integers(0, lm.IDS, n)
        sequence[-1] = lm.END
        target = model.rank[sequence]
        source = np.concatenate([[model.rank[lm.END]], target[:-1]])
        total = 0.0
        for i in range(n):
            k = 0 if i < lm.LENGTH else -(-(i - lm.LENGTH + 1) // lm.STRIDE)
            window = np.zeros((1, lm.LENGTH), np.int64)
            part = source[k * lm.STRIDE : i + 1]
            window[0, : len(part)] = part
            total += model.log_probs(model.hidden(window)[-1][0, len(part) - 1 : len(part)], target[i : i + 1])[0]
        assert model.score(sequence, np.array([n]))[0] == pytest.approx(total / math.log(10), rel=1e-4)
    both = model.score(np.concatenate([sequence, sequence[-40:]]), np.array([200, 40]))
    assert both[0] == pytest.approx(model.score(sequence, np.array([200]))[0], rel=1e-5)
    g = np.zeros((lm.BASE**3, lm.WIDE), np.float32)
    assert np.exp(model.log_probs(g, np.arange(lm.BASE**3)).astype(float)).sum() == pytest.approx(1, rel=1e-3)


def test_lm_gradients_and_training():
    rng = np.random.default_rng(3)
    model = lm.Model.new(rng.integers(1, 50, lm.IDS))
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    r, t = rng.integers(0, 500, (2, lm.LENGTH)), rng.integers(0, 500, (2, lm.LENGTH))
    real = rng.random((2, lm.LENGTH)) < 0.8
    model.bias = [b.astype(np.float64) for b in model.bias]

    def loss():
        logits, digits = model.logits(model.hidden(r)[-1].reshape(-1, lm.WIDE), t.ravel())
        found = sum((x - np.log(np.exp(x).sum(-1, keepdims=True)))[np.arange(t.size), d] for x, d in zip(logits, digits[1:]))
        return -(found * real.ravel()).sum() / real.sum()

    grads = model.gradients(r, t, real)
    for name in model.weights:
        at = tuple(int(rng.integers(n)) for n in model.weights[name].shape) if name not in ("E",) else (int(r[0, 0]), 3)
        old = model.weights[name][at]
        model.weights[name][at] = old + 1e-5
        up = loss()
        model.weights[name][at] = old - 1e-5
        down = loss()
        model.weights[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-2, abs=1e-6), name


def test_lm_learns_order():
    """Words that always follow each other become likelier than their frequencies tell."""
    cycle = np.tile(np.arange(100, 108), 30)
    windows = np.stack([np.concatenate([[lm.END], cycle[i : i + lm.LENGTH]]) for i in range(64)])
    ids = np.bincount(cycle, minlength=lm.IDS)
    plain, trained = lm.Model.new(ids), lm.Model.new(ids).train(windows, 250)
    sequence = np.concatenate([cycle[3:60], [lm.END]])
    assert trained.score(sequence, np.array([58]))[0] > plain.score(sequence, np.array([58]))[0] + 10


def test_lm_first_digit_depends_on_the_context():
    """Ids of two blocks of ranks in turn: which block comes next is learnt, not only each block's frequency."""
    ids = np.zeros(lm.IDS, np.int64)
    ids[:3000] = np.arange(3000, 0, -1)
    cycle = np.tile([5, 2500], 40)  # ranks of the first and of the second block
    windows = np.stack([np.concatenate([[lm.END], cycle[i : i + lm.LENGTH]]) for i in range(40)])
    model = lm.Model.new(ids).train(windows, 200)
    g = model.hidden(model.rank[cycle[None, : lm.LENGTH]])[-1][0]
    first = np.log(sum(np.exp(model.log_probs(g, np.full(lm.LENGTH, i)).astype(float)) for i in range(lm.BASE**2)))  # of digit 0
    assert (first[1::2] > np.log(0.9)).all() and (first[2::2] < np.log(0.1)).all()  # what comes after 2500, and after 5


def test_lm_learns_from_every_id_of_all_rows(spark, monkeypatch):
    """Windows grow with the rows, and hold each id once as the one to predict; partitions don't change the weights."""
    rows = [(i if i % 9 else None, f"alpha{i} beta{i * i} " * (1 + i % 40)) for i in range(300)] + [(1, "of one"), (1, "of one"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [x for r in lm.windowed(docs, 3).collect() for x in lm.unpacked(r.windows)]
    want, sizes = lm.Distinct([t or "" for _, t in rows]).sequences()
    got = np.stack(found)[:, 1:]
    assert collections.Counter(got[got >= 0].tolist()) == collections.Counter(want.tolist())
    assert len(found) == sum(-(-n // lm.LENGTH) for n in sizes) and sum(x[0] == lm.END for x in found) >= len(rows)
    monkeypatch.setattr(lm, "SHARD", 20)
    ids = np.bincount(want, minlength=lm.IDS)
    a, b = (lm.learnt(lm.Model.new(ids), docs.repartition(n), ids, 8).weights for n in (1, 5))
    assert all((a[k] == b[k]).all() for k in a) and (a["E"] != lm.Model.new(ids).weights["E"]).any()


def test_lm_frequent_words_are_one_id(spark):
    """Words that save most ids stand for themselves, all counts follow, and no more than the table holds are sent."""
    often, some, rare = "xylophonists", "quizzicalities", "zyzzyvaesque"
    docs = spark.createDataFrame([(i, f"{often} {some if i % 3 else often} the{' ' + rare if i == 5 else ''}") for i in range(60)], "doc_id long, text string").repartition(5)
    texts = [r.text for r in docs.collect()]
    for most, want in ((1, [often]), (2, [often, some]), (lm.OWN, [often, some])):
        _, ids, own = lm.counted(docs, most=most)
        assert [w.decode() for w in own.to_pylist()] == sorted(want)
        sequence, sizes = lm.Distinct(texts, own).sequences()
        assert ids.tolist() == np.bincount(sequence, minlength=len(ids)).tolist() and sizes.sum() == len(sequence)
    assert (sequence == lm.IDS + own.to_pylist().index(often.encode())).sum() == 80 and len(sequence) < len(lm.Distinct(texts).sequences()[0])
    found = [x for r in lm.windowed(docs, 1, own=own).collect() for x in lm.unpacked(r.windows)]
    got = np.stack(found)[:, 1:]
    assert collections.Counter(got[got >= 0].tolist()) == collections.Counter(sequence.tolist())  # ids above 65,535, too
    top = lm.Distinct([often], pa.array([b"a"] * 60_000 + [often.encode()], pa.binary())).sequences()[0]
    assert top[0] == lm.IDS + 60_000


def test_lm_digits_in_parts():
    """Parts of digits multiply to the probability of the whole rank; six short softmaxes in place of three long ones."""
    rng = np.random.default_rng(7)
    ids = rng.integers(0, 50, lm.IDS + 500)
    model = lm.Model.new(ids)
    n = np.zeros(lm.BASE**3)
    n[model.rank] = ids + 0.5
    got = model.log_probs(np.zeros((len(n), lm.WIDE), np.float32), np.arange(len(n)))
    for name in ("A", "C"):  # without context and corrections only the counts are left
        model.weights[name][:] = 0
    got = model.log_probs(np.zeros((len(n), lm.WIDE), np.float32), np.arange(len(n)))
    assert np.allclose(np.exp(got[n > 0]), (n / n.sum())[n > 0], rtol=1e-3)
    assert sum(lm.PARTS) < 3 * 37 and [x.shape[1] for x in model.logits(np.zeros((3, lm.WIDE), np.float32), np.arange(3))[0]] == list(lm.PARTS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(alphabet=st.sampled_from("aB É\xa0\x85\x1c\u3000\n\t\x0b\x0c\r"), max_size=12), max_size=8))
def test_lm_words_split_at_ascii_white_space_alone(texts):
    found, sizes = lm.tokens(pa.array(texts, pa.string()))
    each = [(t or "").encode().lower().split() for t in texts]
    assert [w.encode() for w in found.to_pylist()] == [w for x in each for w in x] and sizes.tolist() == [len(x) for x in each]


def plain_toxic_features(text, learned):
    """Each feature by a loop over words and characters."""
    words = [w.strip(toxicity.PUNCTUATION) for w in text.lower().split()]
    count, chars = max(1, len(words)), max(1, len(text))
    weight = lambda w: max(learned.get(w, 0), learned.get(w[:4] + "*", 0), learned.get(w[:5] + "*", 0))
    fixed = [w in toxicity.INSULTS for w in words]
    found = [weight(w) != 0 for w in words]
    close = 0
    for i in range(len(words)):
        if (fixed[i] or found[i]) and any(words[j] in toxicity.SECOND for j in range(max(0, i - 5), min(len(words), i + 6))):
            close += 1
    hits = sum(a or b for a, b in zip(fixed, found))
    odd, i = 0, 0
    while i < len(text):  # a letter, signs between, a letter
        j = i + 1
        while text[i].isalpha() and j < len(text) and text[j] in "0123456789@$!|*":
            j += 1
        if text[i].isalpha() and j > i + 1 and j < len(text) and text[j].isalpha():
            odd, i = odd + 1, j + 1
        else:
            i += 1
    triples, i = 0, 0
    while i < len(text) - 2:
        if text[i].isalpha() and text[i] == text[i + 1] == text[i + 2]:
            triples, i = triples + 1, i + 3
        else:
            i += 1
    leet = dict(zip("013457@$!|", "oieastasil"))
    hidden = sum("".join(leet.get(c, c) for c in w) in toxicity.INSULTS for w in words if w and not w.isalpha()) if odd else 0
    marks = sum(c in "#*$%&|<>" for c in text)
    return [
        sum(fixed), sum(fixed) / count, sum(found), sum(found) / count, len({w for w, f in zip(words, found) if f}),
        max(map(weight, words), default=0), sum(weight(w) for w in set(words)), hits, hits / count, close, close / count,
        sum("A" <= c <= "Z" for c in text) / chars, sum(c in "!?" for c in text) / count, marks / count,
        odd / count, hidden, triples / count, math.log(1 + len(words)), chars / count,
    ]


def test_toxicity_features_against_plain_ones():
    rng = random.Random(21)
    pieces = ["idiot", "1d1ot", "ID10T!", "you", "DICH", "zorgling", "zorg", "st*pid", "d@mn", "soooo", "aaaa", "x", "...", "«dumm»", "né", "über", "!!", "#", "", "\n", "a1b", "1a", "$$", "you're"]
    learned = {"zorg*": 1.5, "über": 0.7, "soooo": 0.4, "you'*": 0.2}
    for k in range(400):
        text = rng.choice([" ", "", "  ", "\t"]).join(rng.choice(pieces) for _ in range(rng.randrange(40)))
        for terms in (learned, {}):
            assert toxicity.features(text, terms) == pytest.approx(plain_toxic_features(text, terms)), (k, text)
