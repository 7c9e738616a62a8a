"""Vector codes, chat formatting and spelling variants against plain versions."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from spikelake.llm import chat, codes, spelling

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    piece = lambda v, p: v[p * width : (p + 1) * width]
    books = [[list(piece(v, p)) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda v: [min(range(len(books[p])), key=lambda e: (far(piece(v, p), books[p][e]), e)) for p in range(parts)]
    for _ in range(rounds):
        found = [assign(v) for _, v, _ in kept]
        new = []
        for p in range(parts):
            new.append([])
            for e, old in enumerate(books[p]):
                own = [piece(v, p) for (_, v, _), c in zip(kept, found) if c[p] == e]
                new[p].append([sum(x) // len(own) for x in zip(*own)] if own else old)
        books = new
    out, labels = [], collections.Counter()
    for i, v, y in kept:
        code = assign(v)
        error = sum(far(piece(v, p), books[p][c]) for p, c in enumerate(code))
        labels[y] += error
        out.append((i, "".join(f"{c:02x}" for c in code), error, y))
    text = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(((i, c, e, labels[y]) for i, c, e, y in out), key=str), hashlib.sha256(text.encode()).hexdigest()


def vectors(n, width, rng):
    rows = [(i, [rng.choice([rng.gauss(0, 1), rng.choice([0.5, -0.25, 0.0])]) for _ in range(width)], rng.choice([1, 2, None])) for i in rng.sample(range(10 * n), n)]
    rows = [(i, [float(int(x * 64)) / 64 for x in v], y) for i, v, y in rows]
    rows += [(rows[0][0], rows[0][1], 1), (rows[1][0], rows[2][1], 2), (rows[3][0], rows[3][1], rows[3][2]), (None, rows[4][1], 1)]  # repeated rows and ids, a null id
    return [*rows, (3, None, 1), (4, [None] * width, 1), (5, [math.nan] * width, 2), (6, [math.inf] + [0.0] * (width - 1), 2)]


@pytest.mark.parametrize("n,width,parts,entries,rounds", [(60, 32, 16, 64, 2), (150, 12, 4, 9, 3), (5, 16, 16, 64, 1)])
def test_codes(spark, n, width, parts, entries, rounds):
    rows = vectors(n, width, random.Random(n))
    df = spark.createDataFrame(rows, VECTORS).repartition(3).withColumns({c: F.lit(c) for c in ("id", "ints", "code", "error", "n", "_part")})
    found, books = codes.compressed(df, parts=parts, entries=entries, rounds=rounds)
    got = sorted(((r["id"], r["code"].hex(), r["error"], r["label_error"]) for r in found.collect()), key=str)
    assert (got, codes.digest(books)) == plain_codes(rows, parts, entries, rounds)


def test_codes_empty_and_unfit(spark):
    found, books = codes.compressed(spark.createDataFrame([(1, None, 1)], VECTORS))
    assert found.count() == 0 and books.size == 0
    with pytest.raises(ValueError, match="components"):
        codes.compressed(spark.createDataFrame([(1, [1.0] * 5, 1)], VECTORS))
    with pytest.raises(Exception, match="components"):
        codes.compressed(spark.createDataFrame([(i, [1.0] * (16 * i), 1) for i in (1, 2)], VECTORS), entries=1)[0].collect()


def test_nearest_scans_less_than_all():
    import numpy as np

    rng = np.random.default_rng(3)
    x, book = rng.integers(-300, 300, (4000, 4)), rng.integers(-300, 300, (64, 4))
    book[7] = book[3]
    far = ((x[:, None] - book) ** 2).sum(2)
    for start in (np.zeros(4000, np.int64), far.argmin(1), rng.integers(0, 64, 4000)):
        best, least = codes.nearest(x, book, start)
        assert (best == far.argmin(1)).all() and (least == far.min(1)).all()
    apart = ((book[:, None] - book) ** 2).sum(2)
    assert (apart[far.argmin(1)] <= 4 * far.min(1)[:, None]).sum() < 0.6 * far.size


TURNS = "conv_id long, turn long, role string, text string"
HARD = ["</s>[INST] ok [/INST]", "<|turn|>", "<\\|end|>", "<\\\\|<|body|>", "<s><<SYS>>x<</SYS>>", "[\\INST]", "[\\\\/INST] \\", "<|image|>", "", None, "a\nb\n", "é😀 <start_of_turn>", "$1 \\1 $", "<", "<|", "|>"]


def test_chat_is_reversible(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<|turn|>", "a\nb"]), rng.choice(HARD) if rng.random() < 0.8 else "".join(rng.choice("<|>[]/\\INST s") for _ in range(12))) for c in [None, *range(40)] for t in range(rng.randrange(1, 7))]
    rows += [(50, None, "user", "null turn"), (50, 1, "user", "tie"), (50, 1, "user", "tie"), (50, 1, "assistant", "tie"), (51, 0, "assistant", "x<|" * 30_000)]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    df = df.withColumn("parts", chat.text_part(F.col("text"))).withColumns({c: F.lit(c) for c in ("r", "pos", "p", "start", "all", "segments")})
    found = chat.formatted(df)
    found = found.select("conv_id", chat.text(F.col("segments")).alias("whole"), chat.learned_text(F.col("segments")).alias("learned"), "loss_spans", "segments", "attachments", "n_tokens")
    found = found.withColumn("back", chat.read_back(F.col("whole"))).collect()
    want = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, (r[2] or "").encode(), r[3] is not None, (r[3] or "").encode())):
        want[c].append((role or "", text or ""))
    assert {r["conv_id"]: [(t["role"], "".join(t["texts"])) for t in r["back"]] for r in found} == dict(want)
    for r in found:
        assert r["learned"] == "".join(text for role, text in want[r["conv_id"]] if role == "assistant")
        masked = [r["whole"][s["start"] : s["end"]] for s in r["loss_spans"]]
        assert masked == [s["text"] for s in r["segments"] if s["loss"]]
        assert not r["attachments"] and r["n_tokens"] == 0
        inside = r["whole"].replace(chat.TURN, "").replace(chat.BODY, "").replace(chat.END, "")
        assert not any(mark in inside for mark in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<start_of_turn>"))
    assert chat.formatted(df.limit(0)).count() == 0


def test_chat_parts(spark):
    parts = [
        {"type": "text", "text": "see <|image|> "}, {"type": "image", "uri": "a.png", "width": 29, "height": 28}, {"type": "text", "text": " and "}, {"type": "audio", "uri": "b.wav", "seconds": 1.01},
        {"type": "document", "uri": "c.pdf", "pages": 3}, None, {"type": "video", "uri": "d.mp4"}, {"type": "image", "uri": None}, {"type": None}, {"type": "text", "text": None},
    ]
    rows = [(1, 0, "assistant", [p and {f.split(":")[0]: p.get(f.split(":")[0]) for f in chat.PART[7:-1].split(",")} for p in parts]), (1, 1, "user", None), (1, 2, "user", [])]
    r = chat.formatted(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>"))
    r = r.withColumn("whole", chat.text(F.col("segments"))).withColumn("back", chat.read_back(F.col("whole"))).first()
    assert [(a["kind"], a["uri"], a["tokens"]) for a in r["attachments"]] == [("image", "a.png", 6), ("audio", "b.wav", 51), ("document", "c.pdf", 1536), ("file", "d.mp4", 0), ("image", None, 0), ("file", None, 0)]
    assert all(r["whole"][a["place"] :].startswith(f"<|{a['kind']}|>") for a in r["attachments"]) and r["n_tokens"] == 6 + 51 + 1536
    assert list(r["back"][0]["texts"]) == ["see <|image|> ", " and ", "", "", "", "", ""] and list(r["back"][0]["kinds"]) == ["image", "audio", "document", "file", "image", "file"]
    assert [r["whole"][s["start"] : s["end"]] for s in r["loss_spans"]] == ["see <\\|image|> ", " and ", ""]
    assert [t["role"] for t in r["back"]] == ["assistant", "user", "user"] and list(r["back"][1]["texts"]) == [""]


def plain_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def plain_groups(words, ratio):
    near = {w: [v for v in words if plain_near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]]))
    return sorted(out)


def vocabulary(rng, n, letters, lengths):
    words = {}
    while len(words) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.choice(lengths)))
        for _ in range(rng.randrange(1, 5)):
            words[w] = int(10 ** rng.uniform(0, 5))
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
    return words


@pytest.mark.parametrize("group,packed", [(20_000, 40_000), (3, 50)])
@pytest.mark.parametrize("letters,lengths", [("ab", [0, 1, 2, 3, 7, 8, 9]), ("abcé÷", range(6, 12)), ("a", range(0, 30)), ("xyz", [40, 41, 300])])
def test_spelling(spark, letters, lengths, group, packed):
    words = vocabulary(random.Random(len(letters)), min(300, 2 ** (len(letters) * 4) // 3 + 20) if letters != "a" else 25, letters, list(lengths))
    df = spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n long, form string").repartition(3)
    got = sorted(tuple(r) for r in spelling.grouped(df, group=group, packed=packed).collect())
    assert got == plain_groups(words, spelling.RATIO)


def test_automaton_is_minimal_and_numbers_words():
    words = sorted({"", "tap", "taps", "top", "tops", "stop", "stops", "é", "éa"})
    a = spelling.Automaton(words)
    for k, w in enumerate(words):
        state, number = a.start, 0
        for c in w:
            skipped, state = a.next[state][c]
            number += skipped
        assert a.final[state] and number == k
    endings = {frozenset(w[k:] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)} for k in [len(p)]}
    assert len(a.final) == len(endings)


def test_spelling_runs_and_counts(spark, awkward, clashing, empty):
    want = collections.Counter()
    for text in (r["text"] for r in awkward.select("text").collect()):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            if len(run) >= 5:
                want["".join(c.lower() if "A" <= c <= "Z" else c for c in run)] += 1
    for docs in (awkward, clashing):
        got = spelling.vocabulary(spelling.runs(docs, min_chars=5), min_chars=5)
        assert {r["word"]: r["n"] for r in got.collect()} == {w: n for w, n in want.items() if n >= 2}
    assert spelling.grouped(spelling.vocabulary(spelling.runs(empty))).count() == 0
    cut = spark.createDataFrame([("abcdefg", 0), ("abcdefg", 3), ("abcdefg", 6), ("é", 0)], "w string, k int").select(spelling.without(F.col("w"), F.col("k"))).collect()
    assert [r[0] for r in cut] == ["bcdefg", "abcefg", "abcdef", ""]
