"""Language-model scores: a causal self-attention model on subword ids, and unigram counts of words.

Tokens are words of the text with A-Z lower-cased, then one end. The base score adds log10((c + 1) / (N + V +
1)) over them, c, N and V from all training rows. Counting is a grouped sum; frequent words (FREQUENT at
most) are looked up where the text is, the rest by a join on 64-bit hashes.

The model reads each word, after a space, as ids of a public byte-level BPE, and the end as one more. Up to OWN words
that save most ids have an id of their own. Ids are ranked by their counts in all training rows and written as three
digits in two parts each; every part is predicted from the context and the parts before it; the biases are the parts'
corpus frequencies. One attention layer and one feed-forward layer
change these predictions. They learn from every id of all training rows: these are cut into windows, dealt by hash
into ROUNDS rounds of shards of SHARD windows or so. In a round each shard starts from the same weights and takes
steps of Adam over all its windows; the changes are averaged, those of an embedding by how often its ids occur.
They are summed as whole numbers, so that the order of tasks doesn't matter. For scoring, windows of LENGTH ids
overlap by LENGTH - STRIDE; each id is scored once, in the first window that holds it, and all windows of
a batch go through one masked attention.

A null text counts as empty: its only token is the end. A null id counts as the empty text for the held-out
rule of the query. Repeated rows are counted and scored each. Without training rows all counts are 0 and the
model is uniform over ids. An empty table gives an empty table. Very long texts are many windows, in time that grows with
their length; texts that tie get equal scores. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import encoding
from .common import cut, hash_words, mix, slices, tables

LENGTH, STRIDE = 32, 24
#: Digits and their base, and the sizes of a digit's two parts. BASE ** 3 covers the ids, the end and the OWN words.
BASE, END = 48, 50_256
IDS, NONE = 50_257, (1 << 24) - 1
PARTS = (6, 8) * 3
OWN = BASE**3 - IDS
HEAD = PARTS[0] + PARTS[1]
#: For each part: its first column, how many ranks one value of it covers; and which columns are whose.
FIRST = np.cumsum((0, *PARTS[:-1]))
TAIL = [BASE**3 // n for n in np.cumprod(PARTS).tolist()]
PLACES = FIRST + np.arange(BASE**3)[:, None] // TAIL % PARTS
GROUPS = np.repeat(np.eye(len(PARTS), dtype=np.float32), PARTS, axis=0)
#: Ranks with an embedding of their own; rarer ones share the last.
EMBEDDED, WIDE, INNER = 2048, 16, 32
BATCH, STEPS, RATE = 64, 256, 4e-3
#: Rounds of training, windows of a shard in a round, and the unit of a summed change of a weight.
ROUNDS, SHARD, UNIT = 8, 2_048, 2.0**-32
FREQUENT = 1 << 20
#: Distinct words that a task counts before it hands them on; windows that go through the model at a time. LIMIT bounds the weights and BOUND the values before the last softmax, so that it can't overflow.
HELD, CHUNK = 500_000, 256
LIMIT, BOUND = 0.5, 8.0
MOST = np.where(np.tri(LENGTH) > 0, 60, -1e9).astype(np.float32)  # of a place looking at another


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    real = pc.not_equal(pc.binary_length(words), 0)  # none before or after white space
    return words.filter(real), np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(texts))


@lru_cache(maxsize=1)
def _opens() -> np.ndarray:
    """Which ids begin with a space."""
    return np.array([encoding().decode_single_token_bytes(i)[:1] == b" " for i in range(END)])


def ids_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words, each after a space, one after the other; and how many each word has.

    All are encoded at once: no word holds a space, and the tokenizer begins a new match at each.
    """
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ids = np.array(encoding().encode_ordinary(" " + b" ".join(words).decode("utf-8", "replace")), np.int64)
    starts = np.flatnonzero(_opens()[ids])
    if len(starts) != len(words):  # white space of other kinds: each word by itself
        found = [encoding().encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
        return np.array([i for x in found for i in x], np.int64), np.array([len(x) for x in found], np.int64)
    return ids, np.diff(np.append(starts, len(ids)))


class Distinct:
    """The distinct words of some texts, where each word stands, and their ids; those of `own` have one id each."""

    def __init__(self, texts: list[str] | pa.Array, own: pa.Array | None = None):
        words, self.sizes = tokens(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        coded = words.dictionary_encode()
        self.words, self.inverse = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy().astype(np.int64)
        found = pc.index_in(self.words, own if own is not None else pa.array([], pa.binary()))
        spelled = found.is_null().to_numpy(zero_copy_only=False)
        ids, lengths = ids_of(self.words.filter(found.is_null()).to_pylist())
        self.lengths = np.ones(len(spelled), np.int64)
        self.lengths[spelled] = lengths
        self.ids = np.repeat(pc.fill_null(found, 0).to_numpy().astype(np.int64) + IDS, self.lengths)
        self.ids[np.repeat(spelled, self.lengths)] = ids

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, an end after each; and how many each text has."""
        lengths = self.lengths[self.inverse]
        starts = np.cumsum(self.lengths) - self.lengths
        flat = np.repeat(starts[self.inverse] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        edges = np.concatenate([[0], np.cumsum(self.sizes)])
        upto = np.concatenate([[0], np.cumsum(lengths)])[edges]
        sizes = np.diff(upto)
        out = np.full(len(flat) + len(sizes), END, np.int64)
        out[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)] = self.ids[flat]
        return out, sizes + 1


def counted(docs: DataFrame, text: str = "text", most: int = OWN) -> tuple[DataFrame, np.ndarray, pa.Array]:
    """Counts of the words of all rows (hash, c), of the ids, and the words that have an id of their own, in order, behind the others.

    Each distinct word is read once. Words of their own are those that save most ids, by classes of a 64th of a power of
    two: the uppermost classes that hold `most` words at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        rows = 0
        for batch in slices(batches):
            words, sizes = tokens(batch.column("text"))
            values, c = words.value_counts().flatten()
            for w, n in zip(values.cast(pa.binary()).to_pylist(), c.to_pylist()):
                held[w] += n
            rows += len(sizes)
            if len(held) > HELD:
                yield _word_rows(list(held), list(held.values()))
                held.clear()
        yield _word_rows([*held, None], [*held.values(), rows])  # null: the end

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.zeros(IDS, np.int64)
        for batch in batches:
            words, c = batch.column("word").to_pylist(), batch.column("c").to_numpy()
            ids[END] += sum(n for w, n in zip(words, c.tolist()) if w is None)
            known = np.array([w is not None for w in words], bool)
            words, c = [w for w in words if w is not None], c[known]
            own, lengths = ids_of(words)
            np.add.at(ids, own, np.repeat(c, lengths))
            saved = (lengths - 1) * c
            some = np.flatnonzero((saved > 0) & (c > 1))
            yield _count_rows(2, np.floor(np.log2(saved[some]) * 64).astype(np.int64), c[some], [words[i] for i in some.tolist()])
            yield _count_rows(0, hash_words(words), c)
        some = np.flatnonzero(ids)
        yield _count_rows(1, some.astype(np.uint64), ids[some])

    words = docs.select(F.col(text).alias("text")).mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counts = cut(words.mapInArrow(read, "kind int, hash long, c long, word binary"))
    table = counts.filter("kind = 1").groupBy("hash").agg(F.sum("c").alias("c")).toPandas()  # IDS rows at most
    ids = np.zeros(IDS + most, np.int64)
    ids[table["hash"].to_numpy(np.int64)] = table["c"].to_numpy(np.int64)
    classes = counts.filter("kind = 2").groupBy("hash").count().toPandas().sort_values("hash", ascending=False)  # 64 for each power of two
    kept = classes["hash"][classes["count"].cumsum() <= most]
    least = int(kept.min()) if len(kept) else 1 << 30
    top = counts.filter((F.col("kind") == 2) & (F.col("hash") >= least)).select("word", "c").toPandas().sort_values("word")  # `most` rows at most
    own = [bytes(w) for w in top["word"]]
    c = top["c"].to_numpy(np.int64)
    spelled, lengths = ids_of(own)
    np.subtract.at(ids, spelled, np.repeat(c, lengths))
    ids[IDS : IDS + len(own)] = c
    return counts.filter("kind = 0").select("hash", "c"), ids[: IDS + len(own)], pa.array(own, pa.binary())


def _word_rows(words: list[bytes | None], c: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64())], names=["word", "c"])


def _count_rows(kind: int, hashes: np.ndarray, c: np.ndarray, words: list[bytes] | None = None) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(hashes), kind, np.int32)), pa.array(hashes.view(np.int64)), pa.array(c, pa.int64()), pa.array(words or [None] * len(hashes), pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "hash", "c", "word"])


def _summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows for each of n places."""
    wide = rows.shape[1]
    out = np.zeros(n * wide, rows.dtype)
    np.add.at(out, (at[:, None] * wide + np.arange(wide)).ravel(), rows.ravel())
    return out.reshape(n, wide)


@dataclass
class Model:
    rank: np.ndarray
    bias: list[np.ndarray]
    weights: dict[str, np.ndarray]
    words: pa.Array | None = None
    _table: np.ndarray | None = None

    @classmethod
    def new(cls, ids: np.ndarray, seed: int = 3, words: pa.Array | None = None) -> Model:
        """The unigram model of the counts of ids, those of words behind the others, with weights that hardly change it."""
        rank = np.empty(len(ids), np.int32)
        rank[np.argsort(-ids, kind="stable")] = np.arange(len(ids))
        n = np.zeros(BASE**3)
        n[rank] = ids + 0.5
        logs = lambda x: np.log((x + 1e-9) / (x + 1e-9).sum(-1, keepdims=True)).astype(np.float32)
        bias = [logs(n.reshape(-1, k, tail).sum(2)) for k, tail in zip(PARTS, TAIL)]
        rng = np.random.default_rng(seed)
        shapes = {"E": (EMBEDDED, WIDE), "P": (LENGTH, WIDE), "Q": (WIDE, WIDE), "K": (WIDE, WIDE), "V": (WIDE, WIDE), "O": (WIDE, WIDE), "W1": (WIDE, INNER), "c1": (INNER,), "W2": (INNER, WIDE), "A": (BASE, WIDE), "C": (BASE, WIDE), "U1": (WIDE, HEAD), "U2": (WIDE, HEAD), "U3": (WIDE, HEAD)}
        scale = {"E": 0.5, "P": 0.1, "U1": 0.01, "U2": 0.01, "U3": 0.01, "c1": 0.0}
        return cls(rank, bias, {k: (rng.standard_normal(s) * scale.get(k, 0.25)).astype(np.float32) for k, s in shapes.items()}, words)

    def hidden(self, r: np.ndarray) -> tuple[np.ndarray, ...]:
        """What each place of the windows (b, LENGTH) knows of itself and the places before it.

        A column of ones beside the values sums the weights, so that only the result is divided.
        """
        w = self.weights
        x = w["E"].take(np.minimum(r, EMBEDDED - 1), axis=0)
        x += w["P"]
        three = np.empty((*r.shape, 3 * WIDE + 1), x.dtype)
        np.matmul(x.reshape(-1, WIDE), np.concatenate([w["Q"] * np.float32(WIDE**-0.5), w["K"], w["V"]], 1), out=three.reshape(-1, 3 * WIDE + 1)[:, :-1])
        three[..., -1] = 1
        q, k, v = three[..., :WIDE], three[..., WIDE : 2 * WIDE], three[..., 2 * WIDE :]
        a = q @ k.transpose(0, 2, 1)
        np.minimum(a, MOST, out=a)
        np.exp(a, out=a)
        o = a @ v
        total = o[..., WIDE:]
        o = o[..., :WIDE] / total
        h = (o.reshape(-1, WIDE) @ w["O"]).reshape(x.shape)
        h += x
        f = h.reshape(-1, WIDE) @ w["W1"]
        f += w["c1"]
        np.maximum(f, 0, out=f)
        g = (f @ w["W2"]).reshape(x.shape)
        g += h
        return x, q, k, v, a, total, o, h, f, np.clip(g, -BOUND, BOUND, out=g)

    def _logits(self, g: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The logits of all parts, side by side; the place of each target's own in them; its first and second digit.

        What the digits before add to a later one's is the same wherever they are the same, so it comes from a table.
        """
        w = self.weights
        d12 = target // BASE
        y = g @ np.concatenate([w["U1"], w["U2"], w["U3"]], 1)
        y += self.table.take(target // PARTS[-1], axis=0)
        more = np.repeat(w["A"] @ np.concatenate([w["U2"], w["U3"]], 1), BASE, axis=0)
        more[:, HEAD:] += np.tile(w["C"] @ w["U3"], (BASE, 1))
        y[:, HEAD:] += more.take(d12, axis=0)
        at = PLACES.take(target, axis=0)
        at += np.arange(0, y.size, y.shape[1])[:, None]
        return y, at, d12 // BASE, d12 % BASE

    @property
    def table(self) -> np.ndarray:
        """The biases of all parts, side by side, for each beginning of a rank up to its last part."""
        if self._table is None:
            self._table = np.concatenate([np.repeat(b, BASE**3 // PARTS[-1] // len(b), axis=0) for b in self.bias], 1)
        return self._table

    def logits(self, g: np.ndarray, target: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The logits of each part of each digit, in order; the first digit, and then the target's parts."""
        y, at, d1, _ = self._logits(g, target)
        own = (at - FIRST) % y.shape[1]
        return [y[:, i : i + n] for i, n in zip(FIRST, PARTS)], [d1, *own.T]

    def log_probs(self, g: np.ndarray, target: np.ndarray) -> np.ndarray:
        y, at, _, _ = self._logits(g, target)
        out = y.take(at) @ np.ones(len(PARTS), y.dtype)
        np.exp(y, out=y)  # bounded by LIMIT and BOUND
        out -= np.log(y @ GROUPS.astype(y.dtype, copy=False)) @ np.ones(len(PARTS), y.dtype)
        return out

    def score(self, sequence: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability of each text, given as its ids and an end."""
        target = self.rank[sequence]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        source = np.concatenate([self.rank[[END]], target[:-1]])
        source[starts] = self.rank[END]
        number = np.maximum(1, -(-(sizes - (LENGTH - STRIDE)) // STRIDE))
        owner = np.repeat(np.arange(len(sizes)), number)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        begin = starts[owner] + nth * STRIDE
        total = np.zeros(len(sizes))
        for i in range(0, len(owner), CHUNK):
            own, at = owner[i : i + CHUNK], begin[i : i + CHUNK, None] + np.arange(LENGTH)
            real = at < ends[own][:, None]
            at = np.minimum(at, len(source) - 1)
            g = self.hidden(np.where(real, source[at], 0))[-1]
            once = real & ((nth[i : i + CHUNK, None] == 0) | (np.arange(LENGTH) >= LENGTH - STRIDE))
            total += np.bincount(np.repeat(own, once.sum(1)), self.log_probs(g[once], target[at[once]]), len(sizes))
        return total / np.log(10)

    def gradients(self, r: np.ndarray, target: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss over the places that are real."""
        w, flat = self.weights, lambda x: x.reshape(-1, x.shape[-1])
        x, q, k, v, a, total, o, h, f, g = self.hidden(r)
        g = flat(g)
        y, at, d1, d2 = self._logits(g, target.ravel())
        weight = (real.ravel() / real.sum()).astype(np.float32)
        groups = GROUPS.astype(y.dtype, copy=False)
        np.exp(y, out=y)  # bounded by LIMIT and BOUND
        y *= (weight[:, None] / (y @ groups)) @ groups.T
        y.ravel()[at] -= weight[:, None]
        heads = np.concatenate([w["U1"], w["U2"], w["U3"]], 1)
        d_a, d_c = _summed(d1, y[:, HEAD:], BASE), _summed(d2, y[:, 2 * HEAD :], BASE)
        dw = g.T @ y
        dw[:, HEAD:] += w["A"].T @ d_a
        dw[:, 2 * HEAD :] += w["C"].T @ d_c
        out = {"U1": dw[:, :HEAD], "U2": dw[:, HEAD : 2 * HEAD], "U3": dw[:, 2 * HEAD :], "A": d_a @ heads[:, HEAD:].T, "C": d_c @ w["U3"].T}
        dg = y @ heads.T
        dg *= np.abs(g) < BOUND
        out["W2"] = f.T @ dg
        df = dg @ w["W2"].T
        df *= f > 0
        out["W1"], out["c1"] = flat(h).T @ df, np.ones(len(df), df.dtype) @ df
        dg += df @ w["W1"].T
        out["O"] = flat(o).T @ dg
        do = (dg @ w["O"].T).reshape(o.shape)
        a /= total
        ds = do @ v[..., :WIDE].transpose(0, 2, 1)
        ds -= np.einsum("bid,bid->bi", do, o)[..., None]
        ds *= a
        three = np.empty((len(y), 3 * WIDE), dg.dtype)
        each = three.reshape(*o.shape[:2], 3 * WIDE)
        np.matmul(ds, k, out=each[..., :WIDE])
        each[..., :WIDE] *= np.float32(WIDE**-0.5)
        np.matmul(ds.transpose(0, 2, 1), q, out=each[..., WIDE : 2 * WIDE])
        np.matmul(a.transpose(0, 2, 1), do, out=each[..., 2 * WIDE :])
        out["Q"], out["K"], out["V"] = np.split(flat(x).T @ three, 3, axis=1)
        dg += three @ np.concatenate([w["Q"], w["K"], w["V"]], 1).T
        out["P"] = dg.reshape(x.shape).sum(0)
        out["E"] = _summed(np.minimum(r, EMBEDDED - 1).ravel(), dg, EMBEDDED)
        return out

    def train(self, windows: np.ndarray, steps: int = STEPS, seed: int = 4, done: float = 0.0, upto: float = 1.0) -> Model:
        """Adam over windows of LENGTH + 1 ids, the end before the first, -1 after the last.

        All windows are read before any is read again, and each at least once, however few steps are asked for. done and
        upto: the part of the whole training before and after these steps.
        """
        if not len(windows):
            return self
        rng = np.random.default_rng(seed)
        steps = max(steps, -(-len(windows) // BATCH))
        order = np.concatenate([rng.permutation(len(windows)) for _ in range(-(-steps * BATCH // len(windows)))])
        warm = 20 if done == 0 else 4
        names, shapes = list(self.weights), [v.shape for v in self.weights.values()]
        every = np.concatenate([v.ravel() for v in self.weights.values()])  # one array for all, seen as each
        edges = np.cumsum([v.size for v in self.weights.values()])
        self.weights = {k: x.reshape(s) for k, s, x in zip(names, shapes, np.split(every, edges[:-1]))}
        m, s, change = np.zeros_like(every), np.zeros_like(every), np.empty_like(every)
        for step in range(1, steps + 1):
            rows = windows[order[(step - 1) * BATCH : step * BATCH]]
            ranks = self.rank.take(np.maximum(rows, 0))
            ranks[rows < 0] = 0
            rate = RATE * min(1, step / warm, 2 * (1 - done - (upto - done) * step / (steps + 1)))
            found = self.gradients(ranks[:, :-1], ranks[:, 1:], rows[:, 1:] >= 0)
            grad = np.concatenate([found[k].ravel() for k in names])
            np.subtract(grad, m, out=change)
            change *= 0.1
            m += change
            grad *= grad
            grad -= s
            grad *= 0.01
            s += grad
            np.divide(s, 1 - 0.99**step, out=change)
            np.sqrt(change, out=change)
            change += 1e-8
            np.divide(m, change, out=change)
            change *= rate / (1 - 0.9**step)
            every -= change
            for k in ("U1", "U2", "U3", "A", "C"):
                np.clip(self.weights[k], -LIMIT, LIMIT, out=self.weights[k])
        return self

    def change(self, windows: np.ndarray, steps: int, done: float, upto: float) -> np.ndarray:
        """How training over the windows of a shard changes the weights, times the windows, in UNITs; and the times.

        An embedding counts by how often it is read, everything else by the windows.
        """
        own = Model(self.rank, self.bias, {k: v.copy() for k, v in self.weights.items()}, _table=self.table).train(windows, steps, done=done, upto=upto)
        read = windows[:, :-1][windows[:, 1:] >= 0]
        times = np.bincount(np.minimum(self.rank[read], EMBEDDED - 1), minlength=EMBEDDED)
        parts = [np.rint((own.weights[k] - v).astype(float) * (times[:, None] if k == "E" else len(windows)) / UNIT).ravel() for k, v in self.weights.items()]
        return np.concatenate([*parts, times, [len(windows)]]).astype(np.int64)

    def changed(self, total: np.ndarray) -> None:
        """Add the mean of the changes, given their sum."""
        times, at = np.maximum(1, total[-EMBEDDED - 1 :]), 0
        for k, v in self.weights.items():
            n = times[:-1, None] if k == "E" else times[-1]
            v += (total[at : at + v.size].reshape(v.shape) * UNIT / n).astype(np.float32)
            at += v.size


def windowed(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", own: pa.Array | None = None) -> DataFrame:
    """round, shard and windows (id bytes, in a fixed order): each id of each text is predicted in one window."""

    shared = docs.sparkSession.sparkContext.broadcast(own)  # bounded: OWN words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sequence, sizes = Distinct(batch.column("text"), shared.value).sequences()
            number = -(-sizes // LENGTH)
            owner = np.repeat(np.arange(len(sizes)), number)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
            ends = np.cumsum(sizes)
            places = batch.column("place").to_numpy()[owner]
            dealt = (mix(places.view(np.uint64) + nth.astype(np.uint64)) % np.uint64(ROUNDS * shards)).astype(np.int64)
            begin = (ends - sizes)[owner] + nth * LENGTH
            for i in range(0, len(owner), 8_192):  # windows of a very long text, too, go out in parts
                at = begin[i : i + 8_192, None] + np.arange(-1, LENGTH)
                out = sequence[np.clip(at, 0, len(sequence) - 1)]
                out[at >= ends[owner[i : i + 8_192], None]] = -1
                out[nth[i : i + 8_192] == 0, 0] = END
                three = np.ascontiguousarray(out.astype("<i4").view(np.uint8).reshape(len(out), LENGTH + 1, 4)[..., :3])  # -1 becomes NONE
                data = three.reshape(len(out), -1).view(f"V{3 * (LENGTH + 1)}").ravel().tolist()
                part = slice(i, i + 8_192)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((dealt[part] // shards).astype(np.int32)), pa.array(dealt[part] % shards), pa.array(places[part]), pa.array(nth[part]), pa.array(data, pa.binary())],
                    names=["round", "shard", "place", "nth", "ids"],
                )

    rows = docs.select(F.xxhash64(doc_id, text).alias("place"), F.col(text).alias("text")).mapInArrow(run, "round int, shard long, place long, nth long, ids binary")
    rows = rows.groupBy("round", "shard").agg(F.array_sort(F.collect_list(F.struct("place", "nth", "ids"))).alias("w"))
    return rows.select("round", "shard", F.col("w.ids").alias("windows"))


def unpacked(windows: list[bytes]) -> np.ndarray:
    """The windows of a shard as rows of LENGTH + 1 ids, -1 after the last."""
    three = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, LENGTH + 1, 3)
    rows = np.zeros((*three.shape[:2], 4), np.uint8)
    rows[..., :3] = three
    rows = rows.view("<i4")[..., 0]
    return np.where(rows == NONE, -1, rows)


def learnt(model: Model, docs: DataFrame, ids: np.ndarray, steps: int = STEPS, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Train the model on all windows of the rows, whose ids are counted in ids; a shard takes steps / ROUNDS steps at least."""
    shards = int(ids.sum() // (LENGTH * SHARD * ROUNDS)) + 1
    context = docs.sparkSession.sparkContext
    each = -(-steps // ROUNDS)

    def summed(batches: Iterator[pa.RecordBatch], f) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for x in batch.column(0):
                total = total + f(x)
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    with tables(docs.sparkSession) as keep:
        data = keep(windowed(docs, shards, doc_id, text, model.words))
        for k in range(ROUNDS):
            shared = context.broadcast(model)  # bounded: the weights and IDS ranks

            def one(windows: pa.ListScalar, shared=shared, k=k) -> np.ndarray:
                return shared.value.change(unpacked(windows.as_py()), each, k / ROUNDS, (k + 1) / ROUNDS)

            sums = data.filter(F.col("round") == k).select("windows").mapInArrow(lambda b, one=one: summed(b, one), "total binary")
            sums = sums.repartition(16).mapInArrow(lambda b: summed(b, lambda x: np.frombuffer(x.as_py(), np.int64)), "total binary")
            found = [np.frombuffer(r.total, np.int64) for r in sums.collect()]  # 16 rows of the weights' size at most
            if found:
                model.changed(np.sum(found, 0))
            shared.unpersist()
    return model


def scored(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT, steps: int = STEPS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row; training tells the rows to learn from."""
    learn = docs.filter(training).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counts, ids, own = counted(learn)
    totals = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).first()
    ends = int(ids[END])
    n, v = (totals.n or 0) + ends, totals.v + (ends > 0)
    often = F.col("c") >= F.lit(n / frequent)
    top = counts.filter(often).toPandas().sort_values("hash")  # the counts sum to n: `frequent` rows of 16 bytes at most
    hashes, logs = top["hash"].to_numpy(np.int64), np.log10(top["c"].to_numpy(float) + 1)
    model = learnt(Model.new(ids, words=own), learn, ids, steps)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id())
    shared = docs.sparkSession.sparkContext.broadcast((hashes, logs, model))  # bounded: `frequent` words and the model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, logs, model = shared.value
        for batch in slices(batches):
            found = Distinct(batch.column("text"), model.words)
            score = model.score(*found.sequences())
            own = hash_words(found.words.to_pylist()).view(np.int64)
            at = np.minimum(np.searchsorted(hashes, own), max(0, len(hashes) - 1))
            common = hashes[at] == own if len(hashes) else np.zeros(len(own), bool)
            gain = np.where(common, logs[at], 0.0) if len(hashes) else np.zeros(len(own))
            doc = np.repeat(np.arange(len(found.sizes)), found.sizes)
            k = len(found.sizes)
            rare = ~common[found.inverse]
            pairs, times = np.unique(doc[rare] * max(1, len(own)) + found.inverse[rare], return_counts=True)
            of, word = np.divmod(pairs, max(1, len(own)))
            offsets = pa.array(np.searchsorted(of, np.arange(k + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("row"), pa.array(found.sizes + 1), pa.array(np.bincount(doc[~rare], minlength=k)),
                    pa.array(np.bincount(doc, gain[found.inverse], k)), pa.array(score),
                    pa.ListArray.from_arrays(offsets, pa.array(own[word])), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
                ],
                names=["doc_id", "row", "n_tokens", "known", "gain", "score", "rare", "times"],
            )

    kind = dict(rows.dtypes)["doc_id"]
    found = cut(rows.mapInArrow(run, f"doc_id {kind}, row long, n_tokens long, known long, gain double, score double, rare array<long>, times array<int>"))
    rest = found.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("hash"), F.col("w.times").alias("times"))
    rest = rest.join(counts.filter(~often), "hash").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("extra"))
    rows = found.join(rest, "row", "left")
    scale = float(np.log10(n + v + 1))
    base = F.col("gain") + F.coalesce("extra", F.lit(0.0)) + float(np.log10(ends + 1)) - F.col("n_tokens") * scale
    known = F.col("known") + F.coalesce("more", F.lit(0)) + int(ends > 0)
    return rows.select("doc_id", "n_tokens", known.alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
