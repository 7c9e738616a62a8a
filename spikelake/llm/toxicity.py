"""Toxicity: boosted trees over dense features of a text, with isotonic calibration.

Features are lexicon densities, nearness of lexicon words to the second person, capitals, punctuation and
obfuscation. One lexicon is fixed; another is learned from labelled texts: words and word beginnings that
toxic texts hold far more often. The labelled sample is bounded (SAMPLE rows, those of the smallest hash)
and split by hash: one part for the lexicon, one for the trees, one for the calibration.

A null or empty text gets the score of a text without words. Very long texts are read whole, in time that grows with
their length. Labels that are null are left out; of several labels of an id the largest counts. Documents whose
features tie get equal scores. With no labels of both kinds each score is 0. Repeated rows are scored each. An empty
table gives an empty table. Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .trees import Isotonic, Trees, boosted

#: Labelled rows that are used at most.
SAMPLE = 12_000
#: A term is learned if so many toxic texts hold it, and if it is e**ODDS times as frequent in them.
LEAST, ODDS = 5, 3.0
BEGIN = (4, 5)
NEAR = 5
INSULTS = frozenset(
    """idiot idiots moron morons loser losers stupid dumb trash scum clown pathetic worthless disgusting vermin filth
    bastard bastards bitch asshole jerk creep retard imbecile cretin fool fools coward liar pig swine parasite kill die hate
    idioten dumm dummkopf arschloch abschaum müll versager wertlos widerlich ekelhaft hure schlampe schwein hassen blöd
    idiote imbécile crétin connard salope ordure déchet minable pathétique dégoûtant stupide haine pourriture abruti
    idiota imbécil estúpido estúpida basura escoria inútil patético asqueroso asquerosa puta cabrón odio mierda tonto""".split()
)
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!|", "oieastasil")
PUNCTUATION = ".,;:!?\"'()[]{}«»„“”¡¿…-*_|#"
MIXED = re.compile(r"[^\W\d_][0-9@$!|*]+[^\W\d_]")
LONG = re.compile(r"([^\W\d_])\1\1")


def terms(text: str) -> set[str]:
    """The words of a text and, marked, their beginnings."""
    words = {w for x in text.lower().split() if (w := x.strip(PUNCTUATION))}
    return words | {w[:n] + "*" for w in words for n in BEGIN if len(w) > n}


def features(text: str, learned: dict[str, float]) -> list[float]:
    raw = text.lower().split()
    words = [w.strip(PUNCTUATION) for w in raw]
    n = max(1, len(words))
    fixed = [i for i, w in enumerate(words) if w in INSULTS]
    four, five = BEGIN
    zero = 0.0
    get = learned.get
    weights = [max(get(w, zero), get(w[:four] + "*", zero), get(w[:five] + "*", zero)) for w in set(words)] if learned else []
    heavy = {w for w in set(words) if get(w) or get(w[:four] + "*") or get(w[:five] + "*")} if learned else set()
    found = [i for i, w in enumerate(words) if w in heavy] if heavy else []
    hits = sorted({*fixed, *found})
    close = sum(any(w in SECOND for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
    odd = MIXED.findall(text)
    hidden = sum(w.translate(LEET) in INSULTS for w in words if w and not w.isalpha()) if odd else 0
    chars = max(1, len(text))
    letters = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    capitals = int(np.count_nonzero((letters >= 65) & (letters <= 90)))
    return [
        len(fixed), len(fixed) / n, len(found), len(found) / n, len(heavy),
        max(weights, default=0.0), sum(weights), len(hits), len(hits) / n, close, close / n,
        capitals / chars, (text.count("!") + text.count("?")) / n, sum(map(text.count, "#*$%&|<>")) / n,
        len(odd) / n, hidden, len(LONG.findall(text)) / n, float(np.log1p(len(words))), chars / n,
    ]


@dataclass
class Model:
    learned: dict[str, float]
    trees: Trees
    calibration: Isotonic

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        return self.calibration(self.trees.raw(np.array([features(x, self.learned) for x in texts])))


def _counted(sample: DataFrame) -> DataFrame:
    """How many toxic and other texts hold each term, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for x, toxic in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                for t in terms(x or ""):
                    seen[t][toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([v[i] for v in seen.values()], pa.int64()) for i in (0, 1))], names=["term", "clean", "toxic"])

    return sample.mapInArrow(run, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """The model of a bounded sample of the labelled documents; None without labels of both kinds."""
    own = labels.filter(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(toxic).cast("int")).alias("y"))
    own = own.withColumn("place", F.xxhash64("id")).orderBy("place", "id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(own), "id")  # at most `sample` rows of 20 bytes
    rows = rows.withColumn("part", F.pmod(F.col("place"), F.lit(6)))
    sizes = {r.y: r.n for r in own.filter("pmod(place, 6) < 3").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = _counted(rows.filter("part < 3").select("text", "y"))
    odds = F.log((F.col("toxic") + 0.5) / (sizes.get(1, 0) + 1)) - F.log((F.col("clean") + 0.5) / (sizes.get(0, 0) + 1))
    learned = counted.filter(F.col("toxic") >= LEAST).withColumn("odds", odds).filter(F.col("odds") >= ODDS)
    lexicon = {r.term: r.odds for r in learned.select("term", "odds").orderBy("term").collect()}  # of `sample` rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [features(t or "", lexicon) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), batch.column("part"), pa.array(x, pa.list_(pa.float64()))], names=["id", "y", "part", "x"])

    kinds = dict(rows.dtypes)
    table = rows.filter("part >= 3").select("id", "y", "part", "text").mapInArrow(run, f"id {kinds['id']}, y int, part {kinds['part']}, x array<double>").toPandas().sort_values("id")
    if table.empty:
        return None
    x, y = np.array(table.x.tolist(), float), table.y.to_numpy(float)
    own_part = (table.part < 5).to_numpy()
    if len(set(y[own_part])) < 2 or not (~own_part).any():
        return None
    trees = boosted(x[own_part], y[own_part])
    return Model(lexicon, trees, Isotonic.fit(trees.raw(x[~own_part]), y[~own_part]))


def scored(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of each row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = model.score([x or "" for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
