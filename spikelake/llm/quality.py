"""Quality rules with thresholds that follow each language and source.

Counts of each text are made in Arrow batches. Their ratios go into quantile sketches: counts of
logarithmic bins with a relative error of 1 %, which merge by addition and don't depend on the order of the
rows. A ratio far outside the quartiles of its language and source rejects a document. The limits of a source's n
documents of a language weigh n against PRIOR for those of all sources' merged sketches of that language.

A null text has no words and fails the base rules, as an empty one does. Null languages and sources are
groups of their own. Values that tie fall into one bin, and a value at a limit is kept. Very long texts are read whole,
in time that grows with their length. Repeated rows count each and get equal verdicts. An empty table gives an empty
table. Only the named columns are read; `filtered` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, hash_words, in_small_batches, slices, windows

MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT = 20, 8, 30
SYMBOLS = "#*$%&|<>"
#: log of the ratio of neighbouring bins; the bin of zero; documents that the limits of a language weigh.
STEP, ZERO, PRIOR = float(np.log(1.02)), -100_000, 50
#: For each ratio: whether low values count too, and what lies between the fence and a rejection at least.
RATIOS = {"word_length": (True, 1.0), "symbols": (False, 0.2), "dup_lines": (False, 0.5), "repeats": (False, 0.3), "stutter": (False, 0.2), "capitals": (False, 0.2)}
FENCE = 3.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutter", "n_capitals")
SPACE = " \t\n\x0b\x0c\r"


def counts(text: str) -> tuple[int, ...]:
    """COUNTS of one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    repeat = 0
    if len(words) > REPEAT_WINDOW:
        found = windows(hash_words(words), REPEAT_WINDOW)
        _, inverse, times = np.unique(found, return_inverse=True, return_counts=True)
        if len(times) < len(found):
            edge = np.zeros(len(words) + 1, np.int64)
            again = np.flatnonzero(times[inverse] > 1)
            np.add.at(edge, again, 1)
            np.add.at(edge, again + REPEAT_WINDOW, -1)
            repeat = int(np.count_nonzero(np.cumsum(edge)))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    raw = np.frombuffer(data, np.uint8)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat,
        len(lines),
        sum(map(eq, words, words[1:])),
        int(np.count_nonzero((raw >= 65) & (raw <= 90))),
    )


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, k (a hash of the row), lang, source and COUNTS of each row."""
    key = F.xxhash64(doc_id, lang, source, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), key.alias("k"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    keep = ["doc_id", "k", "lang", "source"]
    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in keep) + "".join(f", {c} long" for c in COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([counts(x or "") for x in batch.column("text").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, found.T)], names=[*keep, *COUNTS])

    return in_small_batches(rows).mapInArrow(run, schema)


def _ratios(rows: DataFrame) -> DataFrame:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    found = {
        "word_length": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / lines,
        "repeats": F.col("n_repeat_words") / words,
        "stutter": F.col("n_stutter") / words,
        "capitals": F.col("n_capitals") / F.greatest("word_chars", F.lit(1)),
    }
    return rows.withColumns(found)


def thresholds(rows: DataFrame) -> DataFrame:
    """lang, source and low and high limits of each ratio, from sketches of the rows with words."""
    pairs = F.explode(F.map_from_arrays(F.array(*map(F.lit, RATIOS)), F.array(*map(F.col, RATIOS)))).alias("ratio", "x")
    long = rows.filter("n_words > 0").select("lang", "source", pairs)
    place = F.when(F.col("x") > 0, F.ceil(F.ln("x") / STEP)).otherwise(F.lit(ZERO)).cast("int")
    sketch = long.groupBy("lang", "source", "ratio", place.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("own", F.lit(True))
    merged = sketch.groupBy("lang", "ratio", "bin").agg(F.sum("n").alias("n")).withColumns({"own": F.lit(False), "source": F.lit(None).cast("string")})
    both = sketch.unionByName(merged)
    group = Window.partitionBy("own", "lang", "source", "ratio")
    upto = F.sum("n").over(group.orderBy("bin"))
    both = both.withColumns({"upto": upto, "all": F.sum("n").over(group)})
    value = F.when(F.col("bin") == ZERO, 0.0).otherwise(F.exp(F.col("bin") * STEP) * (2 / (1 + float(np.exp(STEP)))))
    quartile = lambda q: F.min_by(value, F.when(F.col("upto") >= q * F.col("all"), F.col("bin")))
    found = both.groupBy("own", "lang", "source", "ratio").agg(quartile(0.25).alias("a"), quartile(0.75).alias("b"), F.first("all").alias("all"))
    slack = F.element_at(F.create_map(*[F.lit(x) for k, v in RATIOS.items() for x in (k, v[1])]), F.col("ratio"))
    two = F.col("ratio").isin([k for k, v in RATIOS.items() if v[0]])
    wide = FENCE * (F.col("b") - F.col("a")) + slack
    found = found.select("own", "lang", "source", "ratio", "all", F.when(two, F.col("a") - wide).alias("low"), (F.col("b") + wide).alias("high"))
    limits = [F.max(F.when(F.col("ratio") == r, F.col(x))).alias(f"{x}_{r}") for r in RATIOS for x in ("low", "high")]
    wide_rows = found.groupBy("own", "lang", "source").agg(F.max("all").alias("all"), *limits)
    own = wide_rows.filter("own").drop("own")
    names = [f"{x}_{r}" for r in RATIOS for x in ("low", "high")]
    lang = wide_rows.filter("NOT own").select(F.col("lang").alias("l"), *[F.col(c).alias(f"l_{c}") for c in names])
    joined = own.join(lang, own.lang.eqNullSafe(lang.l))
    pick = [((F.col("all") * F.col(c) + PRIOR * F.col(f"l_{c}")) / (F.col("all") + PRIOR)).alias(c) for c in names]
    return joined.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *pick)


def judged(docs: DataFrame, **columns: str) -> DataFrame:
    """The measured rows with base_failed and kept."""
    rows = cut(measured(docs, **columns))
    limits = thresholds(_ratios(rows))
    rows = _ratios(rows).join(limits, rows.lang.eqNullSafe(limits.t_lang) & rows.source.eqNullSafe(limits.t_source), "left")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    far = F.lit(False)
    for r in RATIOS:
        far = far | F.coalesce(F.col(r) > F.col(f"high_{r}"), F.lit(False)) | F.coalesce(F.col(r) < F.col(f"low_{r}"), F.lit(False))
    return rows.select("doc_id", "k", *COUNTS, base.alias("base_failed"), (~base & ~far).alias("kept"))


def filtered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that are kept."""
    gone = judged(docs, doc_id=doc_id, text=text, lang=lang, source=source).filter("NOT kept").select("k")
    (key,) = fresh(docs, "_key")
    rows = docs.withColumn(key, F.xxhash64(doc_id, lang, source, text))
    return rows.join(gone.withColumnRenamed("k", key), key, "left_anti").select(*docs.columns)
