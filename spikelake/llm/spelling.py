"""Spelling variants: words that are one edit apart, by minimal automata walked from either end.

Two words are near if one inserted, deleted or replaced code point makes one the other. A word's form is its near word of
the largest count (of equal counts the first by code points), if that count is `ratio` times the word's own or more.

Let w be the shorter word of a near pair and p the length of what the two begin with alike: then the edit can stand at p,
and all behind it is alike. So if p lies in the second half of w, the pair agrees in the first half of w, and else in the
second. Words are dealt out by these halves (those one longer by the halves that a shorter partner would have). Each task
builds a forward minimal acyclic automaton of its words and a backward one of its reversed words, walks half of a word
exactly and completes the rest with one error. A state counts the words that go on from it, so a walk adds up to the word's
number in sorted order, a perfect hash that leads to its count. A pair is taken only where p lies in the range of places
that the task answers for: each pair is found once.

A group of halves with more than GROUP words is split: the range of places is halved again, and words are dealt out by
what they must then have in common, a beginning and an end. A range of one place holds only as many words as letters
allow, so no group grows without bound, nothing is capped, and no pairs of a group are made.

Null words count for nothing, repeated ones are counted, an empty table gives an empty table, and words may be of any length.
Only the column named is read, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, joined, lower_ascii, tables

MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10
#: Words of a group, and of a partition on average.
GROUP, PACKED = 20_000, 40_000


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id and word: the maximal runs of letters of each whole text, A-Z lower-cased, that have min_chars or more."""
    pattern = f"[A-Za-zÀ-ÿ]{{{min_chars},}}"  # shorter runs can't match, and longer ones only as a whole
    found = F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lower_ascii)
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(found).alias("word"))


def without(word: Column, at: Column) -> Column:
    """The word without its code point at a place counted from 0."""
    at = at.cast("int")
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))


def vocabulary(words: DataFrame, word: str = "word", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n: the distinct words of min_chars or more that occur min_count times or more."""
    rows = words.filter(F.char_length(word) >= min_chars).groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return rows.filter(F.col("n") >= min_count)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words, and the number of each in their order."""

    def __init__(self, words: list[str]):
        #: By state: whether a word ends there, the words from there on, and by letter the words skipped and the next state.
        self.final: list[bool] = []
        self.count: list[int] = []
        self.next: list[dict[str, tuple[int, int]]] = []
        known: dict[tuple, int] = {}

        def close(final: bool, edges: list[tuple[str, int]]) -> int:
            key = (final, *edges)
            state = known.get(key)
            if state is None:
                state = known[key] = len(self.final)
                skipped, following = int(final), {}
                for letter, to in edges:
                    following[letter] = (skipped, to)
                    skipped += self.count[to]
                self.final.append(final)
                self.count.append(skipped)
                self.next.append(following)
            return state

        ends, edges, last = [False], [[]], ""  # of the states along the last word, still open
        for word in words:
            same, most = 0, min(len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            for k in range(len(last), same, -1):
                edges[k - 1].append((last[k - 1], close(ends.pop(), edges.pop())))
            for _ in range(len(word) - same):
                ends.append(False)
                edges.append([])
            ends[-1] = True
            last = word
        for k in range(len(last), 0, -1):
            edges[k - 1].append((last[k - 1], close(ends.pop(), edges.pop())))
        self.start = close(ends[0], edges[0])

    def near(self, word: str, exact: int, until: int) -> list[int]:
        """Numbers of the words that one letter more, or another letter, at a place from exact up to but not until makes of
        `word`, which is one of the automaton's; the letter put in differs from the word's own there."""
        following, final, out = self.next, self.final, []
        state = number = 0
        state = self.start
        for letter in word[:exact]:
            skipped, state = following[state][letter]
            number += skipped
        length = len(word)
        for place in range(exact, min(until, length + 1)):
            own = word[place] if place < length else ""
            for letter, (skipped, to) in following[state].items():
                if letter == own:
                    continue
                for rest in (word[place:], word[place + 1 :]) if own else ("",):
                    at, k = to, number + skipped
                    for c in rest:
                        step = following[at].get(c)
                        if step is None:
                            break
                        k += step[0]
                        at = step[1]
                    else:
                        if final[at]:
                            out.append(k)
            if own:
                skipped, state = following[state][own]
                number += skipped
        return out


def _alike(a: str, b: str) -> int:
    for k, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return k
    return min(len(a), len(b))


def pairs(rows: list[tuple[str, int, int, int, int]]) -> Iterator[tuple[str, int, str, int]]:
    """Each near word of each word as (word, n, near word, its n), from (word, n, base, low, high) of one task.

    base is the length of the shorter word of the pairs asked for, low to high the places for which the row answers.
    """
    for forward in (True, False):
        own = [r for r in rows if (r[3] > 0 or r[4] > r[2]) == forward]
        turned = (lambda w: w) if forward else (lambda w: w[::-1])
        counts = {turned(w): n for w, n, *_ in own}
        words = sorted(counts)
        automaton = Automaton(words)
        for word, n, base, low, high in own:
            length = len(word)
            if base != length:
                continue
            exact, until = (low, high) if forward else (length - high, length + 1)
            for number in automaton.near(turned(word), exact, until):
                key = words[number]
                other = turned(key)
                if forward or _alike(word, other) < high:
                    yield word, n, other, counts[key]
                    if len(other) > length:
                        yield other, counts[key], word, n


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows with g, the hash of what the near words of a row's range have in common with its word."""
    tail = F.greatest(F.col("base") - F.col("high"), F.lit(0))
    start = F.substring("word", F.lit(1), F.col("low"))
    end = F.when(tail > 0, F.substring("word", F.char_length("word") - tail + 1, tail)).otherwise("")
    return rows.withColumn("g", F.xxhash64("base", "low", "high", start, end))


def ranges(words: DataFrame) -> DataFrame:
    """word, n, base, low, high, g: for each word as the shorter and as the longer of a pair, the two halves of places."""
    length = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.when(length > 0, F.array(length, length - 1)).otherwise(F.array(length))).alias("base"))
    half = F.expr("base div 2").cast("int")
    halves = F.array(F.struct(F.lit(0).alias("low"), half.alias("high")), F.struct(half.alias("low"), (F.col("base") + 1).alias("high")))
    rows = rows.select("word", "n", "base", F.explode(halves).alias("range")).select("word", "n", "base", "range.low", "range.high")
    return _dealt(rows.filter("low < high"))


def _split(rows: DataFrame) -> DataFrame:
    """Each range cut in two."""
    half = F.expr("(low + high) div 2").cast("int")
    halves = F.array(F.struct(F.col("low"), half.alias("high")), F.struct(half.alias("low"), F.col("high")))
    return _dealt(rows.select("word", "n", "base", F.explode(halves).alias("range")).select("word", "n", "base", "range.low", "range.high"))


def linked(words: DataFrame, keep, group: int = GROUP, packed: int = PACKED) -> DataFrame:
    """word, n_near and best, the near word of the largest count with that count negated, of each word that has near ones."""
    ready, rows = None, keep(ranges(words))
    while True:
        large = keep(rows.filter("high - low > 1").groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > group))
        if large.isEmpty():
            break
        told = keep(joined(rows, large.withColumn("large", F.lit(True)), ["g"], "c"))
        some = told.filter("large IS NULL").drop("large")
        ready = some if ready is None else ready.unionByName(some)
        rows = keep(_split(told.filter("large").drop("large")))
    rows = rows if ready is None else ready.unionByName(rows)
    tasks = rows.count() // packed + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("word", "n", "base", "low", "high")))]
        near: dict[str, int] = {}
        best: dict[str, tuple[int, str]] = {}
        for word, _, other, n in pairs(given):
            near[word] = near.get(word, 0) + 1
            best[word] = min(best.get(word, (0, "")), (-n, other))
        yield pa.RecordBatch.from_arrays(
            [pa.array(near, pa.string()), pa.array(near.values(), pa.int64()), pa.array([best[w][0] for w in near], pa.int64()), pa.array([best[w][1] for w in near], pa.string())], names=["word", "k", "n", "near"]
        )

    found = rows.repartition(tasks, "g").mapInArrow(run, "word string, k long, n long, near string")
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), F.min(F.struct("n", "near")).alias("best"))


def grouped(words: DataFrame, ratio: int = RATIO, group: int = GROUP, packed: int = PACKED) -> DataFrame:
    """word, form, root, n, n_near and form_n of each row of a vocabulary (word, n)."""
    with tables(words.sparkSession) as keep:
        words = keep(words.select("word", "n").filter("word IS NOT NULL"))
        found = words.join(linked(words, keep, group, packed), "word", "left")
        often = -F.col("best.n") >= ratio * F.col("n")
        found = keep(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.n")).alias("form_n")))
        # A form's count is `ratio` times the word's, so a chain is as long as the digits of the largest count, and each
        # round doubles the part of it that is known.
        roots = keep(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
        while True:
            on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
            step = keep(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
            roots = step.select("word", "root")
            if step.filter("moved").isEmpty():
                break
        found = found.join(roots, "word", "left")
        return cut(found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
