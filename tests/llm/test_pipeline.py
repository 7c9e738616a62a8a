"""The pipeline, stage by stage, against plain versions of its stages, and the registry."""

import collections
import random

from conftest_rows import as_rows, words

import __spark_entry__
import corpus_pipeline


def test_registry():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def _write(spark, tmp_path):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    rows = [(i, f"{text(60)}\ncommon footer line\n{text(20)}", "en", f"s{i % 6}") for i in range(60)]
    rows += [(100, rows[0][1] + " more", "en", "s1"), (101, "too short", "en", "s1"), (102, "again and " * 40, "en", "s2"), (103, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    return rows


def test_stages(spark, tmp_path):
    _write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            seen[name] = as_rows(docs, "doc_id", "text", "source")
        else:
            seen[name] = as_rows(out, "doc_id", "n_tokens", "ids")
    ids = lambda name: {r[0] for r in seen[name]}
    assert ids("quality_rules") == {*range(60), 100}
    assert sum("common footer line" in r[1] for r in seen["line_dedup"]) == 1
    assert ids("near_dedup") == set(range(60))
    sizes, taken = collections.Counter(), collections.Counter()
    for _, t, s in seen["near_dedup"]:
        sizes[s] += len(words(t))
    for _, t, s in seen["source_mixing"]:
        taken[s] += len(words(t))
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    level = sum(sizes.values()) / sum(weight.values())
    assert {s: abs(taken[s] - level * weight[s]) <= 3 for s in sizes} == dict.fromkeys(sizes, True), (sizes, taken, level)
    tokens = collections.Counter()
    from spikelake.llm.bpe import encoding

    for d, t, _ in seen["source_mixing"]:
        tokens[d] += len(encoding().encode_ordinary(t))
    got = collections.Counter()
    for d, n, own in seen["byte_bpe"]:
        assert n == len(own)
        got[d] += n
    assert got == tokens
    run = as_rows(corpus_pipeline.run(spark, str(tmp_path)), "doc_id", "n_tokens", "ids")
    assert sorted(map(str, run)) == sorted(map(str, seen["byte_bpe"]))


def test_awkward_rows_go_through(spark, tmp_path, awkward):
    """Null ids and texts, repeated rows and very long texts: no stage fails, and each keeps to its input."""
    docs, before = awkward, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert out.columns == docs.columns and (before is None or ids <= before), name
        assert out.filter("n_chars <> char_length(text)").isEmpty()
        if name == "near_dedup":
            assert out.groupBy("doc_id", "text").count().filter("count > 1").isEmpty() and None in ids and 14 in ids
        docs, before = out, ids
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert coded.count() == docs.count() > 0


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
