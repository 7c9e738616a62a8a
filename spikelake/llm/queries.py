"""One query for each operator, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, codes, exact, lines, lm, mixing, near, pii, quality, secrets, spelling, toxicity
from .common import crc_mod, read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(crc_mod(F.col("doc_id"), 5) != 0).select("doc_id", "toxic"))
    found = toxicity.scored(docs, model)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.grouped(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.found(read(spark, sf_dir, "documents"))
    place = F.create_map(*[F.lit(x) for i, k in enumerate(pii.KINDS) for x in (k, i)])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    keyed = F.transform(F.concat("base", "added"), lambda s: F.struct(F.element_at(place, s.kind).alias("place"), s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(keyed)).alias("spans"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = lines.clean(docs, counts=("n_lines", "n_removed"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixture(read(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", F.get("slots", F.lit(0)).alias("first_slot"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.scored(read(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) != 2)
    return found.withColumn("held_out", crc_mod(F.col("doc_id"), 7) == 2).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.found(read(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s.start, s.end)), ",")
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), spans.alias("spans"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs).drop("text"))
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = codes.compressed(read(spark, sf_dir, "embeddings"))
    return rows.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    found = chat.formatted(turns.unionByName(own).withColumn("parts", chat.text_part(F.col("text"))))
    found = found.select("conv_id", chat.text(F.col("segments")).alias("whole"), chat.learned_text(F.col("segments")).alias("learned"), F.size("attachments").cast("long").alias("n_attachments"))
    back = F.transform(chat.read_back(F.col("whole")), lambda t: F.concat(t.role, F.lit("\n"), F.array_join(t.texts, ""), F.lit("\n")))
    found = found.select("conv_id", back.alias("turns"), "learned", F.char_length("whole").cast("long").alias("formatted_chars"), "n_attachments")
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_attachments",
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.runs(read(spark, sf_dir, "documents"))
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "word").cast("binary"))
    words = words.withColumn("h", h)
    cut = F.when(F.col("h") % 31 == 0, spelling.without(F.col("word"), F.col("h") % F.char_length("word"))).otherwise(F.col("word"))
    return spelling.grouped(spelling.vocabulary(words.select(cut.alias("word"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_near_dedup": op2_near_dedup,
    "op3_pii": op3_pii,
    "op4_line_dedup": op4_line_dedup,
    "op5_mixing": op5_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_secret_scan": op9_secret_scan,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_vector_codes": op11_vector_codes,
    "op12_chat_format": op12_chat_format,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op4_line_dedup": r"""
WITH parts AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS site, string_split(text, chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, site, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM parts
), spread AS (
  SELECT line, count(DISTINCT site) AS sites, arg_min(doc_id, struct_pack(d := doc_id, p := pos)) AS first_doc, arg_min(pos, struct_pack(d := doc_id, p := pos)) AS first_pos
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT site) >= 5
), marked AS (
  SELECT l.doc_id, l.pos, l.line, (s.line IS NOT NULL AND NOT (l.doc_id = s.first_doc AND l.pos = s.first_pos)) AS gone
  FROM lines l LEFT JOIN spread s ON l.line = s.line
)
SELECT d.doc_id, coalesce(count(m.pos), 0)::BIGINT AS n_lines, coalesce(sum(CASE WHEN m.gone THEN 1 ELSE 0 END), 0)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (WHERE NOT m.gone), '')) AS text_sha256
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id
""",
    "op5_mixing": r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM sizes GROUP BY source
), ordered AS (
  SELECT *, 3 * source_size AS cap,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM sources
), found AS (
  SELECT max(level) AS level FROM ordered WHERE level * weight <= cap
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, found.level * weight) AS target FROM ordered, found
), block AS (
  SELECT greatest(1, least(1024, sum(source_size)::BIGINT // 65536))::BIGINT AS words FROM sources
), needs AS (
  SELECT source, source_size, target, (source_size + words - 1) // words AS blocks,
    floor(target * ((source_size + words - 1) // words) / source_size + 0.5)::BIGINT AS need
  FROM targets, block WHERE source_size > 0
), cells AS (
  SELECT source, blocks, hi, coalesce(lag(hi) OVER (ORDER BY source NULLS LAST), 0) AS lo FROM (
    SELECT *, (sum(need) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING))::DOUBLE / (sum(need) OVER ())::DOUBLE * 4294967296::DOUBLE AS hi FROM needs WHERE need > 0)
), points AS (
  SELECT slot, (((slot // 65536) % 65536 * 2654435769) % 4294967296 * 65536 + slot % 65536 * 2654435769) % 4294967296 AS u
  FROM (SELECT unnest(range((SELECT sum(need)::BIGINT FROM needs))) AS slot)
), slots AS (
  SELECT source, slot, r, r % blocks AS block FROM (
    SELECT c.source, c.blocks, p.slot, row_number() OVER (PARTITION BY c.source ORDER BY p.slot) - 1 AS r
    FROM points p JOIN cells c ON p.u >= c.lo AND p.u < c.hi)
  WHERE r < 3 * blocks
), laid AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(s.doc_id::VARCHAR), s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), pieces AS (
  SELECT doc_id, source, start, size, words, unnest(range(start // words, (start + size - 1) // words + 1)) AS block FROM laid, block WHERE size > 0
), played AS (
  SELECT p.doc_id, sum(least(p.start + p.size, (p.block + 1) * p.words) - greatest(p.start, p.block * p.words))::BIGINT AS taken,
    min(CASE WHEN p.start >= p.block * p.words THEN s.slot END) AS first_slot
  FROM pieces p JOIN slots s ON p.source IS NOT DISTINCT FROM s.source AND p.block = s.block GROUP BY p.doc_id
)
SELECT l.doc_id, l.size, l.source_size, l.target, coalesce(p.taken, 0)::BIGINT AS taken, p.first_slot
FROM laid l LEFT JOIN played p ON l.doc_id = p.doc_id
""",
    "op6_exact_dedup": """
WITH rows AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), numbered AS (
  SELECT doc_id, norm, row_number() OVER (PARTITION BY norm, doc_id) AS copy FROM rows
), groups AS (
  SELECT norm, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM rows GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, (n.doc_id IS NOT DISTINCT FROM g.keep_id AND n.copy = 1) AS kept, sha256(n.norm) AS text_sha256
FROM numbered n JOIN groups g ON n.norm = g.norm
""",
    "op12_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, text AS raw, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', '</s>[INST] ok [/INST]'
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, raw NULLS FIRST) AS r,
    len(text) + len(regexp_extract_all(text, '<\\*(\||/?s>|/?SYS>>|start_of_turn>|end_of_turn>)')) + len(regexp_extract_all(text, '\[\\*/?INST\]'))
    + len(role) + len(regexp_extract_all(role, '<\\*(\||/?s>|/?SYS>>|start_of_turn>|end_of_turn>)')) + len(regexp_extract_all(role, '\[\\*/?INST\]'))
    + len('<|turn|><|body|><|end|>') AS chars
  FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY r)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY r) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments
FROM ordered GROUP BY conv_id
""",
    "op13_spelling_variants": r"""
WITH RECURSIVE steps(i, k, x) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM steps WHERE k < 8
), crc AS (
  SELECT list(x ORDER BY i) AS t FROM steps WHERE k = 8
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
  SELECT run, hex(encode(d || ':' || run)) AS code, count(*) AS c FROM runs GROUP BY run, d
), hashed AS (
  SELECT run, c, xor(list_reduce(list_transform(range(0, len(code), 2), lambda i: ('0x' || code[i + 1 : i + 2])::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM counted, crc
), cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % len(run))::INT) || substr(run, (h % len(run))::INT + 2) ELSE run END AS word, c FROM hashed
), words AS (
  SELECT word, sum(c)::BIGINT AS n, len(word) AS m FROM cut WHERE len(word) >= 7 GROUP BY word HAVING sum(c) >= 2
), gone AS (
  SELECT word, n, m, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM (SELECT word, n, m, unnest(range(m)) AS p FROM words)
), links AS (
  SELECT a.word, b.word AS near, b.n FROM gone a JOIN gone b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gone g JOIN words w ON g.rest = w.word
  UNION SELECT w.word, g.word, g.n FROM gone g JOIN words w ON g.rest = w.word
), best AS (
  SELECT word, count(*)::BIGINT AS n_near, max(n) AS most, arg_min(near, struct_pack(a := -n, b := near)) AS near FROM links GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 10 * w.n THEN b.near END AS form, CASE WHEN b.most >= 10 * w.n THEN b.most END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word
), chain(word, root) AS (
  SELECT word, word FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON f.word = c.word JOIN formed e ON c.root = e.word WHERE e.form IS NULL
""",
}


def _codes_sql(rounds: int = codes.ROUNDS, parts: int = codes.PARTS, entries: int = codes.ENTRIES) -> str:
    """Assign and move as one pair of tables a round; every part against every entry."""
    sql = [
        f"""WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))), false)
), points AS MATERIALIZED (
  SELECT r, (i - 1) * {parts} // len(embedding) AS part, (i - 1) % (len(embedding) // {parts}) AS pos, floor(256 * embedding[i]::DOUBLE)::BIGINT AS x
  FROM (SELECT r, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM kept)
), book0 AS MATERIALIZED (SELECT part, r AS entry, pos, x FROM points WHERE r < {entries}
)"""
    ]
    for k in range(rounds + 1):
        sql.append(
            f""", code{k} AS MATERIALIZED (
  SELECT r, part, arg_min(entry, struct_pack(d := d, e := entry)) AS entry, min(d) AS d FROM (
    SELECT p.r, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x))::BIGINT AS d FROM points p JOIN book{k} b ON p.part = b.part AND p.pos = b.pos GROUP BY p.r, p.part, b.entry)
  GROUP BY r, part
)"""
        )
        if k < rounds:
            sql.append(
                f""", mean{k} AS (
  SELECT p.part, c.entry, p.pos, (sum(p.x) - ((sum(p.x) % count(*)) + count(*)) % count(*)) // count(*) AS x
  FROM points p JOIN code{k} c ON p.r = c.r AND p.part = c.part GROUP BY p.part, c.entry, p.pos
), book{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x)::BIGINT AS x FROM book{k} b LEFT JOIN mean{k} m ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos
)"""
            )
    return "".join(sql) + (
        f""", whole AS (
  SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM code{rounds} GROUP BY r
)
SELECT k.vec_id, w.code, w.error, (sum(w.error) OVER (PARTITION BY k.label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
FROM kept k JOIN whole w ON k.r = w.r
"""
    )


ORACLES["op11_vector_codes"] = _codes_sql()
