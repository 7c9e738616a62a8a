"""Queries of file, name, set and table operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import catalog
from .proxies import HOUR, query, read, rounded


@query("p20_depth_ranges", "WITH r AS (SELECT * FROM (VALUES (1, 40, 50, -1), (2, 10, 20, 1), (3, 15, 15, 1)) t(range_no, low, high, way)) SELECT p_partkey, range_no, row_number() OVER (ORDER BY range_no, way * p_size, way * p_partkey) AS place FROM part JOIN r ON p_size BETWEEN low AND high")
def depth_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.depth_sequence(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", "p_size", [(50, 40), (10, 20), (15, 15)])
    return found.select("p_partkey", "range_no", "place")


@query("p22_path_metadata", "SELECT doc_id, 'CSC' || doc_id || 'ch' || (doc_id % 9) || '.ncs' AS file, CAST(regexp_extract('CSC' || doc_id || 'ch' || (doc_id % 9), 'CSC(\\d+)(?:ch(\\d+))?', 1) AS INT) AS tetrode, CAST(regexp_extract('CSC' || doc_id || 'ch' || (doc_id % 9), 'CSC(\\d+)(?:ch(\\d+))?', 2) AS INT) AS channel, split_part('a/' || source || '/x', '/', 2) AS parent FROM documents")
def path_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.concat(F.lit("CSC"), F.col("doc_id"), F.lit("ch"), F.col("doc_id") % 9, F.lit(".ncs"))
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", file.alias("file"))
    one, two = catalog.channel_of(F.col("file"))
    return rows.select("doc_id", "file", one.alias("tetrode"), two.alias("channel"), F.element_at(F.split(F.concat(F.lit("a/"), F.col("source"), F.lit("/x")), "/"), 2).alias("parent"))


@query("p23_tetrode_prefix", "SELECT p_partkey, upper(nullif(regexp_extract(CASE WHEN p_size % 2 = 0 THEN 'tt' || p_size || '_SS_01' ELSE 'x' || p_size END, '^([Tt][Tt]\\d+)', 1), '')) AS tetrode FROM part")
def tetrode_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("tt"), F.col("p_size"), F.lit("_SS_01"))).otherwise(F.concat(F.lit("x"), F.col("p_size")))
    return read(spark, sf_dir, "part").select("p_partkey", catalog.tetrode_of(name).alias("tetrode"))


@query("j12_single_track_pairs", "WITH t AS (SELECT c_nationkey AS folder, min(c_custkey) AS track FROM customer WHERE c_acctbal > 9500 GROUP BY 1 HAVING count(*) = 1) SELECT s_suppkey AS unit, folder, track FROM supplier JOIN t ON s_nationkey = folder")
def single_track_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = read(spark, sf_dir, "customer").filter("c_acctbal > 9500").select(F.col("c_nationkey").alias("folder"), F.col("c_custkey").alias("track"))
    units = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_nationkey").alias("folder"))
    return catalog.single_pairs(tracks, units, "folder")


@query("j13_companion_file", "WITH o AS (SELECT s_nationkey AS folder, min(s_name) AS companion FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) SELECT c_custkey, companion FROM customer LEFT JOIN o ON c_nationkey = folder")
def companion_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = read(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("folder"), "s_name")
    files = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("folder"))
    return catalog.companion(files, others, "folder", "s_name").select("c_custkey", "companion")


@query("j14_spectrum_lookup", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def spectrum_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("j15_n13_group_differences", "WITH m AS (SELECT n_name AS animal, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT a.animal AS animal_1, b.animal AS animal_2, round(a.v - b.v, 4) AS difference FROM m a JOIN m b ON a.animal < b.animal")
def group_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("animal")).agg(F.avg("c_acctbal").alias("v"))
    rows = catalog.pairs(means, "animal", ["v"])
    return rounded(rows.select("animal_1", "animal_2", (F.col("v_1") - F.col("v_2")).alias("difference")), "difference", digits=4)


@query("j16_trial_grid", "SELECT n_name, max(CASE WHEN o_orderpriority LIKE '1%' THEN n END) AS p1, max(CASE WHEN o_orderpriority LIKE '2%' THEN n END) AS p2, coalesce(max(CASE WHEN o_orderpriority LIKE '9%' THEN 'found' END), 'file not found') AS p9 FROM nation LEFT JOIN (SELECT c_nationkey, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) ON n_nationkey = c_nationkey GROUP BY n_name")
def trial_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("trial", F.substring("o_orderpriority", 1, 1))
    counts = catalog.trial_grid(counts, "c_nationkey", "trial", ["1", "2", "9"], F.count(F.lit(1)))
    rows = read(spark, sf_dir, "nation").join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.select("n_name", F.col("1").alias("p1"), F.col("2").alias("p2"), F.when(F.col("9").isNull(), "file not found").otherwise("found").alias("p9"))


@query("j17_missing_files", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return catalog.missing(read(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"])


@query("a30_joined_fields", "SELECT o_custkey, count(*) AS fields, string_agg(CAST(o_orderkey AS VARCHAR), '; ' ORDER BY o_orderkey) AS ids, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def joined_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")), "; ")
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("fields"), ids.alias("ids"), F.sum("o_totalprice").alias("total"))
    return rounded(rows, "total", digits=2)


@query("a31_empty_folders", "SELECT l_suppkey, round(avg(CASE WHEN l_discount < 0.055 THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem GROUP BY l_suppkey HAVING avg(CASE WHEN l_discount < 0.055 THEN 1.0 ELSE 0.0 END) > 0.5")
def empty_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(catalog.emptiness(read(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_discount") < 0.055), "share")


@query("o1_job_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders")
def job_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ordering import placed

    return placed(read(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], "place").select("o_orderkey", "place")


@query("o4_largest_file", "SELECT source, arg_max(doc_id, struct_pack(n := n_chars, d := -doc_id)) AS doc_id FROM documents GROUP BY source")
def largest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"))


@query("o8_natural_order", "SELECT source, row_number() OVER (ORDER BY CAST(regexp_extract(source, '[0-9]+', 0) AS INT), source) AS place FROM (SELECT DISTINCT source FROM documents)")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("source").distinct()
    return rows.select("source", F.row_number().over(Window.orderBy(catalog.natural_name(F.col("source")))).cast("long").alias("place"))


@query("o9_first_events", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 12")
def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").orderBy(F.desc("value"), "event_id").limit(12).select("event_id", "value")


@query("u1_all_segments", "SELECT 'full' AS segment, count(*) AS n FROM events UNION ALL SELECT 'first', count(*) FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'second', count(*) FROM events WHERE event_id % 2 = 1")
def all_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events")
    parts = {"full": rows, "first": rows.filter("event_id % 2 = 0"), "second": rows.filter("event_id % 2 = 1")}
    out = [r.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("segment"), "n") for k, r in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("u2_extension_overlap", "WITH e AS (SELECT user_id, list(DISTINCT event_type) AS kinds FROM events GROUP BY user_id) SELECT user_id, len(list_intersect(kinds, ['click', 'error'])) > 0 AS has_any FROM e")
def extension_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return kinds.select("user_id", F.arrays_overlap("kinds", F.array(F.lit("click"), F.lit("error"))).alias("has_any"))


@query("u4_unique_sheet_names", "WITH n AS (SELECT p_partkey, substr(regexp_replace(p_brand || '/' || p_type, '[\\[\\]:*?/\\\\]', '_', 'g'), 1, 31) AS c FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY p_partkey) AS n FROM n) SELECT p_partkey, CASE WHEN n = 1 THEN c ELSE substr(c, 1, 31 - length('_' || n)) || '_' || n END AS sheet FROM k")
def unique_sheet_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("name"))
    return catalog.unique_names(rows, "name", "p_partkey").select("p_partkey", "sheet")


@query("s9_numeric_coercion", "SELECT doc_id, TRY_CAST(CASE WHEN doc_id % 3 = 0 THEN 'x' || doc_id ELSE doc_id || '.5' END AS DOUBLE) AS v FROM documents WHERE TRY_CAST(CASE WHEN doc_id % 3 = 0 THEN 'x' || doc_id ELSE doc_id || '.5' END AS DOUBLE) IS NOT NULL")
def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x"), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".5")))
    v = raw.try_cast("double")
    return read(spark, sf_dir, "documents").select("doc_id", v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))


@query("scalar_functions", f"SELECT event_id, lpad(CAST(event_id AS VARCHAR), 8, '0') AS padded, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) % 60 AS second, round(log2(value + 1), 6) AS bits, round(log10(value + 1), 6) AS tens, round(0.5 * ln((1 + value / 1000) / (1 - value / 1000)), 6) AS fisher, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(epoch_us(ts) // {HOUR} AS BIGINT) AS hour FROM events")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    v = F.col("value")
    rows = read(spark, sf_dir, "events").select(
        "event_id", F.lpad(F.col("event_id").cast("string"), 8, "0").alias("padded"), (F.floor(at / 1_000_000) % 60).alias("second"), F.log2(v + 1).alias("bits"), F.log10(v + 1).alias("tens"),
        (0.5 * F.ln((1 + v / 1000) / (1 - v / 1000))).alias("fisher"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.floor(at / HOUR).alias("hour"),
    )
    return rounded(rows, "bits", "tens", "fisher")
