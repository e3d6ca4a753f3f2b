"""The operators as queries over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwright.llm import checks, conversation_trie, decontamination, html_extraction, license_scan, mixing, packing, periodic_runs, quality, sharding, simhash, toxicity, url_filter, warc

#: The host and path rules of op3.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", F.round("expected_severity", 6).alias("expected_severity"), "grade", "rejected")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", "item_id", "n_matched", F.round("similarity", 6).alias("similarity"), "first_word")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "carried")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(_table(spark, sf_dir, "pages"))
    return warc.read(manifest, payloads=False).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, within=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sharding.shard(_table(spark, sf_dir, "documents"), 8)
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document lies at source/lang/doc_id."""
    docs = _table(spark, sf_dir, "documents")
    return license_scan.scan(docs, F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))), F.col("doc_id").cast("string"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a tenth of the documents, by the checksum of the id, the words from some place on are a repetition of the first ones there."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"))
    split = docs.where("h % 10 = 0").withColumn("w", F.array_remove(F.split("text", r"[ \t\n\x0B\f\r]+"), "")).withColumn("n", F.size("w")).withColumn("g", F.expr("h div 10"))
    placed = split.withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)"))).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    repeated = F.expr("concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a))")
    planted = placed.select("doc_id", F.when(F.col("n") > 0, F.concat_ws(" ", repeated)).otherwise("").alias("text"))
    found = periodic_runs.find(docs.where("h % 10 <> 0").select("doc_id", "text").unionAll(planted))
    best = found.withColumn("best", F.expr("array_min(transform(runs, r -> struct(-r.length as a, r.start as start, r.period as period)))"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.a")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * -best.a div best.period").alias("exponent_milli"),
        F.sha2(F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are rebuilt so that some begin alike; see conversation_trie.branched."""
    turns = conversation_trie.ordered(_table(spark, sf_dir, "conversations"))
    return conversation_trie.trie(*conversation_trie.branched(turns))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_decontamination, op3_url_filter, op4_html_extraction, op5_warc, op6_simhash, op7_sharding, op8_packing, op9_quality_rules, op10_license_scan, op11_periodic_runs, op12_mixing, op13_conversation_trie)
}
#: The others need fitted models, wrappers, tokens or hashes that SQL lacks; tests/llm holds them against plain Python.
ORACLE: dict[str, str] = {
    "op2_decontamination": checks.op2(), "op3_url_filter": checks.op3(RULES), "op5_warc": checks.OP5, "op7_sharding": checks.op7(), "op9_quality_rules": checks.OP9, "op10_license_scan": checks.op10(),
    "op11_periodic_runs": checks.op11(), "op13_conversation_trie": checks.op13(),
}
