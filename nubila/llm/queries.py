"""The operators over their whole tables, as registered queries, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nubila.llm import chat, decontaminate, fingerprint, html_extract, langid, near_dedup, oracles, packing, pii, quality, runs, toxicity, warc
from nubila.llm.common import id_crc, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitise_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == pii.KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"), F.sha2("sanitised", 256).alias("sanitised_sha256"))


def op4_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.to_variant_object(F.struct("role", "text")).alias("record"))
    hard = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.to_variant_object(F.struct(hard.alias("prompt"), hard.alias("response"))).alias("record"))
    records = chat.canonical_turns(rows.unionByName(extra))
    turns = records.select("conv_id", "turn", F.posexplode("turns").alias("place", "t")).select("conv_id", "turn", "place", "t.role", "t.text")
    out = chat.format_conversations(turns).withColumn("__turns", chat.parse_conversation(F.col("formatted"))).withColumn("__loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("__turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length("__loss").cast("long").alias("loss_chars"), F.sha2("__loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(id_crc(F.col("doc_id")) % 5 != 0)
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    return scored.select("doc_id", (id_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", "predicted")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), max_tokens=2048, end_id=0)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_language_model(docs.where(id_crc(F.col("doc_id")) % 4 != 2))
    found = langid.identify_languages(docs, model)
    return found.select("doc_id", (id_crc(F.col("doc_id")) % 4 == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))
    pairs = fingerprint.with_next(own, ("text", "sketch")).withColumn("n_chars", F.char_length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    rows = pairs.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    rows = rows.withColumn("__words", fingerprint.words(F.col("edited"))).withColumn("edited_sketch", fingerprint.sketch("__words"))
    likeness = fingerprint.likeness
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint.written(F.col("sketch")).alias("fingerprint"), fingerprint.written(F.col("edited_sketch")).alias("edited_fingerprint"), likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_warc(table(spark, sf_dir, "pages"))
    read = warc.read_warc(files)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) AS BIGINT)")
    return read.select(number("record_id").alias("page_id"), "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", F.when(F.col("record_type") == "revisit", number("refers_to")).alias("refers_to"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), id_crc(F.col("doc_id")) % 5 == 0
    learnt = docs.where(~F.coalesce(held_out, F.lit(True)))
    model = quality.fit_quality(learnt, table(spark, sf_dir, "labels").where(~held_out))
    return quality.score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, n = id_crc(F.col("doc_id")), F.size("__words")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("__h"))
    docs = docs.withColumn("__words", F.when(F.col("__h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)))
    g = F.floor(F.col("__h") / 10)
    docs = docs.withColumn("__n", n).withColumn("__a", F.when(F.col("__n") > 0, g % F.col("__n")).cast("int"))
    docs = docs.withColumn("__p", (1 + F.floor((F.col("__n") - F.col("__a")) / (3 + g % 8))).cast("int"))
    rest = F.col("__n") - F.col("__a")
    again = F.flatten(F.array_repeat(F.slice("__words", F.col("__a") + 1, F.col("__p")), F.ceil(rest / F.col("__p")).cast("int")))
    periodic = F.array_join(F.concat(F.slice("__words", F.lit(1), F.col("__a")), F.slice(again, F.lit(1), rest)), " ")
    found = runs.periodic_runs(docs.select("doc_id", F.when(F.col("__a").isNotNull(), periodic).otherwise(F.col("text")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumn("__best", longest)
    start, length, period = -F.col("__best.s"), F.col("__best.length"), -F.col("__best.q")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_html_main_text, op3_pii_sanitise, op4_minmax_dedup, op5_chat_format, op6_toxicity, op7_pack, op8_language_id, op9_scaled_sketch, op10_warc_round_trip, op11_quality, op12_word_runs, pipeline)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
