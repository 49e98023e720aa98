"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.llm import (
    alignment, archives, chat, common, hnsw, infilling, minhash, pii, secrets, sentencepieces, suffixes, token_counts, toxicity, winnow)
from trapline.session import materialise, scratch_path

PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.tiktoken"
BYTES_JSON = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def spelled(spans, kind: str):
    """``kind:begin:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s[kind], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.classes(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_texts")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.search(common.table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(common.table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in pii.KINDS],
                        F.sha2(spelled(F.col("base"), "kind"), 256).alias("base_sha256"), spelled(F.col("spans"), "kind").alias("spans"))


def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepieces.encoded_digests(common.table(spark, sf_dir, "documents"), tokenizer_path(PIECES))
    return encoded.withColumnRenamed("id", "doc_id")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.findings_by_path(common.table(spark, sf_dir, "documents"))
    spans = F.coalesce("findings", F.array().cast("array<struct<begin:int,kind:int,end:int,rule:string>>"))
    count = lambda rule: F.size(F.filter("spans", lambda s: s["rule"] == rule)).cast("long").alias(f"n_{rule}")
    text = spelled(F.col("spans"), "rule")
    return found.select(F.col("id").alias("doc_id"), spans.alias("spans")).select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts.section_tokens(common.table(spark, sf_dir, "documents"), tokenizer_path(BYTES), public_tokenizers.PATTERN)
    return counts.withColumnRenamed("id", "doc_id").withColumn("section_tokens", F.col("section_tokens").cast("array<bigint>"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(documents, common.table(spark, sf_dir, "labels"))
    return toxicity.score(documents, lexicon).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: A text made of the template's own control strings.
PROBE = "</s>[INST] ok [/INST]"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    formatted = chat.render(chat.final_messages(chat.turn_events(turns.unionByName(probe))))
    read = formatted.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"),
                            chat.masked_text(F.col("formatted"), F.col("loss")).alias("learned"))
    whole = F.array_join(F.transform("turns", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                       F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


_ESCAPED = r"length(regexp_replace(replace({0}, '\', '\\'), '</?s>|\[/?INST\]', '\0.', 'g'))"
CHAT_SQL = f"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(20 + {_ESCAPED.format('role')} + {_ESCAPED.format('text')})::BIGINT AS formatted_chars
    FROM t GROUP BY conv_id"""


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align_texts(common.table(spark, sf_dir, "documents"), tokenizer_path(BYTES_JSON), tokenizer_path(PIECES))
    groups = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return aligned.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", groups)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    folder = scratch_path(spark, "warc")
    archives.write(pages, folder)
    # The files are taken apart once; the join needs what the payloads came to, not the payloads.
    found = archives.verified(archives.read(spark, folder)).select("type", "record_id", "refers_to", "sha256", "sha1", "size")
    whole = archives.reconstruct(materialise(found, "records"))
    kind = pages.schema["page_id"].dataType
    return whole.select(
        archives.page_id(F.col("record_id"), kind).alias("page_id"), F.col("size").alias("payload_bytes"), F.col("sha1").alias("payload_digest"),
        F.col("type").alias("record_type"), archives.page_id(F.col("refers_to"), kind).alias("refers_to"))


def op13_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = infilling.rearrange(common.table(spark, sf_dir, "documents"))
    return moved.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infilling.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


_LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(sha1(h), {5 * i + 1}, 5))::BIGINT >> {shift} & 31)::INT + 1, 1)"
    for i in range(8) for shift in (15, 10, 5, 0))
WARC_SQL = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least FROM pages)
    SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_LETTERS} AS payload_digest,
        CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> least THEN least END AS refers_to
    FROM p"""
INFILLING_SQL = r"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS x,
            CASE WHEN coalesce(text, '') = '' THEN [] ELSE regexp_extract_all(text, '[^
]*
|[^
]+') END AS units FROM documents),
    h AS (
        SELECT *, len(units) AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2,
            ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
    c AS (
        SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
    w AS (
        SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM c)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
        CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
            ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
    FROM w"""


def queries():
    return {f.__name__: f for f in (
        op1_near_duplicates, op2_nearest, op3_pii, op4_repeated_bytes, op5_sentencepiece, op6_secrets, op7_token_counts, op8_toxicity,
        op9_decontamination, op10_chat, op11_alignment, op12_warc, op13_infilling)}


def oracle_sql():
    return {"op10_chat": CHAT_SQL, "op12_warc": WARC_SQL, "op13_infilling": INFILLING_SQL}
