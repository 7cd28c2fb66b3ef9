"""The registered queries of these operators, and SQL for those that SQL can express."""
from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelab.llm import ann, decontaminate, fill_middle, html_content, language_id, license_scan, line_dedup, packing, page_samples, pii, quality, simhash, substring_dedup, token_alignment


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(strings: Column) -> Column:
    return F.array_join(F.array_sort(strings), ",")


def tokenizer_files() -> tuple[str, str]:
    """The vocabulary of the packing queries, as a tokenizer file and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(_joined(F.col("items")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "longest",
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(_table(spark, sf_dir, "documents"), *tokenizer_files()))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(_table(spark, sf_dir, "documents"), tokenizer_files()[0])


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    cut = substring_dedup.repeated_passages(docs).select("doc_id", "rid", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return substring_dedup.word_digests(docs).join(cut, ["doc_id", "rid"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(_table(spark, sf_dir, "documents"))
    base = F.array_distinct(F.col("base.label"))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"), _joined(base).alias("base_labels"),
        _joined(F.array_union(base, F.col("spans.template"))).alias("labels"), "score",
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(_table(spark, sf_dir, "documents"), key="query key; a deployment brings its own")
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_entities", "text")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(_table(spark, sf_dir, "documents"))


@lru_cache(maxsize=1)
def page_model() -> html_content.Model:
    """The model of the extraction query, learned from the labelled pages that come with the library."""
    return html_content.fit(*zip(*page_samples.labelled_pages(), strict=True))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.main_texts(_table(spark, sf_dir, "pages"), page_model()).withColumn("n_chars", F.length("text").cast("long"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.alignment(_table(spark, sf_dir, "documents"), *tokenizer_files(), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_language_id": op4_language_id,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_quality": op6_quality,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_pii": op10_pii,
    "op11_fill_middle": op11_fill_middle,
    "op12_html_extraction": op12_html_extraction,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {
    "op9_line_dedup": """
        WITH lines AS (
            SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS pos
            FROM documents
        ), spread AS (
            SELECT trim(line, ' ') AS k, count(DISTINCT source) AS sites FROM lines WHERE trim(line, ' ') <> '' GROUP BY 1
        ), marked AS (
            SELECT l.*, coalesce(s.sites >= 4, false)
                   AND row_number() OVER (PARTITION BY trim(line, ' ') ORDER BY doc_id, pos) > 1 AS gone
            FROM lines l LEFT JOIN spread s ON trim(l.line, ' ') = s.k
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_sha256
        FROM marked GROUP BY doc_id
    """,
    "op11_fill_middle": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                   sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
            FROM documents
        ), k AS (
            SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                             OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
                        WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM d
        ), p AS (
            SELECT *, substr(t, 1, least(c1, c2)) AS pre, substr(t, least(c1, c2) + 1, greatest(c1, c2) - least(c1, c2)) AS mid,
                   substr(t, greatest(c1, c2) + 1) AS suf
            FROM k
        ), o AS (
            SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                                ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS out
            FROM p
        ), r AS (
            SELECT *, substr(out, 4, strpos(out, CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) - 4) AS one,
                   substr(out, strpos(out, CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) + 3,
                          strpos(out, '<M>') - strpos(out, CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) - 3) AS two,
                   substr(out, strpos(out, '<M>') + 3) AS last
            FROM o
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars, sha256(out) AS output_sha256,
               sha256(CASE form WHEN 'plain' THEN out WHEN 'psm' THEN one || last || two ELSE two || last || one END) AS restored_sha256
        FROM r
    """,
}
