"""The operators' queries over whole tables, and DuckDB SQL where it can state the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_conversations, read_back
from .common import new_path, read, stored
from .decontaminate import leaks
from .exact_dedup import exact_dedup
from .language import fit, held_out, predict, train_part
from .lines import line_dedup
from .licences import LICENCES, canonical_sql, license_scan
from .mixing import mix, sized
from .simhash import near_dedup
from .spans import span_dedup
from .warc import read_archives, write_archives


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized(read(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents")).drop("chain")


#: A conversation whose texts hold control strings of the template.
AWKWARD = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.union(spark.createDataFrame(AWKWARD, "conv_id long, turn long, role string, text string"))
    return read_back(stored(format_conversations(turns), "chat"))


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = predict(docs, fit(train_part(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(read(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).drop("url")


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup(read(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_simhash_bktree, op3_mixing, op4_exact_dedup, op5_chat_formatting, op6_fuzzy_lines, op7_language_id, op8_warc, op9_sentence_spans, op10_license_scan)}

ORACLE_SQL = {
    "op4_exact_dedup": r"""
        with n as (select doc_id, length(coalesce(text, '')) cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') norm from documents),
        g as (select doc_id, norm, first_value(doc_id) over (partition by norm order by cp desc, doc_id) keep_id, count(*) over (partition by norm) group_size from n)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from g""",
    "op10_license_scan": f"""
        with l as (select sha256({canonical_sql("text")}) as canonical_sha256, min(license_id) as license_id
            from (values {", ".join("('%s', '%s')" % (i, t.replace("'", "''")) for i, t in LICENCES)}) as v(license_id, text) group by 1)
        select d.doc_id, d.canonical_sha256, l.license_id
        from (select doc_id, sha256({canonical_sql("text")}) as canonical_sha256 from documents) d left join l using (canonical_sha256)""",
}
