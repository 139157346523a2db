"""The queries of this subpackage over the driver's tables, with their production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscan.functions.normalize import norm_mode, norm_path, valid_score
from twinscan.llm.components import connected_groups
from twinscan.llm.handwritten import classify, fit_classifier, validation
from twinscan.llm.mixing import mix, mixing_checks
from twinscan.llm.neardup import expand_links, near_duplicate_groups, near_duplicates
from twinscan.llm.packing import fill_report, pack, packing_checks
from twinscan.llm.passages import fuzzy_passages
from twinscan.llm.prose import measure, statistics, text_types
from twinscan.llm.spans import shared_passages, shared_ranges, shared_shares
from twinscan.llm.syntax import agreement, invalid_files, invalid_rates, parse_verdicts, reports
from twinscan.llm.topn import top_n_per_group
from twinscan.plans.scratch import cut
from twinscan.sources.tables import table

MOST_LIMITS = 10_000
MOST_WORDS = 1_000_000


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "unit_pairs")
    groups = {"mode": norm_mode(F.col("mode")), "file_path": norm_path(F.col("left_loc.file_path"))}
    top = top_n_per_group(pairs, groups, valid_score(F.col("score")), F.col("pair_id"), n=5)
    return top.select("mode", "file_path", F.col("tie").alias("pair_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "unit_pairs")
    groups = connected_groups(pairs, F.col("left_unit"), F.col("right_unit"), norm_mode(F.col("mode")))
    return groups.select(F.col("scope").alias("mode"), "unit_id", "group_id")


def _passages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = table(spark, d, "project_files").select("file_id", "content")
    return files, shared_passages(files, F.col("file_id"), F.col("content"), k=12)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    _, passages = _passages(spark, d)
    return shared_ranges(passages).withColumnRenamed("record_id", "file_id")


def p6_passages(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy_passages(table(spark, d, "project_files"), F.col("file_id"), F.col("content"), k=12, seed=4)


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    files, passages = _passages(spark, d)
    return shared_shares(files, F.col("file_id"), F.col("content"), shared_ranges(passages))


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(table(spark, d, "project_files"), F.col("file_id"), F.col("content"), k=5, threshold=0.7)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    out = expand_links(*_near(spark, d))
    return out.select(F.col("left_id").alias("left_file"), F.col("right_id").alias("right_file"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    links, members = _near(spark, d)
    return near_duplicate_groups(cut(links, "links"), members)


def _file_columns() -> tuple:
    return F.col("file_id"), F.col("file_path"), F.col("content")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "project_files")
    return classify(files, *_file_columns(), fit_classifier(files, *_file_columns())).where("machine").select("file_id").distinct()


def p2_validation(spark: SparkSession, d: str) -> DataFrame:
    return validation(table(spark, d, "project_files"), *_file_columns())


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return invalid_files(parse_verdicts(table(spark, d, "project_files"), *_file_columns()))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return invalid_rates(parse_verdicts(table(spark, d, "project_files"), *_file_columns()))


def _reported(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "project_files")
    return reports(files, F.col("file_id"), F.col("file_path"), F.col("run_id"), table(spark, d, "analyze_runs"), table(spark, d, "analyze_warnings"))


def p5_reported(spark: SparkSession, d: str) -> DataFrame:
    return _reported(spark, d)


def p5_agreement(spark: SparkSession, d: str) -> DataFrame:
    return agreement(parse_verdicts(table(spark, d, "project_files"), *_file_columns()), _reported(spark, d))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    limits = [(r["limit_name"], r["capacity_tokens"]) for r in table(spark, d, "pack_limits").orderBy("limit_name").take(MOST_LIMITS + 1)]
    if len(limits) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} limits")
    docs = table(spark, d, "documents")
    return pack(docs, F.col("doc_id"), F.col("text"), limits, locality=[F.lower(F.trim("series")), F.lower(F.trim("lang"))])


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(cut(p8_packed(spark, d), "packed"))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    return packing_checks(cut(p8_packed(spark, d), "packed"))


def _source() -> Column:
    return F.lower(F.regexp_replace("source", r"^\s+|\s+$", ""))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets").withColumn("source", _source())
    return mix(table(spark, d, "documents"), F.col("doc_id"), F.col("text"), _source(), targets)


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    return mixing_checks(table(spark, d, "documents"), F.col("doc_id"), F.col("text"), _source(), *_mixed(spark, d))


def _measured(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "common_words").select("word").distinct().take(MOST_WORDS + 1)
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words")
    words = [r["word"] for r in rows]
    return measure(table(spark, d, "documents"), F.col("doc_id"), F.col("text"), words)


def p10_types(spark: SparkSession, d: str) -> DataFrame:
    return text_types(cut(_measured(spark, d), "cues"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    typed = p10_types(spark, d)
    return typed.where((F.col("n_list") + F.col("n_table") + F.col("n_junk")) * 2 > F.col("n_cues")).select("doc_id").distinct()


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    out = statistics(_measured(spark, d)).distinct()
    return out.withColumns({c: F.round(c, 8) for c in ("mean_word_length", "symbol_ratio", "ended_share", "common_share")})


_ALL = [p1_found, p2_found, p2_validation, p3_found, p5_found, p5_rates, p5_reported, p5_agreement, p6_found, p6_passages, p6_shares, p7_found, p7_groups, p8_packed, p8_fill, p8_checks, p9_selection, p9_shares, p9_checks, p10_found, p10_types, p10_statistics]
QUERIES = {f.__name__: f for f in _ALL}
