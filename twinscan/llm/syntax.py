"""Source files that do not parse, and their rates per repository and language."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscan.functions.normalize import norm_path
from twinscan.llm.lexer import language_of, problem

VERDICT = "file_id long, repo string, language string, reason string"


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for fid, path, text in zip(batch["id"], batch["path"], batch["text"]):
            language = language_of(path)
            path = (path or "").replace("\\", "/").removeprefix("./")
            repo = path.split("/", 1)[0] if "/" in path else None
            out.append((fid, repo, language, problem(text, language) if language and text else None))
        yield pd.DataFrame(out, columns=["file_id", "repo", "language", "reason"])


def parse_verdicts(df: DataFrame, file_id: Column, path: Column, content: Column) -> DataFrame:
    """For every file the first reason why it cannot parse, or null: file_id, repo, language, reason.

    Method: a lexer per language with a pushdown stack (``lexer.problem``) reads each whole text once;
    the step is a map without a shuffle. The repository is the first segment of the path.

    Defined results: a null id takes no part; a null or empty content and one of comments only are valid;
    an extension of no known language, or a null path, has a null language and no reason; re-delivered
    rows come out once each time they are delivered (``distinct`` them by file_id); an empty table gives
    no rows. Other columns play no part.
    """
    rows = df.select(file_id.cast("long").alias("id"), path.cast("string").alias("path"), content.alias("text")).where("id is not null")
    return rows.mapInPandas(_judge, VERDICT)


def invalid_files(verdicts: DataFrame) -> DataFrame:
    """Ids of the files that do not parse, each once."""
    return verdicts.where("reason is not null").select("file_id").distinct()


def invalid_rates(verdicts: DataFrame) -> DataFrame:
    """Per repository and language: n_files, n_invalid, rate; a file counts once however often delivered.

    Files of no known language are counted, but not judged: n_invalid and rate are null.
    """
    files = verdicts.groupBy("file_id", "repo", "language").agg(F.max(F.col("reason").isNotNull().cast("int")).alias("bad"))
    out = files.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.when(F.col("language").isNotNull(), F.col("bad"))).alias("n_invalid"))
    return out.withColumn("rate", F.col("n_invalid") / F.col("n_files"))


def reports(df: DataFrame, file_id: Column, path: Column, run: Column, runs: DataFrame, warnings: DataFrame) -> DataFrame:
    """For every file whether its run named it: file_id, skipped, warned.

    ``runs``(run_id, skipped_files array) and ``warnings``(run_id, file_path, message) name files by path; only messages
    about parsing count. Paths are compared with slashes, without blanks around and without a leading ``./``.
    Entries for files that do not exist have no effect; a null path names nothing.
    """
    files = df.select(file_id.cast("long").alias("file_id"), norm_path(path.cast("string")).alias("p"), run.cast("long").alias("run_id")).where("file_id is not null").distinct()
    named = runs.select("run_id", F.explode("skipped_files").alias("p"))
    about = warnings.where(F.col("message").rlike("(?i)parse|syntax")).select("run_id", F.col("file_path").alias("p"))
    named, about = (x.select(F.col("run_id").cast("long").alias("run_id"), norm_path(F.trim("p")).alias("p")).where("p is not null").distinct().withColumn(n, F.lit(True)) for x, n in ((named, "skipped"), (about, "warned")))
    out = files.join(named, ["run_id", "p"], "left").join(about, ["run_id", "p"], "left")
    return out.groupBy("file_id").agg(F.coalesce(F.max("skipped"), F.lit(False)).alias("skipped"), F.coalesce(F.max("warned"), F.lit(False)).alias("warned"))


def agreement(verdicts: DataFrame, reported: DataFrame) -> DataFrame:
    """Files by verdict and report: invalid, skipped, warned, n_files."""
    judged = verdicts.groupBy("file_id").agg(F.max(F.col("reason").isNotNull()).alias("invalid"))
    return judged.join(reported, "file_id").groupBy("invalid", "skipped", "warned").agg(F.count(F.lit(1)).alias("n_files"))
