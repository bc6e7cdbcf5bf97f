"""Quality rules, of documents and of hosts, in DataFrame functions alone.

A document fails on its own counts. Hosts are judged by the failures of their
documents: each host's failure rate is shrunk by a beta prior that is fitted to
the rates of all hosts by the method of moments, and a host whose shrunk rate
is over the threshold takes all its documents with it.

Defined cases: a null text has no words and fails; an empty one likewise; a text
of any length is one row and is counted whole; a null host is a host of its
own; a host's documents are counted before they are shuffled, so a host may hold
any share of the rows; a host whose rate equals the threshold stays; repeated
rows are judged and counted each; an empty table gives an empty result; further
columns ride along in keep_rows, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.plans.staging import stage_table

#: A host whose shrunk rate of failures is over this is rejected.
HOST_RATE = 0.5
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Host verdicts up to this number are broadcast; beyond it they are shuffled.
BROADCAST_HOSTS = 100_000

_GAP = r"[\x20\x09-\x0D]+"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _covered(starts: Column) -> Column:
    """Words that 3-word windows cover, given where they start in rising order."""
    n = F.size(starts)
    gaps = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.least(F.lit(3), F.get(starts, k) - F.get(starts, k - 1)))
    return F.when(n == 0, 0).when(n == 1, 3).otherwise(3 + F.aggregate(gaps, F.lit(0), lambda s, x: s + x))


def with_base(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add BASE to each row."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    squeezed = F.regexp_replace(body, _GAP, " ")
    df = df.withColumn("__squeezed", F.trim(squeezed))
    df = df.withColumn("__words", F.when(F.col("__squeezed") == "", F.array().cast("array<string>")).otherwise(F.split("__squeezed", " ")))
    df = df.withColumn("n_words", F.size("__words").cast("long"))
    words = F.col("__words")
    df = df.withColumn(
        "__threes",
        F.when(F.col("n_words") < 4, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
        ),
    )
    df = df.withColumn("__some", F.size(F.array_distinct("__threes")) < F.size("__threes"))
    placed = F.sort_array(F.transform("__threes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__placed", F.when(F.col("__some"), placed))
    at = F.col("__placed")
    twice = F.filter(
        at,
        lambda x, k: F.coalesce(x["h"] == F.get(at, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(at, k + 1)["h"], F.lit(False)),
    )
    df = df.withColumn("__starts", F.when(F.col("__some"), F.sort_array(F.transform(twice, lambda x: x["i"]))))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("__lines", lines)
    repeat = F.when(F.col("__some"), _covered(F.col("__starts"))).otherwise(0).cast("long")
    df = (
        df.withColumn("word_chars", F.length("__squeezed") - F.greatest(F.col("n_words") - 1, F.lit(0)))
        .withColumn("n_symbols", (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn("n_repeat_words", repeat)
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("__squeezed", "__words", "__threes", "__some", "__placed", "__starts", "__lines")


def host_verdicts(rows: DataFrame, host_col: str, rate: float = HOST_RATE) -> DataFrame:
    """host, host_rate (shrunk) and host_rejected, from rows with base_failed.

    The prior's mean is m, the mean of the hosts' rates, and its weight w solves
    variance = m (1 - m) / (w + 1); hosts that are all alike make w large.
    """
    host = rows.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failed"))
    host = stage_table(host, "host-counts")
    x = F.col("failed") / F.col("n")
    prior = host.agg(F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    between = F.col("m") * (1 - F.col("m"))
    weight = F.when((F.col("v") > 0) & (between > F.col("v")), F.least(between / F.col("v") - 1, F.lit(1e6))).otherwise(F.lit(1.0))
    prior = prior.select("m", F.greatest(weight, F.lit(1.0)).alias("w"))
    joined = host.crossJoin(F.broadcast(prior))  # one row
    shrunk = (F.col("failed") + F.col("m") * F.col("w")) / (F.col("n") + F.col("w"))
    return joined.select("host", shrunk.alias("host_rate")).withColumn("host_rejected", F.col("host_rate") > rate)


def _with_verdicts(rows: DataFrame, verdicts: DataFrame, host_col: str) -> DataFrame:
    verdicts = stage_table(verdicts.select(F.col("host").alias("__host"), "host_rejected"), "host-verdicts")
    if verdicts.count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    return rows.join(verdicts, F.col(host_col).eqNullSafe(F.col("__host")), "left").drop("__host")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rate: float = HOST_RATE) -> DataFrame:
    """id, BASE and kept for every document; texts are read once, their counts are staged."""
    counts = with_base(docs.select(id_col, text_col, F.col(host_col).alias("__source")), text_col).drop(text_col)
    counts = stage_table(counts, "rule-counts")
    joined = _with_verdicts(counts, host_verdicts(counts, "__source", rate), "__source")
    return joined.select(id_col, *BASE, (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"))


def keep_rows(docs: DataFrame, text_col: str = "text", host_col: str = "source", rate: float = HOST_RATE) -> DataFrame:
    """The rows of docs that stay, with their columns. Each text is counted once; rows that pass wait, staged, for the verdict on their host."""
    columns = docs.columns
    own = docs.select(*(F.col(c).alias(f"__own_{c}") for c in columns), F.col(text_col).alias("__text"), F.col(host_col).alias("__source"))
    rows = with_base(own, "__text").select("__source", "base_failed", *(f"__own_{c}" for c in columns))
    # of rows that fail the host alone is needed
    rows = stage_table(rows.select("__source", "base_failed", *(F.when(~F.col("base_failed"), F.col(f"__own_{c}")).alias(f"__own_{c}") for c in columns)), "rule-rows")
    kept = _with_verdicts(rows.where(~F.col("base_failed")), host_verdicts(rows, "__source", rate), "__source").where(~F.col("host_rejected"))
    return kept.select(*(F.col(f"__own_{c}").alias(c) for c in columns))
