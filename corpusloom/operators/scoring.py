"""Evaluation scores that keep failures and refusals in their denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """struct<numerator, denominator, rate>; the rate of nothing is null."""
    n, d = numerator.cast("long"), denominator.cast("long")
    return F.struct(n.alias("numerator"), d.alias("denominator"), F.try_divide(n, d).alias("rate"))


def last_outcome(outcomes: DataFrame, order_col: str, *keys: str) -> DataFrame:
    last = Window.partitionBy(*keys).orderBy(F.desc(order_col))
    return outcomes.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def score(questions: DataFrame, outcomes: DataFrame, order_col: str = "position", question_col: str = "question_id", variant_col: str = "variant") -> DataFrame:
    """Per variant: four ratios and three counts.

    questions: id, supported. outcomes: variant, id, position, status, retrieval_hit, accurate, citation_pairs,
    supported_pairs, judge_missing. Of several outcomes of a question the last counts; a question without one counts as
    nothing found. Counts of failed, missing and completed rows are over outcome rows, repeated ones too.
    """
    variants = outcomes.select(variant_col).distinct()
    last = last_outcome(outcomes, order_col, variant_col, question_col).drop("supported")
    # Every question under every variant: the variants, a handful, as one array beside each question.
    names = variants.agg(F.array_sort(F.collect_set(variant_col)).alias("v")).first()["v"]
    everything = questions.select(question_col, "supported", F.explode(F.lit(names) if names else F.array().cast("array<string>")).alias(variant_col))
    rows = everything.join(last, [variant_col, question_col], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    scored = rows.groupBy(variant_col).agg(
        ratio(F.count_if(F.col("supported") & yes("retrieval_hit")), F.count_if("supported")).alias("retrieval_hit"),
        ratio(F.count_if(F.col("supported") & yes("accurate")), F.count_if("supported")).alias("answer_accuracy"),
        ratio(F.sum(count("supported_pairs")), F.sum(count("citation_pairs"))).alias("citation_correctness"),
        ratio(F.count_if(~F.col("supported") & F.coalesce(F.col("status") == "refused", F.lit(False))), F.count_if(~F.col("supported"))).alias("unsupported_refusal"),
    )
    counts = outcomes.groupBy(variant_col).agg(F.count_if(F.col("status") == "failed").alias("failed_questions"), F.count_if(yes("judge_missing")).alias("missing_judgments"), F.count("*").alias("completed_questions"))
    return scored.join(counts, variant_col)


def run_status(outcomes: DataFrame, variant_col: str = "variant") -> DataFrame:
    """completed, or completed_with_failures if any question failed or lacks a judgment."""
    bad = F.bool_or((F.col("status") == "failed") | F.coalesce("judge_missing", F.lit(False)))
    return outcomes.groupBy(variant_col).agg(F.when(bad, "completed_with_failures").otherwise("completed").alias("run_status"))


def judged(rows: DataFrame) -> DataFrame:
    """Outcome columns from judgments.

    rows: status, supported, judged (struct<accurate, citations>, null if there is none), pairs. A judgment that is
    missing or decides other pairs makes an answered question failed, keeps its pairs in the denominator and marks
    judge_missing; an unsupported question that was answered is never accurate.
    """
    from corpusloom.functions import strict_json

    answered = F.col("status") == "answered"
    good = strict_json.complete_judgment(F.col("judged"), F.col("pairs"))
    return (
        rows.withColumn("judge_missing", answered & ~good)
        .withColumn("citation_pairs", F.when(answered, F.col("pairs")).otherwise(0))
        .withColumn("supported_pairs", F.when(answered & good, F.size(F.filter("judged.citations", lambda c: c["supported"]))).otherwise(0))
        .withColumn("accurate", answered & good & F.col("supported") & F.coalesce(F.col("judged.accurate"), F.lit(False)))
        .withColumn("status", F.when(F.col("judge_missing"), "failed").otherwise(F.col("status")))
    )


def gold_errors(gold: DataFrame, stored: DataFrame, manifest: DataFrame) -> DataFrame:
    """Gold references that differ in any of seven columns from the stored chunk and the manifest, or whose chunk is missing."""
    expected = gold.join(manifest.select("document_id", "source_url", "regulator", F.col("title").alias("document_title")), "document_id", "left").select("chunk_id", F.struct(F.col("sha256").alias("content_hash"), "document_id", "section_heading", F.col("excerpt").alias("text"), "source_url", "regulator", "document_title").alias("expected"), F.col("source_url").isNull().alias("unlisted"))
    found = stored.select("chunk_id", F.struct("content_hash", "document_id", "section_heading", "text", "source_url", "regulator", "document_title").alias("found"))
    return expected.join(found, "chunk_id", "left").where(F.col("unlisted") | ~F.col("expected").eqNullSafe(F.col("found"))).select("chunk_id")


def usage(requests: DataFrame, records: DataFrame, *by: str) -> DataFrame:
    """Tokens and requests per provider; a null count is unknown, not zero.

    requests: by..., requests_started, cache_hits. records: by..., requests (null: 1), input_tokens, output_tokens.
    """
    sums = records.groupBy(*by).agg(
        F.sum(F.coalesce("requests", F.lit(1))).alias("responses_reported"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        F.bool_and(F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()).alias("__known"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = requests.join(sums, list(by), "left").select(*by, "requests_started", "cache_hits", zero("responses_reported"), zero("input_tokens"), zero("output_tokens"), F.coalesce("__known", F.lit(True)).alias("__known"))
    return joined.withColumn("requests_without_reported_usage", F.col("requests_started") - F.col("responses_reported")).withColumn("token_usage_complete", (F.col("requests_started") == F.col("responses_reported")) & F.col("__known")).drop("__known")


def delta(before: DataFrame, after: DataFrame, key: str, *counters: str) -> DataFrame:
    """Counters between two snapshots."""
    old = before.select(key, *[F.col(c).alias(f"__{c}") for c in counters])
    return after.join(old, key, "left").select(key, *[(F.col(c) - F.coalesce(F.col(f"__{c}"), F.lit(0))).alias(c) for c in counters])


def safety(cases: DataFrame, names=None) -> DataFrame:
    """Totals over labelled cases.

    cases: kind (pii, control, attack), text, normalized, values array<string> (normalised). A value is removed if it no
    longer stands in the redacted text once that is normalised: hiding it from a pattern is no removal.
    """
    from corpusloom.functions import guards, redaction
    from corpusloom.functions import text as T
    from corpusloom.shared import written

    cases = cases.withColumns({"__document": redaction.document_policy(F.col("text"), names)["text"], "__query": redaction.query_policy(F.col("normalized"), names)["text"]})
    cases = written(cases, "cases")  # keeps the optimiser from moving Python functions into the sums below
    cases = written(cases.withColumns({"__document_seen": T.normalized(F.col("__document")), "__query_seen": T.normalized(F.col("__query"))}), "cases")
    document, query = F.col("__document"), F.col("__query")
    gone = lambda output: F.size(F.filter("values", lambda v: T.value_removed(v, F.col(output))))
    is_ = lambda k: F.col("kind") == k
    flagged = guards.injection(F.col("normalized"))
    return cases.agg(
        F.count_if(is_("pii")).alias("pii_cases"),
        F.sum(F.when(is_("pii"), F.size("values")).otherwise(0)).alias("expected_values"),
        F.sum(F.when(is_("pii"), gone("__document_seen")).otherwise(0)).alias("baseline_removed"),
        F.sum(F.when(is_("pii"), gone("__query_seen")).otherwise(0)).alias("query_removed"),
        F.count_if(is_("attack")).alias("attacks"),
        F.count_if(is_("attack") & flagged).alias("attacks_caught"),
        F.count_if(is_("control")).alias("controls"),
        F.count_if(is_("control") & flagged).alias("controls_flagged"),
        F.count_if(is_("control") & (document != F.col("text"))).alias("baseline_controls_changed"),
        F.count_if(is_("control") & (query != F.col("normalized"))).alias("query_controls_changed"),
    )
