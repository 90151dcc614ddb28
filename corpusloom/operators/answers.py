"""From retrieved excerpts and a model's output to an answer or a refusal, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import guards, redaction, strict_json
from corpusloom.functions import text as T

# What a refusal says.
NO_EVIDENCE = "Insufficient evidence in the indexed public documents to answer."
NOT_SAFE = "No answer returned because a safety or response validation check failed."
EVIDENCE_REASONS = ("weak_evidence", "unsupported_by_context")
#: What no claim may hold.
_LINK = r"(?iU)https?://|www\.|\[\d+\]"

EXCERPT = "array<struct<number:int,title:string,section:string,text:string>>"


def refusal_message(reason: Column) -> Column:
    return F.when(reason.isin(*EVIDENCE_REASONS), NO_EVIDENCE).otherwise(NOT_SAFE)


def excerpts(retrieved: DataFrame, question_col: str = "question_id") -> DataFrame:
    """Per question: ``documents``, its gated rows in order with redacted title, section and text, and ``context_injection``.

    Excerpt numbers count from 1 in similarity order after the gate. A question's list is bounded by its k.
    """
    place = Window.partitionBy(question_col).orderBy(F.desc("similarity"), "chunk_id")
    safe = {name: redaction.query_policy(F.col(source))["text"] for name, source in (("title", "document_title"), ("section", "section_heading"), ("text", "text"))}
    risky = guards.injection(F.concat_ws("\n", "text", "section_heading", "document_title"))
    rows = retrieved.withColumn("number", F.row_number().over(place)).select(question_col, risky.alias("__risky"), F.struct("number", *[c.alias(n) for n, c in safe.items()]).alias("e"))
    return rows.groupBy(question_col).agg(F.array_sort(F.collect_list("e")).alias("documents"), F.bool_or("__risky").alias("context_injection"))


def prompts(excerpted: DataFrame, question_text: Column, system: str) -> DataFrame:
    """Adds ``system`` and ``user``, the messages to send."""
    return excerpted.withColumn("system", F.lit(system)).withColumn("user", F.concat(F.lit("Question:\n"), question_text, F.lit("\n\nExcerpts:\n"), F.to_json("documents")))


def claim_blocked(claim: Column, documents: Column) -> Column:
    """Blank, with a link or a written reference, or with a source that isn't an excerpt."""
    return ~T.not_blank(claim["text"]) | claim["text"].rlike(_LINK) | F.exists(claim["sources"], lambda n: (n < 1) | (n > documents))


def decided(rows: DataFrame) -> DataFrame:
    """Adds ``reason`` (null: answered), ``status``, ``answer`` and ``claims``.

    rows: n_documents, context_injection, complete (whether the model ended properly), output (its text). The checks
    run in one fixed order and the first that fails decides; of several unsafe claims the first in order does.
    """
    parsed = rows.withColumn("__p", strict_json.answer(F.col("output")))
    claims, n = F.col("__p.claims"), F.col("n_documents")
    violations = F.filter(F.transform(claims, lambda c: guards.output_violation(c["text"])), lambda v: v.isNotNull())
    reason = (
        F.when(F.coalesce(n, F.lit(0)) == 0, "weak_evidence")
        .when(F.coalesce("context_injection", F.lit(False)), "context_injection")
        .when(~F.coalesce("complete", F.lit(False)), "incomplete_or_filtered_output")
        .when(F.col("__p").isNull(), "invalid_output")
        .when(~F.col("__p.supported") & (F.size(claims) == 0), "unsupported_by_context")
        .when(~F.col("__p.supported"), "invalid_output")
        .when((F.size(claims) == 0) | F.exists(claims, lambda c: claim_blocked(c, n)), "invalid_citations")
        .otherwise(F.get(violations, F.lit(0)))
    )
    known = parsed.withColumn("reason", reason)
    rendered = F.transform(claims, lambda c: F.struct(redaction.query_policy(c["text"])["text"].alias("text"), F.array_sort(F.array_distinct(c["sources"])).alias("sources")))
    answered = F.col("reason").isNull()
    out = known.withColumn("claims", F.when(answered, rendered).otherwise(F.array().cast("array<struct<text:string,sources:array<int>>>")))
    return out.withColumn("status", F.when(answered, "answered").otherwise("refused")).withColumn("answer", F.when(answered, T.answer_text(F.col("claims"))).otherwise(refusal_message(F.col("reason")))).drop("__p")


def input_injection(questions: DataFrame, text_col: str = "question") -> DataFrame:
    """Questions split by a guard before anything is paid for: adds ``normalized`` and ``blocked``."""
    return T.normalize_column(questions, text_col).withColumn("blocked", guards.injection(F.col("normalized")))


def citations(answered: DataFrame, retrieved: DataFrame, question_col: str = "question_id") -> DataFrame:
    """One row per source number that an answer refers to: metadata redacted, anchor dropped if personal, with the URL to cite."""
    numbers = answered.where("status = 'answered'").select(question_col, F.explode(F.array_sort(F.array_distinct(F.flatten(F.transform("claims", lambda c: c["sources"]))))).alias("number"))
    anchor = F.when(~redaction.found(redaction.query_policy(F.col("anchor"))), F.col("anchor"))
    rows = numbers.join(retrieved, [question_col, "number"]).withColumn("anchor", anchor)
    for name in ("document_title", "section_heading"):
        rows = rows.withColumn(name, redaction.query_policy(F.col(name))["text"])
    return rows.withColumn("url", T.citation_url(F.col("source_url"), F.col("page"), F.col("anchor")))


def pairs(answered: DataFrame, excerpted: DataFrame, question_col: str = "question_id") -> DataFrame:
    """Claim and source pairs to judge, numbered from 1 by claim and then by source as the answer lists them."""
    flat = answered.select(question_col, F.posexplode("claims").alias("claim_at", "c")).select(question_col, "claim_at", F.col("c.text").alias("claim"), F.posexplode("c.sources").alias("source_at", "number"))
    texts = excerpted.select(question_col, F.explode("documents").alias("d")).select(question_col, "d.number", F.col("d.text").alias("source"))
    order = Window.partitionBy(question_col).orderBy("claim_at", "source_at")
    return flat.join(texts, [question_col, "number"]).withColumn("pair", F.row_number().over(order)).select(question_col, "pair", "claim", "number", "source")
