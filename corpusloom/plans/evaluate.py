"""Variants by questions in one frame: a single ranking serves them all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import models
from corpusloom.functions import strict_json
from corpusloom.operators import answers, retrieval, scoring
from corpusloom.plans import ask
from corpusloom.shared import Settings, counted, written
from corpusloom.sources.files import reported

# What the judge is told, and the names of what it is given.
JUDGE = 'Judge the answer against the reference. Reply with JSON: {"accurate": boolean, "citations": [{"pair": number, "supported": boolean}]} with one entry for each numbered pair, in order.'


def run(questions: DataFrame, corpus: DataFrame, manifest: DataFrame, embedder: Callable[[], models.Embedder], chat: Callable[[], models.Chat], judge: Callable[[], models.Chat], settings: Settings, report_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores per variant and the outcome rows.

    questions: question_id, question, supported, facts array<string>, gold array<struct<chunk_id, sha256, document_id,
    section_heading, excerpt>>. Gold that differs from the corpus stops the run before anything is paid for.
    """
    with reported(questions.sparkSession, report_path, kind="evaluate", variants={}) as figures:
        return _scored(questions, corpus, manifest, embedder, chat, judge, settings, figures)


def _scored(questions: DataFrame, corpus: DataFrame, manifest: DataFrame, embedder: Callable[[], models.Embedder], chat: Callable[[], models.Chat], judge: Callable[[], models.Chat], settings: Settings, figures: dict) -> tuple[DataFrame, DataFrame]:
    gold = questions.select("question_id", F.explode("gold").alias("g")).select("question_id", "g.*")
    if not scoring.gold_errors(gold, corpus, manifest).isEmpty():
        raise ValueError("gold references differ from the indexed corpus")
    ready = written(ask.prepared_questions(questions, settings), "questions")
    most = max(settings.variants.values())
    ranked = written(ask.retrieve(ready, corpus, manifest, embedder, settings, most), "ranked")
    outcomes = None
    for variant, k in settings.variants.items():  # three
        rows = ranked.where(F.col("number") <= k)
        result, _ = ask.answer(ready, rows, chat, scope=variant)
        result = written(result, "variant")
        hits = retrieval.hits(rows, gold)
        excerpted = written(answers.excerpts(rows), "excerpts")
        pairs = written(answers.pairs(result, excerpted), "pairs")
        listed = pairs.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("pair", "claim", "source"))).alias("listed"))
        asked = result.where("status = 'answered'").join(questions.select("question_id", "question", "facts", "gold"), "question_id").join(listed, "question_id", "left")
        payload = F.to_json(F.struct("question", F.col("facts").alias("reference_facts"), F.transform("gold", lambda g: g["excerpt"]).alias("reference_excerpts"), F.transform("claims", lambda c: c["text"]).alias("answer_claims"), F.coalesce(F.size("listed"), F.lit(0)).alias("required_citation_decisions"), F.col("listed").alias("pairs")))
        prompts = asked.select("question_id", F.lit(JUDGE).alias("system"), payload.alias("user")).withColumn("prompt_key", models.prompt_key(F.lit("judge"), F.col("system"), F.col("user")))
        replies, _ = models.cached_chat(prompts, questions.sparkSession.createDataFrame([], f"prompt_key string, {models.REPLY}"), judge)
        judged = replies.where("complete").select("question_id", strict_json.judgment(F.col("text")).alias("judged"))
        counts = pairs.groupBy("question_id").agg(F.count("*").cast("int").alias("pairs"))
        rows = result.join(questions.select("question_id", "supported"), "question_id").join(judged, "question_id", "left").join(counts, "question_id", "left").join(hits, "question_id", "left")
        rows = rows.withColumn("pairs", F.coalesce("pairs", F.lit(0))).withColumn("retrieval_hit", F.coalesce("retrieval_hit", F.lit(False)))
        rows = scoring.judged(rows).withColumn("variant", F.lit(variant)).withColumn("position", F.lit(0))
        seen = figures["variants"][variant] = {}
        rows = counted(rows, "outcomes", seen, outcomes=F.count("*"), failed=F.count_if(F.col("status") == "failed"), answered=F.count_if(F.col("status") == "answered"))
        outcomes = rows if outcomes is None else outcomes.unionByName(rows)
    return scoring.score(questions, outcomes), outcomes
