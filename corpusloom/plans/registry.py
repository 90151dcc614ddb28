"""Registered queries over the supplied tables, and the same in SQL where SQL can say it.

The tables stand in for the pipeline's own: documents for sections and chunks,
embeddings for the vector table (label as document), pages for raw HTML,
conversations for questions, events for telemetry, labels for judgments.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import guards, redaction, strict_json
from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import answers, chunking, ingest, retrieval, scoring, sections, store, telemetry
from corpusloom.operators.snapshots import SnapshotTable
from corpusloom.plans import fixtures, oracles
from corpusloom.shared import Settings, shared_dir
from corpusloom.sources import manifest as M
from corpusloom.streaming import telemetry as live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SETTINGS = Settings()


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- vectors ---------------------------------------------------------------

#: Queries are the rows whose id is divisible by 50; candidates are all rows.
_RANKED = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0),
s AS (SELECT q.vec_id AS question_id, c.vec_id AS chunk_id, q.label AS question_label, c.label AS chunk_label, list_inner_product(q.e, c.e) / sqrt(list_inner_product(q.e, q.e) * list_inner_product(c.e, c.e)) AS sim FROM v q, v c WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, chunk_id) AS number FROM s)
"""


def _ranked(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf_dir, "embeddings")
    asked = e.where(F.pmod("vec_id", F.lit(50)) == 0).select(F.col("vec_id").alias("question_id"), "embedding", "label")
    return e, retrieval.top_k(asked, e.withColumnRenamed("vec_id", "chunk_id"), k, SETTINGS.dimension)


@query(_RANKED + "SELECT question_id, chunk_id, number::INT AS number, round(sim, 4) AS similarity FROM r WHERE number <= 6")
def cosine_topk(spark, sf_dir):
    _, ranked = _ranked(spark, sf_dir, SETTINGS.top_k)
    return ranked.withColumn("similarity", F.round("similarity", 4))


@query(_RANKED + "SELECT question_id, chunk_id, number::INT AS number, round(sim, 4) AS similarity FROM r WHERE number <= 6 AND sim >= 0.30")
def similarity_gate(spark, sf_dir):
    _, ranked = _ranked(spark, sf_dir, SETTINGS.top_k)
    return retrieval.gated(ranked, SETTINGS.min_similarity).withColumn("similarity", F.round("similarity", 4))


@query(_RANKED + "SELECT variant, question_id, count(*) AS retrieved FROM r JOIN (VALUES ('baseline', 6), ('wider', 10), ('focused', 3)) t(variant, k) ON number <= k WHERE sim >= 0.30 GROUP BY 1, 2")
def topk_variants(spark, sf_dir):
    _, ranked = _ranked(spark, sf_dir, max(SETTINGS.variants.values()))
    return retrieval.by_variant(ranked, SETTINGS.variants, SETTINGS.min_similarity).groupBy("variant", "question_id").agg(F.count("*").alias("retrieved"))


@query(_RANKED.replace("WHERE q.vec_id % 50 = 0", "WHERE q.vec_id % 50 = 0 AND c.label IN (0, 2, 4)") + "SELECT question_id, chunk_id, number::INT AS number FROM r WHERE number <= 6")
def manifest_restriction(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    allowed = spark.createDataFrame([(0,), (2,), (4,)], "label int")
    asked = e.where(F.pmod("vec_id", F.lit(50)) == 0).select(F.col("vec_id").alias("question_id"), "embedding")
    return retrieval.top_k(asked, retrieval.restricted(e, allowed, "label").withColumnRenamed("vec_id", "chunk_id"), SETTINGS.top_k, SETTINGS.dimension).select("question_id", "chunk_id", "number")


@query(_RANKED + "SELECT question_id, bool_or(number <= 6 AND chunk_label = question_label AND chunk_id <> question_id) AS retrieval_hit FROM r GROUP BY 1")
def retrieval_hit(spark, sf_dir):
    """A question is hit if a neighbour of its own label is found; its gold chunks are the others of that label."""
    e, ranked = _ranked(spark, sf_dir, SETTINGS.top_k)
    labels = e.select(F.col("vec_id").alias("id"), "label")
    own = ranked.join(labels.select(F.col("id").alias("question_id"), F.col("label").alias("want")), "question_id").join(labels.select(F.col("id").alias("chunk_id"), F.col("label").alias("got")), "chunk_id")
    return own.groupBy("question_id").agg(F.bool_or((F.col("want") == F.col("got")) & (F.col("chunk_id") != F.col("question_id"))).alias("retrieval_hit"))


@query(_RANKED + "SELECT question_id, bool_or(number <= 6 AND chunk_id = CASE WHEN question_id % 100 = 0 THEN question_id ELSE question_id + 1 END) AS retrieval_hit FROM r GROUP BY 1")
def gold_hits(spark, sf_dir):
    """The gold chunk of every other question is the question itself, which is found, or else the chunk after it."""
    _, ranked = _ranked(spark, sf_dir, SETTINGS.top_k)
    asked = ranked.select("question_id").distinct()
    gold = asked.select("question_id", F.when(F.pmod("question_id", F.lit(100)) == 0, F.col("question_id")).otherwise(F.col("question_id") + 1).alias("chunk_id"))
    return retrieval.hits(ranked, gold)


@query("SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS valid FROM embeddings")
def vector_validity(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", V.valid(F.col("embedding"), SETTINGS.dimension).alias("valid"))


# --- ingest ----------------------------------------------------------------


def _chunks(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source").withColumn("content_hash", T.sha256(F.col("text")))


def _stored(chunks):
    """What an earlier run embedded: the German and French documents."""
    return chunks.where(F.col("lang").isin("de", "fr")).select("content_hash").distinct()


_HASHED = "WITH h AS (SELECT doc_id AS document_id, coalesce(text, '') AS text, lang, source, sha256(coalesce(text, '')) AS content_hash FROM documents), st AS (SELECT DISTINCT content_hash FROM h WHERE lang IN ('de', 'fr')) "


@query(_HASHED + "SELECT content_hash, max(document_id) AS document_id FROM h GROUP BY 1")
def content_dedupe(spark, sf_dir):
    return ingest.last_per_hash(_chunks(spark, sf_dir).select("content_hash", "document_id"), "document_id")


@query(_HASHED + "SELECT DISTINCT content_hash FROM h WHERE content_hash NOT IN (SELECT content_hash FROM st)")
def cache_anti_join(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return ingest.pending(c, _stored(c))


@query(_HASHED + ", p AS (SELECT count(DISTINCT content_hash) AS pending FROM h WHERE content_hash NOT IN (SELECT content_hash FROM st)) SELECT (SELECT count(*) FROM h) AS total, pending, (SELECT count(*) FROM h) - pending AS reused, ceil(pending / 16.0)::BIGINT AS batches, ceil(pending / 16.0) <= 40 AS within_budget FROM p")
def batch_budget(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return ingest.budget(c, _stored(c), SETTINGS)


@query(_HASHED + ", p AS (SELECT DISTINCT content_hash FROM h WHERE content_hash NOT IN (SELECT content_hash FROM st)), n AS (SELECT content_hash, row_number() OVER (ORDER BY content_hash) - 1 AS position FROM p) SELECT content_hash, position, position // 16 AS batch FROM n")
def embedding_batches(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return ingest.batches(ingest.pending(c, _stored(c)), SETTINGS)


@query(_HASHED + "SELECT document_id, content_hash, lang FROM h WHERE lang <> 'es' UNION ALL SELECT document_id, sha256(text || ' revised'), lang FROM h WHERE lang = 'es'")
def replace_document(spark, sf_dir):
    """Spanish documents arrive anew with changed texts; the others stay."""
    c = _chunks(spark, sf_dir)
    new = c.where("lang = 'es'").withColumn("content_hash", T.sha256(F.concat("text", F.lit(" revised"))))
    keep = ("document_id", "content_hash", "lang")
    return store.upserted(c.select(*keep), new.select(*keep))


@query(_HASHED + "SELECT document_id, content_hash FROM h WHERE source IN (SELECT DISTINCT source FROM h WHERE source < 'src15')")
def prune_documents(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return store.pruned(c, c.where("source < 'src15'").select("source").distinct(), "source").select("document_id", "content_hash")


@query(
    "WITH c AS (SELECT coalesce(source, 'none') AS document_id, doc_id AS chunk_id, sha256(coalesce(text, '')) AS content_hash, sha256(coalesce(text, '') || ' revised') AS revised, lang, crc FROM (SELECT *, ascii(right(coalesce(source, 'none'), 1)) % 4 AS crc FROM documents)) "
    "SELECT 1 AS version, document_id, chunk_id, content_hash FROM c WHERE crc <> 0 UNION ALL SELECT 2, document_id, chunk_id, content_hash FROM c WHERE crc = 3 UNION ALL SELECT 2, document_id, chunk_id, revised FROM c WHERE crc = 2 AND chunk_id % 3 <> 0 UNION ALL SELECT 2, document_id, chunk_id, content_hash FROM c WHERE crc = 0"
)
def snapshot_replace(spark, sf_dir):
    """Sources as documents in three quarters of a table; one commit then revises one quarter, without every third chunk, adds the missing one and prunes another; both snapshots are read."""
    group = F.ascii(F.substring("document_id", -1, 1)) % 4
    c = read(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("document_id"), F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("g", group)
    first = c.where("g <> 0").select("document_id", "chunk_id", T.sha256(F.col("text")).alias("content_hash"))
    text = F.when(F.col("g") == 2, F.concat("text", F.lit(" revised"))).otherwise(F.col("text"))
    second = c.where("g = 0 OR g = 2 AND chunk_id % 3 <> 0").select("document_id", "chunk_id", T.sha256(text).alias("content_hash"))
    table = SnapshotTable(spark, f"{shared_dir(spark).rstrip('/')}/snapshots-{uuid.uuid4().hex}", buckets=16)
    was = table.change(first)
    now = table.change(second, c.where("g <> 1").select("document_id").distinct())
    return table.rows(was.version).select(F.lit(1).alias("version"), "*").unionByName(table.rows(now.version).select(F.lit(2).alias("version"), "*"))


@query("SELECT count(*) AS rows FROM documents")
def row_count(spark, sf_dir):
    return read(spark, sf_dir, "documents").agg(F.count("*").alias("rows"))


@query(
    "WITH h AS (SELECT doc_id::VARCHAR AS id, sha256(coalesce(text, '')) AS hash FROM documents), b AS (SELECT substr(sha256(id), 1, 3) AS b, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY line)) AS d FROM (SELECT id, id || chr(9) || hash AS line FROM h) GROUP BY 1) SELECT sum(n)::BIGINT AS rows, sha256(string_agg(d, chr(10) ORDER BY b)) AS digest FROM b"
)
def corpus_digest(spark, sf_dir):
    return store.corpus_digest(_chunks(spark, sf_dir), "document_id")


# --- text, redaction, guards ------------------------------------------------


@query("SELECT 'documents' AS origin, count(*) AS n, count(CASE WHEN strlen(text) <= 2000 AND regexp_matches(text, '\\S') THEN 1 END) AS fits FROM documents UNION ALL SELECT 'conversations', count(*), count(CASE WHEN strlen(text) <= 2000 AND regexp_matches(text, '\\S') THEN 1 END) FROM conversations")
def byte_length_gate(spark, sf_dir):
    def one(name):
        return read(spark, sf_dir, name).agg(F.lit(name).alias("origin"), F.count("*").alias("n"), F.count_if(T.within_bytes(F.col("text"), SETTINGS.query_max_bytes)).alias("fits"))

    return one("documents").unionByName(one("conversations"))


_SPACES = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(f"SELECT doc_id, trim(regexp_replace(text, '{_SPACES}', ' ', 'g')) AS text FROM documents")
def whitespace_clean(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.clean(F.col("text")).alias("text"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE text || ' & <b> fi 1' END AS normalized FROM conversations")
def normalized_text(spark, sf_dir):
    """Every other turn is disguised: wide letters, entities, a ligature, a superscript, a mark without width and a bell. All of it goes."""
    wide = F.concat(F.translate("text", "aeorst", "ａｅｏｒｓｔ"), F.lit(" &amp; &lt;b\u200b&#62; \ufb01\x07 \u00b9"))
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(wide).alias("text"))
    return T.normalize_column(c, "text").select("conv_id", "turn", "normalized")


_B, _A = r"(?:^|[^\pL\pN_])", r"(?:$|[^\pL\pN_])"
_IP = r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\b[A-Za-z0-9!#$%&''*+/=?^_`{|}~.-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b')) AS emails, regexp_replace(text, '\b[A-Za-z0-9!#$%&''*+/=?^_`{|}~.-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b', '<EMAIL_ADDRESS>', 'g') AS text FROM documents")
def email_redact(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.regexp_count("text", F.lit(redaction.EMAIL)).cast("long").alias("emails"), F.regexp_replace("text", redaction.EMAIL, "<EMAIL_ADDRESS>").alias("text"))


@query(oracles.PII_REDACT)
def pii_redact(spark, sf_dir):
    d = redaction.redacted(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", text="text")
    return d.select("doc_id", "text", F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, b: a + b).alias("redactions"))


@query(oracles.PII_COUNTS)
def pii_counts(spark, sf_dir):
    d = redaction.redacted(read(spark, sf_dir, "documents").select("text"), "text")
    return d.select(F.explode("counts").alias("entity", "n")).groupBy("entity").agg(F.sum("n").alias("n"))


@query(oracles.query_redaction(fixtures.QUESTIONS))
def query_redaction(spark, sf_dir):
    c = T.normalize_column(read(spark, sf_dir, "conversations").unionByName(fixtures.questions(spark)), "text")
    c = redaction.redacted(c, "normalized", redaction.QUERY_STEPS, text="text")
    return c.select("conv_id", "turn", "text", F.to_json("counts").alias("counts"))


_INJECTION = " OR ".join(
    f"regexp_matches(text, '{p}', 'is')"
    for p in (
        _B + "(?:ignore|disregard|forget)(?:[^\\pL\\pN_].{0,58})?[^\\pL\\pN_](?:instructions|rules|system prompt)" + _A,
        _B + "(?:reveal|show|print|repeat|display|expose)(?:[^\\pL\\pN_].{0,48})?[^\\pL\\pN_](?:system|developer) (?:prompt|instructions|message)" + _A,
        _B + "(?:override|bypass|disable)(?:[^\\pL\\pN_].{0,38})?[^\\pL\\pN_](?:guardrails|safety|policy|filters)" + _A,
        r"<\|(?:im_start|system|developer)\|>|\[INST\]|</?(?:system|developer)>|(?:^|\n)\s*(?:SYSTEM|DEVELOPER)\s*:",
        _B + "(?:send|upload|exfiltrate)(?:[^\\pL\\pN_].{0,98})?[^\\pL\\pN_](?:secret|credentials|api key|environment)" + _A,
        _B + "(?:pretend|act)(?:[^\\pL\\pN_].{0,23})?[^\\pL\\pN_](?:unrestricted|unfiltered|jailbroken)" + _A,
    )
)


@query(f"WITH t AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations UNION ALL SELECT id, text FROM ({fixtures.ATTACK_SQL})) SELECT id, coalesce({_INJECTION}, false) AS flagged FROM t")
def injection_flags(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    rows = rows.unionByName(read(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), "text"))
    rows = rows.unionByName(fixtures.attacks(spark))
    return T.normalize_column(rows, "text").select("id", guards.injection(F.col("normalized")).alias("flagged"))


@query(oracles.output_violations(_INJECTION))
def output_violations(spark, sf_dir):
    rows = T.normalize_column(read(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", guards.output_violation(F.col("normalized")).alias("violation"))


@query()
def safety_totals(spark, sf_dir):
    return scoring.safety(fixtures.cases(spark), redaction.NAMES)


# --- sections and chunks ----------------------------------------------------


@query()
def html_sections(spark, sf_dir):
    """The supplied pages hold an article instead of a main landmark."""
    return sections.sections(read(spark, sf_dir, "pages"), "page_id", "html", "article")


def _sections(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("document_id"), F.lit(0).alias("section"), F.col("source").alias("document_title"), F.col("lang").alias("section_heading"), "text")


@query()
def chunk_documents(spark, sf_dir):
    return chunking.chunks(_sections(spark, sf_dir), SETTINGS).select("document_id", "section", "part", "chunk_id", "content_hash", "text")


@query()
def prepared_chunks(spark, sf_dir):
    rows = chunking.prepared(chunking.chunks(_sections(spark, sf_dir), SETTINGS), SETTINGS)
    return rows.select("chunk_id", "content_hash", "prompt_ok", F.to_json("redactions").alias("redactions"))


@query()
def per_document_counts(spark, sf_dir):
    return chunking.per_document(chunking.prepared(chunking.chunks(_sections(spark, sf_dir), SETTINGS), SETTINGS))


@query("SELECT doc_id AS document_id, sha256(doc_id || ':0:0') AS chunk_id FROM documents")
def chunk_ids(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), T.chunk_id(F.col("doc_id").cast("string"), F.lit(0), F.lit(0)).alias("chunk_id"))


# --- sources ----------------------------------------------------------------


@query("SELECT page_id, regexp_matches(url, '^https://(?:[a-z0-9-]+\\.)*example\\.org(?::443)?(?:[/?#]|$)') AS allowed FROM pages")
def url_allowlist(spark, sf_dir):
    """https pages of example.org hosts."""
    p = read(spark, sf_dir, "pages")
    host = F.try_parse_url(F.col("url"), F.lit("HOST"))
    own = F.when(host.rlike(r"^([a-z0-9-]+\.)*example\.org$"), host)
    return p.select("page_id", M.url_allowed(F.col("url"), F.array(own)).alias("allowed"))


@query()
def source_validation(spark, sf_dir):
    return M.checked(fixtures.sources(spark)).select("document_id", "source_url", F.array_join("errors", ",").alias("errors"))


@query(
    "SELECT page_id, regexp_replace(url, '#.*$', '') || '#page=' || (page_id % 7 + 1) AS by_page, regexp_replace(url, '#.*$', '') || '#' || replace(url_encode(url || ' é+~*'), '%3A', ':') AS by_anchor, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '#.*$', '') ELSE regexp_replace(url, '#.*$', '') || '#own' END AS as_is FROM pages"
)
def citation_urls(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    page = (F.pmod("page_id", F.lit(7)) + 1).cast("int")
    none, anchor = F.lit(None).cast("int"), F.concat("url", F.lit(" é+~*"))
    own = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.pmod("page_id", F.lit(2)) == 0, "#").otherwise("#own"))
    return p.select("page_id", T.citation_url(F.col("url"), page, F.lit(None)).alias("by_page"), T.citation_url(F.col("url"), none, anchor).alias("by_anchor"), T.citation_url(own, none, F.lit(None).cast("string")).alias("as_is"))


@query()
def request_gate(spark, sf_dir):
    return telemetry.request_status(fixtures.requests(spark)).select("name", "http_status", "question")


# --- answers and scores -----------------------------------------------------


@query()
def json_strict(spark, sf_dir):
    return fixtures.outputs(spark).select("name", strict_json.answer(F.col("output")).isNotNull().alias("valid"))


@query()
def answer_ladder(spark, sf_dir):
    return answers.decided(fixtures.ladder(spark)).select("name", "status", "reason", "answer")


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_extract(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(strict_json.parsed(F.col("props")), "$.k", "bigint").alias("k"))


@query(
    "WITH q AS (SELECT doc_id, doc_id % 7 <> 0 AS supported FROM documents), o AS (SELECT doc_id, quality, toxic FROM labels), r AS (SELECT supported, coalesce(quality = 1, false) AS hit, coalesce(toxic = 0, false) AS accurate, coalesce(toxic, 0) AS pairs, CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END AS good, quality = 0 AND toxic = 0 AS refused FROM q LEFT JOIN o USING (doc_id)) SELECT 'baseline' AS variant, count(CASE WHEN supported AND hit THEN 1 END) AS hits, count(CASE WHEN supported THEN 1 END) AS supported, round(count(CASE WHEN supported AND hit THEN 1 END) / count(CASE WHEN supported THEN 1 END), 6) AS hit_rate, round(count(CASE WHEN supported AND accurate THEN 1 END) / count(CASE WHEN supported THEN 1 END), 6) AS accuracy, round(sum(good) / nullif(sum(pairs), 0), 6) AS citation_rate, count(CASE WHEN NOT supported AND refused THEN 1 END) AS refusals, (SELECT count(*) FROM o WHERE quality = 0 AND toxic = 1) AS failed FROM r"
)
def label_scores(spark, sf_dir):
    """Documents as questions, labels as outcomes."""
    q = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), (F.pmod("doc_id", F.lit(7)) != 0).alias("supported"))
    o = read(spark, sf_dir, "labels").select(
        F.lit("baseline").alias("variant"), F.col("doc_id").alias("question_id"), F.lit(0).alias("position"),
        F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "failed").when(F.col("quality") == 0, "refused").otherwise("answered").alias("status"),
        (F.col("quality") == 1).alias("retrieval_hit"), (F.col("toxic") == 0).alias("accurate"), F.col("toxic").alias("citation_pairs"),
        F.when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).otherwise(0).alias("supported_pairs"), F.lit(False).alias("judge_missing"),
    )
    s = scoring.score(q, o)
    rate = lambda c: F.round(f"{c}.rate", 6)
    return s.select("variant", F.col("retrieval_hit.numerator").alias("hits"), F.col("retrieval_hit.denominator").alias("supported"), rate("retrieval_hit").alias("hit_rate"), rate("answer_accuracy").alias("accuracy"), rate("citation_correctness").alias("citation_rate"), F.col("unsupported_refusal.numerator").alias("refusals"), F.col("failed_questions").alias("failed"))


@query("SELECT role, count(*) AS responses_reported, sum(coalesce(CASE WHEN turn % 5 = 0 THEN NULL ELSE length(text) END, 0))::BIGINT AS input_tokens, sum(turn)::BIGINT AS output_tokens, count(*) + 1 AS requests_started, 1::BIGINT AS requests_without_reported_usage, false AS token_usage_complete FROM conversations GROUP BY role")
def usage_ledger(spark, sf_dir):
    """Turns as model calls; every fifth turn doesn't report its input."""
    c = read(spark, sf_dir, "conversations")
    records = c.select("role", F.lit(None).cast("long").alias("requests"), F.when(F.col("turn") % 5 != 0, F.length("text").cast("long")).alias("input_tokens"), F.col("turn").alias("output_tokens"))
    requests = c.groupBy("role").agg((F.count("*") + 1).alias("requests_started"), F.lit(0).cast("long").alias("cache_hits"))
    return scoring.usage(requests, records, "role").drop("cache_hits")


@query("SELECT DISTINCT lang, source FROM documents WHERE source IN (SELECT source FROM documents WHERE lang = 'de')")
def gold_intersection(spark, sf_dir):
    """Pairs retrieved that are also gold, by semi-join."""
    d = read(spark, sf_dir, "documents").select("lang", "source").distinct()
    return d.join(d.where("lang = 'de'").select("source"), "source", "left_semi").select("lang", "source")


@query("SELECT item_id, sha256(text) AS excerpt_hash, sha256(text) IN (SELECT sha256(text) FROM documents) AS indexed FROM benchmark")
def gold_validation(spark, sf_dir):
    """Benchmark passages that stand in the corpus as whole texts."""
    b = read(spark, sf_dir, "benchmark").select("item_id", T.sha256(F.col("text")).alias("excerpt_hash"))
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL").select(T.sha256(F.col("text")).alias("excerpt_hash")).distinct().withColumn("found", F.lit(True))
    return b.join(d, "excerpt_hash", "left").select("item_id", "excerpt_hash", F.coalesce("found", F.lit(False)).alias("indexed"))


@query("SELECT doc_id AS chunk_id FROM documents WHERE doc_id % 13 = 5 OR doc_id % 10 = 3 OR doc_id % 17 = 2 OR source IS NULL OR source = (SELECT max(source) FROM documents)")
def gold_faults(spark, sf_dir):
    """Whole texts as gold excerpts; chunks that aren't stored, another heading, another text and a source outside the manifest are faults."""
    d = read(spark, sf_dir, "documents")
    fault = lambda n, r: F.pmod("doc_id", F.lit(n)) == r
    manifest = d.select("source").distinct().join(d.agg(F.max("source").alias("source")), "source", "left_anti").select(F.col("source").alias("document_id"), F.concat(F.lit("https://"), "source").alias("source_url"), F.lit("r").alias("regulator"), F.col("source").alias("title"))
    gold = d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.sha2("text", 256).alias("sha256"), F.col("lang").alias("section_heading"), F.col("text").alias("excerpt"))
    stored = d.where(~fault(13, 5)).select(
        F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("content_hash"), F.col("source").alias("document_id"), F.when(fault(10, 3), "another").otherwise(F.col("lang")).alias("section_heading"),
        F.when(fault(17, 2), "another").otherwise(F.col("text")).alias("text"), F.concat(F.lit("https://"), "source").alias("source_url"), F.lit("r").alias("regulator"), F.col("source").alias("document_title"),
    )
    return scoring.gold_errors(gold, stored, manifest)


@query("SELECT lang, sha256('{\"backend\":\"local\",\"dimension\":\"64\",\"model\":\"' || lang || '\"}') AS fingerprint FROM (SELECT DISTINCT lang FROM documents)")
def fingerprints(spark, sf_dir):
    langs = read(spark, sf_dir, "documents").select("lang").distinct()
    return langs.select("lang", T.fingerprint(model=F.col("lang"), backend=F.lit("local"), dimension=F.lit("64")).alias("fingerprint"))


# --- telemetry --------------------------------------------------------------

#: events as calls: the type decides stage and outcome.
_CALLS_SQL = """
WITH t AS (SELECT list_sort(list(DISTINCT event_type)) AS types FROM events),
c AS (SELECT event_id, ts, user_id, value, ['parse', 'chunk', 'embed', 'query'][list_position(types, event_type) % 4 + 1] AS stage, CASE WHEN user_id % 2 = 0 THEN 'dev' ELSE 'prod' END AS environment,
  CASE WHEN event_id % 97 = 0 THEN 500 WHEN event_id % 89 = 0 THEN 409 WHEN event_id % 53 = 0 THEN 400 ELSE 200 END AS code, event_id % 11 = 0 AS refuses, abs(value) * 100 AS latency FROM events, t),
i AS (SELECT *, code IN (409, 500) AS error, code = 400 AS rejected, code NOT IN (409, 500, 400) AND refuses AND stage = 'query' AS refused FROM c)
"""


def _calls(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    types = e.agg(F.array_sort(F.collect_set("event_type")).alias("types"))  # one row of a few types
    place = F.array_position("types", F.col("event_type")) % 4
    stage = F.element_at(F.array(*map(F.lit, telemetry.STAGES)), (place + 1).cast("int"))
    body = F.when(F.col("event_id") % 11 == 0, F.lit('{"status": "refused", "reason": "input_injection", "retrieved": [1, 2]}')).otherwise(F.lit('{"status": "answered", "retrieved": [1]}'))
    code = F.when(F.col("event_id") % 97 == 0, 500).when(F.col("event_id") % 89 == 0, 409).when(F.col("event_id") % 53 == 0, 400).otherwise(200)
    # the types are one bounded row: read once, then a constant
    listed = types.first()["types"]
    e = e.withColumn("types", F.lit(listed) if listed else F.array().cast("array<string>"))
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"), "event_id", stage.alias("stage"), F.when(F.col("user_id") % 2 == 0, "dev").otherwise("prod").alias("environment"), code.alias("status_code"),
        F.when(stage == "query", body).alias("body"), F.lit(False).alias("failed"), (F.abs("value") * 100).alias("latency_ms"), F.lpad(F.hex("event_id"), 32, "0").alias("invocation_id"),
    )


def _events(spark, sf_dir):
    return telemetry.invocation_events(_calls(spark, sf_dir))


@query(_CALLS_SQL + "SELECT stage, environment, CASE WHEN error THEN 'error' WHEN rejected THEN 'rejected' WHEN refused THEN 'refused' WHEN stage = 'query' THEN 'answered' ELSE 'completed' END AS status, count(*) AS n, sum(refused::INT)::BIGINT AS guardrail_blocks, sum(CASE WHEN stage = 'query' THEN CASE WHEN refuses THEN 2 ELSE 1 END ELSE 0 END)::BIGINT AS retrieved FROM i GROUP BY ALL")
def invocation_events(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("stage", "environment", "status").agg(F.count("*").alias("n"), F.sum("guardrail_blocks").alias("guardrail_blocks"), F.sum("retrieved_chunks").alias("retrieved"))


_STATS_SQL = _CALLS_SQL + """
, m AS (SELECT time_bucket(INTERVAL 60 SECONDS, ts) AS period_start, environment, stage, unnest(['errors', 'latency_ms', 'refusals', 'requests', 'guardrail_blocks', 'rejected_requests', 'retrieved_chunks']) AS metric,
  unnest([error::INT::DOUBLE, round(latency, 3), refused::INT::DOUBLE, 1.0, refused::INT::DOUBLE, rejected::INT::DOUBLE, CASE WHEN stage <> 'query' THEN 0.0 WHEN refuses THEN 2.0 ELSE 1.0 END]) AS value FROM i),
s AS (SELECT period_start, environment, stage, metric, sum(value) AS total, avg(value) AS average, count(*) AS sample_count, min(value) AS minimum, max(value) AS maximum FROM m GROUP BY ALL)
"""


_ROUNDED = "period_start, environment, stage, metric, sample_count, round(total, 2) AS total, round(average, 4) AS average, round(minimum, 2) AS minimum, round(maximum, 2) AS maximum FROM s"


def _rounded(stats: DataFrame) -> DataFrame:
    values = [F.round(c, n).alias(name) for c, n, name in (("sum", 2, "total"), ("average", 4, "average"), ("minimum", 2, "minimum"), ("maximum", 2, "maximum"))]
    return stats.select(F.col("period_start").cast("timestamp_ntz").alias("period_start"), "environment", "stage", "metric", "sample_count", *values)


@query(_STATS_SQL + f"SELECT {_ROUNDED}")
def metric_windows(spark, sf_dir):
    return _rounded(telemetry.statistics(telemetry.metric_values(_events(spark, sf_dir))))


@query(_STATS_SQL + "SELECT period_start, environment, stage, metric, CASE WHEN metric = 'errors' THEN total > 0 ELSE average > 30000 END AS breach FROM s WHERE metric IN ('errors', 'latency_ms')")
def alarm_states(spark, sf_dir):
    s = telemetry.alarm_states(telemetry.statistics(telemetry.metric_values(_events(spark, sf_dir))), telemetry.alarm_table(spark))
    return s.select(F.col("period_start").cast("timestamp_ntz").alias("period_start"), "environment", "stage", "metric", (F.col("state") == "ALARM").alias("breach"))


@query(_STATS_SQL + ", a AS (SELECT DISTINCT environment, stage, metric, period_start FROM s WHERE metric = 'errors' AND total > 0 OR metric = 'latency_ms' AND average > 30000), e AS (SELECT *, lag(period_start) OVER w AS before, lead(period_start) OVER w AS after FROM a WINDOW w AS (PARTITION BY environment, stage, metric ORDER BY period_start)) SELECT environment, stage, metric, period_start AS at, 'ALARM' AS to_state FROM e WHERE before IS NULL OR before + INTERVAL 60 SECONDS < period_start UNION ALL SELECT environment, stage, metric, period_start + INTERVAL 60 SECONDS, 'OK' FROM e WHERE after IS NULL OR period_start + INTERVAL 60 SECONDS < after")
def alarm_transitions(spark, sf_dir):
    states = telemetry.alarm_states(telemetry.statistics(telemetry.metric_values(_events(spark, sf_dir))), telemetry.alarm_table(spark))
    return telemetry.alarm_transitions(states).select("environment", "stage", "metric", F.col("at").cast("timestamp_ntz").alias("at"), "to_state")


@query(_CALLS_SQL + "SELECT environment, stage, 'errors' AS metric, sum(error::INT)::DOUBLE AS metric_total, CASE stage WHEN 'embed' THEN NULL WHEN 'chunk' THEN sum(error::INT) + 1 WHEN 'parse' THEN sum(error::INT) + 0.05 ELSE sum(error::INT) END::DOUBLE AS log_total, CASE stage WHEN 'embed' THEN 'missing' WHEN 'chunk' THEN 'differ' ELSE 'agree' END AS verdict FROM i GROUP BY environment, stage")
def reconciliation(spark, sf_dir):
    """Errors by metric and by log, whose side lacks a stage, is one too high in another and within the tolerance in a third."""
    key = ["environment", "stage"]
    metrics = telemetry.metric_values(_events(spark, sf_dir)).where("metric = 'errors'").groupBy(*key, "metric").agg(F.sum("value").alias("total"))
    found = F.sum(F.when(F.col("status_code").isin(409, 500), 1.0).otherwise(0.0))
    off = F.when(F.col("stage") == "chunk", 1.0).when(F.col("stage") == "parse", 0.05).otherwise(0.0)
    logs = _calls(spark, sf_dir).where("stage <> 'embed'").groupBy(*key).agg(found.alias("total")).withColumn("total", F.col("total") + off).withColumn("metric", F.lit("errors"))
    return telemetry.reconciled(metrics, logs)


@query("SELECT event_id FROM events WHERE contains(props, '13')")
def log_privacy(spark, sf_dir):
    return telemetry.leaks(read(spark, sf_dir, "events").select("event_id", F.col("props").alias("message")), ["13"]).select("event_id")


#: What a stream has given out when its watermark stands two minutes before the last event.
_PASSED = "INTERVAL 60 SECONDS <= (SELECT max(ts) FROM events) - INTERVAL 2 MINUTES"


def _streamed(spark, sf_dir, flow) -> DataFrame:
    """Everything that a stream over the events file gives out in append mode until all of it is read."""
    name = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    _events(spark, sf_dir).write.parquet(f"{name}-in")
    out = flow(spark.readStream.schema(spark.read.parquet(f"{name}-in").schema).parquet(f"{name}-in"))
    with live.stored_state(spark):
        out.writeStream.outputMode("append").option("checkpointLocation", f"{name}-state").trigger(availableNow=True).format("parquet").start(f"{name}-out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{name}-out")


@query(_STATS_SQL + f"SELECT {_ROUNDED} WHERE period_start + {_PASSED}")
def streamed_statistics(spark, sf_dir):
    """The same statistics by Structured Streaming, in append mode: all but the windows the watermark leaves open."""
    return _rounded(_streamed(spark, sf_dir, live.statistics))


@query(f"WITH t AS ({SQL['alarm_transitions']}) SELECT * FROM t WHERE t.\"at\" + {_PASSED}")
def streamed_transitions(spark, sf_dir):
    """Alarm transitions by a stateful operator: all but those of periods the watermark leaves open."""
    moves = _streamed(spark, sf_dir, lambda e: live.transitions(live.alarm_states(e, telemetry.alarm_table(spark))))
    return moves.select("environment", "stage", "metric", F.col("at").cast("timestamp_ntz").alias("at"), "to_state")


from corpusloom.plans import more  # noqa: E402, F401  registers the rest
