"""The redaction policies in DuckDB's SQL: each step is a common table expression over the text that the step before left.

The given tables' texts are what normalisation leaves as they are, so the SQL doesn't normalise.
"""

from __future__ import annotations

from corpusloom.functions import redaction as R

EMAIL = R.EMAIL.replace("]++", "]+")  # this engine has no possessive repetition; no piece of an address before @ holds one
SECTION = r"(?i)\b((?:sections?|subsections?|paragraphs?)\s*:?\s*)(\d+)\.(\d+)\.(\d+)\.(\d+)\b"
ENTITIES = sorted({*R.QUERY_PATTERNS, *R.DOCUMENT_ENTITIES})


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _wide(pattern: str) -> str:
    """Word characters are Unicode's."""
    return pattern.replace(r"\w", r"\pL\pN_")


def _labelled(entity: str) -> tuple[str, str, str]:
    """Pattern, replacement and entity; where the pattern has a group, what stands before it stays."""
    pattern = _wide(R.QUERY_PATTERNS[entity])
    at = next((i for i in range(1, len(pattern)) if pattern[i] == "(" and pattern[i + 1] != "?" and pattern[i - 1] != "\\"), None)
    return (f"(?i){pattern}", f"<{entity}>", entity) if at is None else (f"(?i)({pattern[:at]}){pattern[at:]}", rf"\1<{entity}>", entity)


#: The card checksum over the digits of c.
_DIGITS = "regexp_replace(c, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: [[0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]][(length({_DIGITS}) - i) % 2 + 1][substr({_DIGITS}, i, 1)::INT + 1])) % 10 = 0"


def policy(source: str, columns: str, labelled: bool) -> str:
    """Common table expressions over ``source`` (a query with a column ``text``): the last one, ``redacted``, has the columns, the text after all steps as ``t``, and a number per entity."""
    parts, n = [f"p0 AS (SELECT {columns}, text AS t FROM ({source}))"], 0

    def step(select: str) -> None:
        nonlocal n
        parts.append(f"p{n + 1} AS (SELECT * EXCLUDE (t), {select} FROM p{n})")
        n += 1

    def plain(pattern: str, to: str, name: str, text: str = "t", after: str = "{}") -> None:
        put = after.format(f"regexp_replace({text}, {_text(pattern)}, {_text(to)}, 'g')")
        step(f"len(regexp_extract_all({text}, {_text(pattern)})) AS {name}, {put} AS t")

    if labelled:
        for entity in R.QUERY_PATTERNS:
            pattern, to, name = _labelled(entity)
            plain(pattern, to, f"L_{name}")
    plain(EMAIL, "<EMAIL_ADDRESS>", "D_EMAIL_ADDRESS")
    step(f"list_filter(regexp_extract_all(t, {_text(R.CARD)}), lambda c: {_LUHN}) AS cards, t")
    step("len(cards) AS D_CREDIT_CARD, list_reduce(list_distinct(cards), lambda a, c: replace(a, c, '<CREDIT_CARD>'), t) AS t")
    plain(R.PHONE, "<PHONE_NUMBER>", "D_PHONE_NUMBER")
    masked = f"regexp_replace(t, {_text(SECTION)}, '\\1\\2' || chr(28) || '\\3' || chr(28) || '\\4' || chr(28) || '\\5', 'g')"
    plain(R.IP, "<IP_ADDRESS>", "D_IP_ADDRESS", masked, "replace({}, chr(28), '.')")
    plain(R.SIN, "<CA_SIN>", "D_CA_SIN")
    totals = ", ".join(f"{' + '.join(x)} AS n_{e}" for e in ENTITIES if (x := [f"{k}_{e}" for k, known in (("L", R.QUERY_PATTERNS if labelled else ()), ("D", R.DOCUMENT_ENTITIES)) if e in known]))
    return ", ".join(parts) + f", redacted AS (SELECT {columns}, t, {totals} FROM p{n})"


def counts_json(labelled: bool) -> str:
    """The map of finds as JSON, entities in order, without those that weren't found."""
    known = ENTITIES if labelled else sorted(R.DOCUMENT_ENTITIES)
    pairs = ", ".join(f"CASE WHEN n_{e} > 0 THEN '\"{e}\":' || n_{e} END" for e in known)
    return f"'{{' || array_to_string(list_filter([{pairs}], lambda x: x IS NOT NULL), ',') || '}}'"


def total(labelled: bool) -> str:
    return " + ".join(f"n_{e}" for e in (ENTITIES if labelled else sorted(R.DOCUMENT_ENTITIES)))


PII_REDACT = f"WITH {policy('SELECT doc_id, text FROM documents', 'doc_id', False)} SELECT doc_id, t AS text, ({total(False)})::BIGINT AS redactions FROM redacted"
PII_COUNTS = f"WITH {policy('SELECT doc_id, text FROM documents', 'doc_id', False)} " + " UNION ALL ".join(f"SELECT '{e}' AS entity, sum(n_{e})::BIGINT AS n FROM redacted HAVING sum(n_{e}) > 0" for e in sorted(R.DOCUMENT_ENTITIES))


_TAIL = "coalesce(text, '') || ' See section 1.2.3.' || doc_id % 200 || ' or paragraphs: 4.5.6.7, host 10.2.3.' || doc_id % 200"
SECTION_NUMBERS = f"WITH {policy(f'SELECT doc_id, {_TAIL} AS text FROM documents', 'doc_id', False)} SELECT doc_id, t AS text, n_IP_ADDRESS::BIGINT AS addresses FROM redacted"


#: What several recognisers claim: an address of digits, a host that begins as an IP address does, nine digits inside what may be a card.
OVERLAPS = "coalesce(text, '') || ' Mail 416-555-' || lpad((doc_id % 10000)::VARCHAR, 4, '0') || '@h.example.org, 10.2.3.' || doc_id % 250 || ', me@10.2.3.' || doc_id % 250 || '.example.org, card 123 456 789 ' || lpad((doc_id % 10000)::VARCHAR, 4, '0') || ', paragraph 1.2.3.' || doc_id % 250"


def spans(source: str) -> str:
    """Common table expressions over ``source`` (doc_id, text): ``span``, every find with its place, and ``chosen``, per text the list of those that stay."""
    number = r"(?i)\b(?:sections?|subsections?|paragraphs?)\s*:?\s*\d+(?:\.\d+){3}\b"
    # RE2 splits at the same finds, so a find's place is what stands before it
    kinds = (("EMAIL_ADDRESS", EMAIL, 1.0), ("CREDIT_CARD", R.CARD, 1.0), ("PHONE_NUMBER", R.PHONE, 0.7), ("IP_ADDRESS", R.IP, 0.6), ("CA_SIN", R.SIN, 0.7), ("SECTION", number, 0.0))
    each = " UNION ALL ".join(f"SELECT doc_id, '{e}' AS entity, {score}::DOUBLE AS score, unnest(regexp_extract_all(text, {_text(p)})) AS c, unnest(string_split_regex(text, {_text(p)})[:len(regexp_extract_all(text, {_text(p)}))]) AS gap, generate_subscripts(regexp_extract_all(text, {_text(p)}), 1) AS i FROM src" for e, p, score in kinds)
    return (
        f"src AS ({source}), hit AS ({each}), "
        "placed AS (SELECT doc_id, entity, score, c, sum(length(gap) + length(c)) OVER (PARTITION BY doc_id, entity ORDER BY i)::INT AS last FROM hit), "
        "number AS (SELECT doc_id, last, length(regexp_extract(c, '[0-9.]+$')) AS n FROM placed WHERE entity = 'SECTION'), "
        f"span AS (SELECT doc_id, entity, score, last - length(c) AS first, last FROM placed p WHERE entity <> 'SECTION' AND (entity <> 'CREDIT_CARD' OR {_LUHN}) AND (entity <> 'IP_ADDRESS' OR NOT EXISTS (SELECT 1 FROM number x WHERE x.doc_id = p.doc_id AND x.last = p.last AND x.n = length(p.c)))), "
        "pick AS (SELECT doc_id, [] ::STRUCT(entity VARCHAR, first INT, last INT)[] AS kept, list({'entity': entity, 'first': first::INT, 'last': last::INT} ORDER BY score DESC, last - first DESC, first, entity) AS rest FROM span GROUP BY doc_id "
        "UNION ALL SELECT doc_id, list_append(kept, rest[1]), list_filter(rest[2:], lambda x: x.last <= rest[1].first OR x.first >= rest[1].last) FROM pick WHERE len(rest) > 0), "
        "chosen AS (SELECT doc_id, kept FROM pick WHERE len(rest) = 0)"
    )


SCORED_SPANS = f"WITH RECURSIVE {spans('SELECT doc_id, text FROM documents')} SELECT s.doc_id, s.entity, s.first::INT AS first, s.last::INT AS last, s.score, list_contains(k.kept, {{'entity': s.entity, 'first': s.first::INT, 'last': s.last::INT}}) AS kept FROM span s JOIN chosen k USING (doc_id)"
SPAN_REDACTION = (
    f"WITH RECURSIVE {spans(f'SELECT doc_id, {OVERLAPS} AS text FROM documents')}, one AS (SELECT doc_id, unnest(kept, recursive := true) FROM chosen), "
    "part AS (SELECT o.doc_id, o.entity, o.first, o.last, substr(text, coalesce(lag(o.last) OVER w, 0) + 1, o.first - coalesce(lag(o.last) OVER w, 0)) || '<' || o.entity || '>' AS piece FROM one o JOIN src USING (doc_id) WINDOW w AS (PARTITION BY o.doc_id ORDER BY o.first)), "
    "whole AS (SELECT doc_id, string_agg(piece, '' ORDER BY first) AS head, max(last) AS last, count(*) AS redactions FROM part GROUP BY doc_id) "
    "SELECT s.doc_id, coalesce(head, '') || substr(s.text, coalesce(w.last, 0) + 1) AS text, coalesce(redactions, 0)::BIGINT AS redactions, (SELECT count(*) FROM span x WHERE x.doc_id = s.doc_id)::BIGINT AS finds FROM src s LEFT JOIN whole w USING (doc_id)"
)


def query_redaction(turns: list[tuple]) -> str:
    more = ", ".join(f"({c}, {t}, {_text(x)})" for c, t, _, x in turns)
    source = f"SELECT conv_id, turn, text FROM conversations UNION ALL SELECT * FROM (VALUES {more})"
    return f"WITH {policy(source, 'conv_id, turn', True)} SELECT conv_id, turn, t AS text, {counts_json(True)} AS counts FROM redacted"


def output_violations(injection: str) -> str:
    markup = r"regexp_matches(text, '(?i)<(?:script|iframe|img|object)\b|javascript:|data:|mailto:|\]\(')"
    return f"WITH {policy('SELECT doc_id, text, text AS original FROM documents', 'doc_id, original', True)}, v AS (SELECT *, original AS text FROM redacted) SELECT doc_id, CASE WHEN {injection} THEN 'output_injection' WHEN {markup} THEN 'unsafe_output_markup' WHEN {total(True)} > 0 THEN 'output_pii' END AS violation FROM v"


JSON_REDACTION = f"WITH {policy('SELECT conv_id, turn, role, text FROM conversations', 'conv_id, turn, role', True)} SELECT conv_id, turn, to_json({{'turn': turn, 'said': {{'role': role, 'texts': [t]}}}})::VARCHAR AS json FROM redacted"


def excerpt_prompts(injection: str) -> str:
    source = "SELECT doc_id, source, lang, coalesce(text, '') AS text, coalesce(text, '') AS original FROM documents"
    return (
        f"WITH {policy(source, 'doc_id, source, lang, original', True)}, v AS (SELECT *, original AS text FROM redacted), n AS (SELECT *, doc_id // 5 AS question_id, row_number() OVER (PARTITION BY doc_id // 5 ORDER BY doc_id % 5) AS number, {injection} AS risky FROM v) "
        "SELECT question_id, bool_or(risky) AS context_injection, 'Question:' || chr(10) || 'What follows?' || chr(10) || chr(10) || 'Excerpts:' || chr(10) || to_json(list({'number': number, 'title': source, 'section': lang, 'text': t} ORDER BY number))::VARCHAR AS user FROM n GROUP BY question_id"
    )
