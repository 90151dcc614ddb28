"""Prompt injection and unsafe output, as columns over normalised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import redaction

# The six families of injected instructions.
INJECTION = (
    r"\b(?:ignore|disregard|forget)\b.{0,60}\b(?:instructions|rules|system prompt)\b",
    r"\b(?:reveal|show|print|repeat|display|expose)\b.{0,50}\b(?:system|developer) (?:prompt|instructions|message)\b",
    r"\b(?:override|bypass|disable)\b.{0,40}\b(?:guardrails|safety|policy|filters)\b",
    r"<\|(?:im_start|system|developer)\|>|\[INST\]|</?(?:system|developer)>|(?:^|\n)\s*(?:SYSTEM|DEVELOPER)\s*:",
    r"\b(?:send|upload|exfiltrate)\b.{0,100}\b(?:secret|credentials|api key|environment)\b",
    r"\b(?:pretend|act)\b.{0,25}\b(?:unrestricted|unfiltered|jailbroken)\b",
)
# Markup that no answer may hold.
MARKUP = r"<(?:script|iframe|img|object)\b|javascript:|data:|mailto:|\]\("

#: For each family patterns that every text with a match holds. They begin with one character or class, so the engine tries no alternatives at most places.
_INJECTION_PARTS = tuple(
    tuple(map(redaction.any_case, parts))
    for parts in (
        ("g(?:nore|ard|et)", "r(?:uct|ule|ompt)"),
        ("e[mr] (?:prompt|instruct|message)",),
        ("[vyb](?:err|pas|le)", "[dfl](?:rail|ety|icy|ter)"),
        (r"[<\[yv](?:\||inst|stem|eloper)",),
        ("[cdpv](?:ret|ential|i key|ironment)",),
        ("[nj](?:restr|filt|ailb)",),
    )
)
_MARKUP_PARTS = (redaction.any_case("[tao]:"), redaction.any_case("<[sio]"), r"\]\(")


def injection(x: Column) -> Column:
    found = F.lit(False)
    for pattern, parts in zip(INJECTION, _INJECTION_PARTS, strict=True):
        whole = x.rlike("(?isuU)" + pattern)
        for part in reversed(parts):
            whole = x.rlike(part) & whole
        found = found | whole
    return F.coalesce(found, F.lit(False))


def markup(x: Column) -> Column:
    return F.coalesce((x.rlike(_MARKUP_PARTS[0]) | x.rlike(_MARKUP_PARTS[1]) | x.rlike(_MARKUP_PARTS[2])) & x.rlike("(?iuU)" + MARKUP), F.lit(False))


def output_violation(x: Column) -> Column:
    """The first of: injected instruction, unsafe markup, personal data; null if none."""
    return F.when(injection(x), "output_injection").when(markup(x), "unsafe_output_markup").when(redaction.found(redaction.query_policy(x)), "output_pii")
