"""Personal data as scored spans: every recogniser reads the text as it is, conflicts are settled, one pass replaces.

A recogniser's finds are spans of code points with a score. Unlike steps in a row,
no recogniser sees another's tags. A span that is exactly one of an exemption's
(the four-part number after "section", for addresses) is no find. Of spans that
overlap the one with the higher score stays, then the longer, the earlier, the
entity that sorts first; spans that only touch don't conflict. What stays is
replaced by its tag in one pass.

Only texts that pass a recogniser's cheap test on the JVM travel to Python, in
Arrow batches; the work there grows with the text and, for n finds, with n log n.
Null text: null text, no finds. Empty text: itself. Repeated rows: each by itself.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from corpusloom.functions import redaction as R
from corpusloom.shared import lean

# Lowest score of a find, and scores of the patterns. What a checksum or a label confirms is certain.
THRESHOLD = 0.5
CONFIRMED, NUMBER, ADDRESS = 1.0, 0.7, 0.6

SECTION_NUMBER = r"\b(?:sections?|subsections?|paragraphs?)\s*:?\s*(\d+(?:\.\d+){3})\b"


def luhn(value: str) -> bool:
    """Whether the digits of a text pass the card checksum."""
    digits = [int(c) for c in reversed(value) if c.isdecimal()]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


@dataclass(frozen=True)
class Recogniser:
    """Finds of one pattern; ``group`` is the part that counts, ``accepts`` confirms a find, ``exempt`` names spans that are none.

    ``guard``: a pattern for the JVM that every text with a find holds.
    """

    entity: str
    pattern: str
    score: float
    guard: str
    flags: int = 0
    group: int = 0
    accepts: Callable[[str], bool] | None = None
    exempt: str | None = None

    def spans(self, text: str) -> list[tuple[str, int, int, float]]:
        none = {m.span(1) for m in re.finditer(self.exempt, text, re.IGNORECASE)} if self.exempt else set()
        found = ((m.span(self.group), m.group(self.group)) for m in re.finditer(self.pattern, text, self.flags))
        return [(self.entity, *span, self.score) for span, value in found if span not in none and (self.accepts is None or self.accepts(value))]


def _labelled(entity: str) -> Recogniser:
    pattern = re.compile(R.QUERY_PATTERNS[entity])
    return Recogniser(entity, pattern.pattern, CONFIRMED, ".", re.IGNORECASE, min(1, pattern.groups))


DOCUMENT = (
    Recogniser("EMAIL_ADDRESS", R.EMAIL, CONFIRMED, "@"),
    Recogniser("CREDIT_CARD", R.CARD, CONFIRMED, r"(?U)\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d", accepts=luhn),
    Recogniser("PHONE_NUMBER", R.PHONE, NUMBER, r"(?U)\d{3}[-. ]\d{4}"),
    Recogniser("IP_ADDRESS", R.IP, ADDRESS, r"(?U)\d\.\d{1,3}\.\d{1,3}\.\d", exempt=SECTION_NUMBER),
    Recogniser("CA_SIN", R.SIN, NUMBER, r"(?U)\d{3}[- ]?\d{3}[- ]?\d{3}"),
)
#: Labelled values and the document's; of equal scores the longer span stays.
QUERY = (*map(_labelled, R.QUERY_PATTERNS), *DOCUMENT)


def settle(spans: list[tuple[str, int, int, float]]) -> list[bool]:
    """Which of the spans (entity, start, end, score) stay: by score, length, place and name, each unless it overlaps one that stays."""
    stays, taken = [False] * len(spans), []
    for k in sorted(range(len(spans)), key=lambda k: (-spans[k][3], spans[k][1] - spans[k][2], spans[k][1], spans[k][0])):
        _, start, end, _ = spans[k]
        at = bisect_left(taken, (start,))
        if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
            insort(taken, (start, end))
            stays[k] = True
    return stays


_SPAN = StructType([StructField("entity", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType()), StructField("kept", BooleanType())])
_RESULT = StructType([StructField("text", StringType()), StructField("spans", ArrayType(_SPAN))])


def found(x: Column, recognisers: tuple[Recogniser, ...] = DOCUMENT, threshold: float = THRESHOLD) -> Column:
    """struct<text, spans>: the text with what stays replaced, and all finds in order of place, with whether each stays."""
    used = tuple(r for r in recognisers if r.score >= threshold)
    lean()

    @F.pandas_udf(_RESULT)
    def scored(texts: pd.Series) -> pd.DataFrame:
        out, finds = [], []
        for text in texts:
            if text is None:
                out.append(None), finds.append([])
                continue
            spans = sorted({s for r in used for s in r.spans(text)}, key=lambda s: (s[1], s[2], s[0], s[3]))
            stays, parts, at = settle(spans), [], 0
            for (entity, start, end, _), stay in zip(spans, stays, strict=True):
                if stay:
                    parts += [text[at:start], f"<{entity}>"]
                    at = end
            out.append("".join([*parts, text[at:]]))
            finds.append([(*s, stay) for s, stay in zip(spans, stays, strict=True)])
        return pd.DataFrame({"text": pd.Series(out, dtype=object), "spans": pd.Series(finds, dtype=object)})

    doubtful = F.lit(False)
    for guard in dict.fromkeys(r.guard for r in used):
        doubtful = doubtful | (F.contains(x, F.lit(guard)) if guard == "@" else x.rlike(guard))
    # A null in place of a text that no pattern can match: it doesn't travel.
    return F.transform(F.array(scored(F.when(doubtful, x))), lambda r: F.struct(F.coalesce(r["text"], x).alias("text"), r["spans"].alias("spans")))[0]


def policy(x: Column, recognisers: tuple[Recogniser, ...] = DOCUMENT, threshold: float = THRESHOLD) -> Column:
    """struct<text, counts>, as the policies in steps give it; counts are of the spans that stay."""

    def count(r: Column, entity: str) -> Column:
        return F.size(F.filter(r["spans"], lambda s: s["kept"] & (s["entity"] == entity)))

    def counted(r: Column) -> Column:
        return F.struct(r["text"].alias("text"), R.counts_map({e: count(r, e) for e in {q.entity for q in recognisers}}).alias("counts"))

    return F.transform(F.array(found(x, recognisers, threshold)), counted)[0]


def span_rows(df: DataFrame, column: str, *keys: str, recognisers: tuple[Recogniser, ...] = DOCUMENT, threshold: float = THRESHOLD) -> DataFrame:
    """One row a find: the keys, entity, start, end, score, kept."""
    finds = df.select(*keys, F.explode(found(F.col(column), recognisers, threshold)["spans"]).alias("__s"))
    return finds.select(*keys, *[F.col(f"__s.{f}").alias(f) for f in _SPAN.names])
