"""Personal data: what the patterns find, and texts with every find replaced by its tag.

A policy is one JVM expression in which each step's text is bound once, so its
size is linear in the steps wherever it is pushed. Names are a step of their own:
``NAMES`` finds those that a title or label stands before, any other recogniser can
take its place.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from corpusloom.functions import text as T
from corpusloom.shared import lean

# The patterns of the document policy.
SIN = r"\b\d{3}[- ]?\d{3}[- ]?\d{3}\b"
PHONE = r"\b(?:\+?1[-. ]?)?\(?[2-9]\d{2}\)?[-. ]\d{3}[-. ]\d{4}\b"
EMAIL = r"\b[A-Za-z0-9!#$%&'*+/=?^_`{|}~.-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b"
CARD = r"\b(?:\d[ -]?){12,18}\d\b"
IP = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
SECTION = r"(?iU)\b((?:sections?|subsections?|paragraphs?)\s*:?\s*)(\d+)\.(\d+)\.(\d+)\.(\d+)(?![.\d]*\d)\b"

# The labelled patterns of the query policy, applied in this order; where there is a group, only it is replaced.
QUERY_PATTERNS = {
    "EMAIL_ADDRESS": r"\b[\w.%+-]+\s*(?:\[at\]|\(at\)| at )\s*[\w.-]+\s*(?:\[dot\]|\(dot\)| dot )\s*[a-z]{2,}\b",
    "DATE_OF_BIRTH": r"\b(?:DOB|date of birth|born)\s*[:=]\s*(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})",
    "BANK_ACCOUNT": r"\b(?:bank\s+)?account(?:\s+(?:number|no\.?))?\s*[:=#]\s*([0-9][0-9 -]{4,29}[0-9])",
    "STREET_ADDRESS": r"\b(?:home |mailing |street )?address\s*[:=]\s*(\d{1,6}\s+(?:[\w'-]+\s+){0,5}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd)\b(?:\s+[NSEW]{1,2})?)",
    "CA_POSTAL_CODE": r"\b[ABCEGHJ-NPRSTVXY]\d[ABCEGHJ-NPRSTV-Z][ -]?\d[ABCEGHJ-NPRSTV-Z]\d\b",
}


_CASES = "\u0130\u0131\u017f\u212a"  # their other case is i, s or k


def any_case(pattern: str) -> str:
    """A pattern of lower-case words, for the JVM: any case of ASCII letters, and what else has them as its other case."""
    return "(?i)" + re.sub(r"\[[^\]]*[isk][^\]]*\]|[isk]", lambda m: m[0][:-1] + _CASES + "]" if len(m[0]) > 1 else f"[{m[0]}{_CASES}]", pattern)


#: For each labelled pattern a cheaper one that every text with a find holds.
_QUERY_GUARDS = {
    "EMAIL_ADDRESS": any_case(r"dot[\]) ]"),
    "DATE_OF_BIRTH": any_case("[db](?:ob|irth|orn)"),
    "BANK_ACCOUNT": any_case("account"),
    "STREET_ADDRESS": any_case("address"),
    "CA_POSTAL_CODE": r"\p{Nd}[^\p{Nd}][ -]?\p{Nd}[^\p{Nd}]\p{Nd}",
}

DOCUMENT_ENTITIES = ("EMAIL_ADDRESS", "CREDIT_CARD", "PHONE_NUMBER", "IP_ADDRESS", "CA_SIN")
_DOT = "\x1c"  # stands for the dots of a section number while addresses are replaced


def _tag(entity: str) -> str:
    return f"<{entity}>"


def _cards(x: Column) -> Column:
    """The digit runs that pass the card checksum."""
    found = F.regexp_extract_all(x, F.lit(f"({CARD})"), F.lit(1))
    return F.filter(found, lambda c: F.call_function("luhn_check", F.regexp_replace(c, "[ -]", "")))


@dataclass(frozen=True)
class Step:
    """What one entity's step counts and replaces; ``guard`` is a cheap test that every text with a find passes."""

    entity: str
    count: Callable[[Column], Column]
    replace: Callable[[Column], Column]
    guard: Callable[[Column], Column] | None = None


def _plain(entity: str, pattern: str, guard: Callable[[Column], Column]) -> Step:
    return Step(entity, lambda x: F.regexp_count(x, F.lit(pattern)), lambda x: F.regexp_replace(x, pattern, _tag(entity)), guard)


def _replace_cards(x: Column) -> Column:
    return F.aggregate(F.array_distinct(_cards(x)), x, lambda text, card: F.replace(text, card, F.lit(_tag("CREDIT_CARD"))))


def _mask_sections(x: Column) -> Column:
    return F.regexp_replace(x, SECTION, f"$1$2{_DOT}$3{_DOT}$4{_DOT}$5")


def _labelled(entity: str) -> Step:
    pattern = QUERY_PATTERNS[entity]
    whole = "(?iuU)" + pattern
    guard = lambda x: x.rlike(_QUERY_GUARDS[entity])
    group = next((i for i in range(len(pattern)) if pattern[i] == "(" and pattern[i : i + 2] != "(?" and pattern[i - 1] != "\\"), None)
    if group is None:
        return Step(entity, lambda x: F.regexp_count(x, F.lit(whole)), lambda x: F.regexp_replace(x, whole, _tag(entity)), guard)
    return Step(entity, lambda x: F.regexp_count(x, F.lit(whole)), lambda x: F.regexp_replace(x, f"(?iuU)({pattern[:group]}){pattern[group:]}", f"$1{_tag(entity)}"), guard)


#: What each policy does, in order.
DOCUMENT_STEPS = (
    _plain("EMAIL_ADDRESS", EMAIL, lambda x: F.contains(x, F.lit("@"))),
    Step("CREDIT_CARD", lambda x: F.size(_cards(x)), _replace_cards, lambda x: x.rlike("[0-9](?:[ -]?[0-9]){12}")),
    _plain("PHONE_NUMBER", PHONE, lambda x: x.rlike("[0-9]{3}[-. ][0-9]{4}")),
    Step("IP_ADDRESS", lambda x: F.regexp_count(_mask_sections(x), F.lit(IP)), lambda x: F.replace(F.regexp_replace(_mask_sections(x), IP, _tag("IP_ADDRESS")), F.lit(_DOT), F.lit(".")), lambda x: x.rlike(r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]")),
    _plain("CA_SIN", SIN, lambda x: x.rlike("[0-9]{3}[- ]?[0-9]{3}[- ]?[0-9]{3}")),
)
QUERY_STEPS = (*map(_labelled, QUERY_PATTERNS), *DOCUMENT_STEPS)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def policy(x: Column, steps: tuple[Step, ...] = DOCUMENT_STEPS, names: Step | None = None) -> Column:
    """struct<text, counts>: the text after all steps and the finds per entity, without those that weren't found."""
    steps = (names, *steps) if names is not None else steps

    def run(k: int, text: Column, counts: list[tuple[str, Column]]) -> Column:
        if k == len(steps):
            total: dict[str, Column] = {}
            for entity, n in counts:
                total[entity] = total[entity] + n if entity in total else n
            return F.struct(text.alias("text"), counts_map(total).alias("counts"))
        s = steps[k]
        n, y = s.count(text), s.replace(text)
        if s.guard is not None:  # tested once for both
            both = F.when(s.guard(text), F.struct(n.alias("n"), y.alias("y"))).otherwise(F.struct(F.lit(0).alias("n"), text.alias("y")))
            return _let(both, lambda b: run(k + 1, b["y"], [*counts, (s.entity, b["n"])]))
        return _let(y, lambda t: run(k + 1, t, [*counts, (s.entity, n)]))

    return _let(x, lambda t: run(0, t, []))


def document_policy(x: Column, names: Step | None = None) -> Column:
    """E-mail addresses, cards, phones, IP addresses and nine-digit identifiers replaced.

    A four-part number after "section", "subsection" or "paragraph" is no IP address.
    """
    return policy(x, DOCUMENT_STEPS, names)


def query_policy(x: Column, names: Step | None = None) -> Column:
    """Labelled values first, then the document policy. x: already normalised."""
    return policy(x, QUERY_STEPS, names)


def found(result: Column) -> Column:
    """Whether a policy found anything; null text: no."""
    return F.coalesce(F.size(result["counts"]) > 0, F.lit(False))


def redacted(df: DataFrame, column: str, steps: tuple[Step, ...] = DOCUMENT_STEPS, text: str = "redacted", counts: str = "counts", how: Callable[[Column], Column] | None = None) -> DataFrame:
    """df with a policy's text and counts: that of the steps, or ``how``."""
    return df.withColumn("__r", how(F.col(column)) if how else policy(F.col(column), steps)).withColumns({text: F.col("__r.text"), counts: F.col("__r.counts")}).drop("__r")


def counts_map(counts: dict[str, Column]) -> Column:
    """Finds per entity, without those that weren't found."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(v, F.lit(0)).cast("long").alias("value")) for k, v in sorted(counts.items())])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"] > 0))


#: Titles and phrases that a person's name follows, then up to three capitalised words: a rule, no recogniser.
_NAME = r"(?U)\b((?i:my name is|name\s*:|full name\s*:|attention\s*:|signed by|regards,|sincerely,|mr\.?|mrs\.?|ms\.?|dr\.?)\s+)\p{Lu}[\p{L}'-]+(?:[ ]\p{Lu}[\p{L}'-]+){0,2}"
#: The names step to hand to a policy: finds labelled names only. Names without a label stay.
NAMES = Step("PERSON", lambda x: F.regexp_count(x, F.lit(_NAME)), lambda x: F.regexp_replace(x, _NAME, "$1" + _tag("PERSON")))

_LITERAL = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)


_JSON = StructType([StructField("strings", ArrayType(StructType([StructField("raw", StringType()), StructField("text", StringType())]))), StructField("plain", StringType())])


@F.pandas_udf(_JSON)
def _composed_json(x: pd.Series) -> pd.DataFrame:
    """strings: the distinct string literals of a JSON text with what they decode to, composed; null for a text that isn't JSON, which is composed whole as ``plain``."""

    def composed(text: str) -> str:
        return unicodedata.normalize("NFKC", html.unescape(text))

    strings, plain = [], []
    for text in x:
        found = None
        if text is not None:
            try:
                json.loads(text)
                found = [{"raw": raw, "text": composed(json.loads(raw))} for raw in dict.fromkeys(_LITERAL.findall(text))]
            except (ValueError, RecursionError):
                pass
        strings.append(found)
        plain.append(composed(text) if text is not None and found is None else None)
    return pd.DataFrame({"strings": pd.Series(strings, dtype=object), "plain": pd.Series(plain, dtype=object)})


def _json_read(x: Column) -> tuple[Column, Column]:
    """The string literals of a JSON text, normalised, and the whole text, normalised, if it isn't JSON: one visit to Python."""
    lean()
    read = _composed_json(x)
    strings = F.transform(read["strings"], lambda p: F.struct(p["raw"].alias("raw"), T.strip_controls(p["text"]).alias("text")))
    return strings, T.strip_controls(read["plain"])


def json_strings(x: Column) -> Column:
    """array<struct<raw, text>>: the distinct string literals of a JSON text, keys too, and their decoded, normalised texts; null if it isn't JSON."""
    return _json_read(x)[0]


def redacted_json(x: Column, steps: tuple[Step, ...] = QUERY_STEPS) -> Column:
    """JSON text with every string in it redacted, keys too, at any depth; numbers and structure stay.

    Strings are decoded and normalised, then redacted; those in which something is found are encoded anew and put in
    place of the whole literal, so the result is JSON as well. A text that isn't JSON is redacted as plain text.
    """
    encoded = lambda t: F.regexp_extract(F.to_json(F.struct(t.alias("v"))), r'(?s)^\{"v":(".*")\}$', 1)
    strings, plain = _json_read(x)
    done = F.transform(strings, lambda p: F.struct(p["raw"].alias("raw"), policy(p["text"], steps).alias("r")))
    put = F.aggregate(F.filter(done, lambda p: F.size(p["r"]["counts"]) > 0), x, lambda text, p: F.replace(text, p["raw"], encoded(p["r"]["text"])))
    return F.coalesce(put, policy(plain, steps)["text"])


def json_clean(x: Column, steps: tuple[Step, ...] = QUERY_STEPS) -> Column:
    """Whether a policy finds nothing in a text, normalised, nor in any decoded string of it, if it is JSON; null: false."""
    inside = F.coalesce(F.exists(json_strings(x), lambda p: F.size(policy(p["text"], steps)["counts"]) > 0), F.lit(False))
    return x.isNotNull() & ~found(policy(T.normalized(x), steps)) & ~inside
