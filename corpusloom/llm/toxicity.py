"""Toxicity by a weighted finite-state pattern grammar.

Words of a clause are read as symbols: insult, threat, target, negation, report,
other; a quotation mark in the clause comes first, its end last. Five weighted
transducers pass them on to one another: NEGATION weakens the insults and marks
the threat verbs among the next three words; INSULT notes that one was met;
TARGET adds weight if an addressed person stands with it; THREAT adds the weight
of a threat verb with a target, less if every such verb is negated; REPORT weakens
all that follows a verb of saying or stands in quotes. ``compose`` makes one
automaton of them, once; clauses are scored by its table alone.

A document's log odds are a bias plus the weights of its matched clauses; a clause
without insult or threat adds nothing. Insults are a base list and stems learned
from labelled rows. Light stems also stand in clean texts now and then: each
counts by its Poisson log likelihood ratio, different words with it times weight
less its usual rate in toxic texts times the text's different words, and only in
texts with two light words.

Learned stems are words, and beginnings of 4 to 10 letters of words, that stand
in toxic texts far more often than chance allows (a Bonferroni bound over all of
them). All terms are counted and weighed on the executors, the best few of a round
reach the driver, and learning goes on with the toxic texts that are left. ``ROWS``
bounds the labelled rows, ``TERMS`` the learned stems.

Null and empty texts score as no match. Every clause of a text counts, however
long it is. Repeated rows score alike; a score of exactly the threshold predicts
1. Without labels only the base grammar is used. An empty table gives an empty
result; other columns are neither read nor returned.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common
from corpusloom.llm.labelled import held_out, training_rows

ROWS, TERMS, THRESHOLD = 8000, 400, 0.5
STEM = range(4, 11)
BIAS, INSULT, TARGETED, THREATENED, NEGATED, REPORTED = -2.5, 5.0, 0.5, 4.5, 0.35, 0.35  # one negated or reported insult or threat stays below THRESHOLD
#: The most that a light stem weighs, and how often its toxic rate must be that of clean texts, overall and of those that have it.
LIGHT, RATIO, AMONG = 3.5, 8, 3
#: Learning takes the best TAKE stems of the BEST that reach the driver and goes on with the toxic texts that these don't explain.
TAKE, BEST = 4, 64
#: Terms that a task counts before it hands them on.
HELD = 50_000
#: It stops at TERMS, when no stem is far above chance, or when no more than this share of the toxic texts is left: what a few near copies share is no stem.
LEFT = 0.01

#: Words of the grammar, in English, French, German and Spanish.
BASE_INSULTS = "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns imbecile dumbass bastard bastards connard connards salaud abruti crétin arschloch dummkopf vollidiot abschaum gilipollas imbécil estúpido estúpida pendejo basura".split()
THREATS = "kill hurt destroy beat crush murder stab shoot tuer frapper détruire töten umbringen schlagen vernichten matar golpear destruir".split()
TARGETS = "you your yours yourself u he she they them him her people everyone tu toi vous votre ton ils elles du dich dir dein ihr euch sie usted ustedes tú ti te ellos ellas".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't didn't cannot can't without ne pas jamais aucun sans nicht kein keine nie niemals ohne nunca jamás ningún sin".split()
REPORTS = "said says say called calls wrote told claims claimed reported quote quoted dit disait écrit appelé sagte sagt schrieb nannte dijo dice escribió llamó".split()

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;\n|]+")
_QUOTE = re.compile(r"[\"“”«»„]")
OTHER, INSULTS, THREAT, TARGET, NEGATION, REPORT, QUOTE, END = range(8)
DENIED, END_DENIED, INSULTED = range(8, 11)  # what transducers tell one another: a negated threat verb, an end right after a negation, an end of a clause with an insult
READ, ENDS = range(8), (END, END_DENIED, INSULTED)


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, symbol) -> (state, symbol passed on, factor on what the arc weighs, weight added); without an arc all stays as it is."""

    arcs: dict[tuple, tuple]
    start: object = 0

    def step(self, state: object, symbol: int) -> tuple:
        return self.arcs.get((state, symbol), (state, symbol, 1.0, 0.0))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """One transducer that passes what first writes to second; its states are the pairs that can be reached."""
    start = (first.start, second.start)
    arcs, todo = {}, [start]
    seen = {start}
    while todo:
        state = todo.pop()
        for symbol in range(INSULTED + 1):
            a, middle, f, u = first.step(state[0], symbol)
            b, out, g, v = second.step(state[1], middle)
            arcs[state, symbol] = ((a, b), out, f * g, u * g + v)
            if (a, b) not in seen:
                seen.add((a, b))
                todo.append((a, b))
    return Transducer(arcs, start)


_WORDS = (OTHER, TARGET, REPORT)
NEGATION_T = Transducer(
    {(s, NEGATION): (3, NEGATION, 1.0, 0.0) for s in range(4)}
    | {(s, x): (s - 1, x, 1.0, 0.0) for s in (1, 2, 3) for x in _WORDS}
    | {(s, INSULTS): (s - 1, INSULTS, NEGATED, 0.0) for s in (1, 2, 3)}
    | {(s, THREAT): (s - 1, DENIED, 1.0, 0.0) for s in (1, 2, 3)}
    | {(3, END): (3, END_DENIED, 1.0, 0.0)}
)
INSULT_T = Transducer({(0, INSULTS): (1, INSULTS, 1.0, 0.0)} | {(1, x): (1, INSULTED, 1.0, 0.0) for x in (END, END_DENIED)})
TARGET_T = Transducer({(0, TARGET): (1, TARGET, 1.0, 0.0), (1, INSULTED): (1, INSULTED, 1.0, TARGETED)})
#: States: the threat verbs so far (none, only negated ones, others too) and whether a target was met.
THREAT_T = Transducer(
    {((v, t), THREAT): (("some", t), THREAT, 1.0, 0.0) for v in ("none", "denied", "some") for t in (False, True)}
    | {(("none", t), DENIED): (("denied", t), DENIED, 1.0, 0.0) for t in (False, True)}
    | {((v, False), TARGET): ((v, True), TARGET, 1.0, 0.0) for v in ("none", "denied", "some")}
    | {(("some", True), END): (("some", True), END, 1.0, THREATENED)}
    | {((v, True), e): ((v, True), e, 1.0, THREATENED * NEGATED) for v, e in (("some", END_DENIED), ("denied", END), ("denied", END_DENIED))},
    ("none", False),
)
#: States: a verb of saying was met, quotation marks were met.
REPORT_T = Transducer(
    {((v, q), REPORT): ((True, q), REPORT, 1.0, 0.0) for v in (False, True) for q in (False, True)}
    | {((False, False), QUOTE): ((False, True), QUOTE, 1.0, 0.0)}
    | {((v, q), x): ((v, q), x, REPORTED ** (v + q) if x == INSULTS else REPORTED, 0.0) for v in (False, True) for q in (False, True) if v or q for x in (INSULTS, *ENDS)},
    (False, False),
)


class Machine:
    """The composed automaton as a table: per state and symbol the next state, a factor and an added weight."""

    def __init__(self) -> None:
        whole = functools.reduce(compose, (NEGATION_T, INSULT_T, TARGET_T, THREAT_T, REPORT_T))
        number = {whole.start: 0}
        for state, _ in whole.arcs:
            number.setdefault(state, len(number))
        self.table = [[None] * len(READ) for _ in number]
        for (state, symbol), (to, _, factor, added) in whole.arcs.items():
            if symbol in READ:
                self.table[number[state]][symbol] = (number[to], factor, added)

    def weigh(self, symbols: list[tuple[int, float]], quoted: bool) -> list[float]:
        """The weights of the clause's insults in their context, the first with what the clause adds, or that of its threat; empty if it has none."""
        state, found, added = 0, [], 0.0
        for symbol, weight in [*([(QUOTE, 0.0)] if quoted else ()), *symbols, (END, 0.0)]:
            state, factor, more = self.table[state][symbol]
            added += more
            if symbol == INSULTS:
                found.append(weight * factor)
        if found:
            found[0] += added
        elif added:
            found.append(added)
        return found


class Grammar:
    """The lexicon as one expression that finds the clauses worth weighing, and the machine that weighs them."""

    def __init__(self, learned: dict[str, float], base: bool = True, rates: dict[str, float] | None = None):
        """learned: stems (``word$`` for a whole word) and their weights; rates: uses per word of the light ones; base: with the base insults and threats."""
        self.learned, self.base, self.rates = dict(learned), base, dict(rates or {})
        self._ready = False

    def __getstate__(self) -> dict:
        return {"learned": self.learned, "base": self.base, "rates": self.rates, "_ready": False}

    def _prepare(self) -> None:
        self.whole = (dict.fromkeys(BASE_INSULTS, INSULT) if self.base else {}) | {t[:-1]: w for t, w in self.learned.items() if t.endswith("$")}
        self.stems = {t: w for t, w in self.learned.items() if not t.endswith("$")}
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self.kinds = {w: k for k, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        words = sorted({*self.whole, *(THREATS if self.base else ())}, key=len, reverse=True)
        stems = sorted(self.stems, key=len, reverse=True)
        if not words and not stems:
            words = ["\0"]
        heads = "|".join([*(re.escape(w) + r"(?![^\W\d_])" for w in words), *map(re.escape, stems)])
        self.find = re.compile(rf"(?<![^\W\d_])(?:{heads})")
        self.machine = Machine()
        self._ready = True

    def term(self, word: str) -> str | None:
        """The lexicon's entry for a word: itself, or its longest learned beginning."""
        if word in self.whole:
            return word + "$"
        return next((word[:n] for n in self.lengths if len(word) >= n and word[:n] in self.stems), None)

    def clauses(self, text: str) -> list[tuple[str, list[tuple[str, str, float]]]]:
        """The clauses that match, with their insults: word, term, weight in context; a threat stands without word and term."""
        if not self._ready:
            self._prepare()
        low, out, start, done = text.lower(), [], 0, -1
        breaks = _CLAUSE.finditer(low)
        ahead = next(breaks, None)
        for m in self.find.finditer(low):
            if m.start() < done:
                continue
            while ahead is not None and ahead.end() <= m.start():  # clauses are walked once, in order
                start, ahead = ahead.end(), next(breaks, None)
            end = len(low) if ahead is None else ahead.start()
            clause, done = low[start:end], end
            words = _WORD.findall(clause)
            terms = [self.term(w) for w in words]
            symbols = [(self.kinds.get(w, OTHER), 0.0) if t is None else (INSULTS, self.whole[w] if t.endswith("$") else self.stems[t]) for w, t in zip(words, terms, strict=True)]
            weights = self.machine.weigh(symbols, bool(_QUOTE.search(clause)))
            if weights:
                insults = [(w, t) for w, t in zip(words, terms, strict=True) if t is not None] or [("", "")]
                out.append((clause, [(w, t, x) for (w, t), x in zip(insults, weights, strict=True)]))
        return out

    def score(self, text: str | None) -> float:
        text = text or ""
        found = [x for _, xs in self.clauses(text) for x in xs]
        z, light = BIAS, {}
        for word, term, weight in found:
            if term in self.rates:
                light[word, term] = max(weight, light.get((word, term), 0.0))
            else:
                z += weight
        if len(light) > 1:  # against what a toxic text of this length would hold
            words = len(set(text.lower().split()))
            for t in {t for _, t in light}:
                z += max(0.0, sum(x for (_, own), x in light.items() if own == t) - self.rates[t] * words)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def terms_of(text: str) -> tuple[Counter, int]:
    """Of a text's different words, those that are or begin with each term, and their number."""
    low, out = text.lower(), Counter()
    for w in set(_WORD.findall(low)):
        if len(w) > 2:
            out[w + "$"] += 1
        for k in STEM:
            if len(w) <= k:
                break
            out[w[:k]] += 1
    return out, len(set(low.split()))


def weighed(counts: DataFrame, toxic: int, clean: int, clean_words: int, candidates: int) -> DataFrame:
    """Of terms with their texts, uses and those texts' words in toxic and clean rows, the ones far above chance: gain, weight and, for light ones, rate."""
    share = toxic / max(1, toxic + clean)
    both = F.col("texts") + F.col("clean_texts")
    p = F.col("texts") / both
    # the chance that so many of the texts with the term are toxic, by the Chernoff bound
    gain = both * (p * F.log(p / share) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0))
    rate = F.col("uses") / F.col("words")
    among = (F.col("clean_uses") + 0.5) / (F.col("clean_words") + 1)
    ratio = rate / ((F.col("clean_uses") + 0.5) / max(1, clean_words))
    pure = (F.col("texts") >= 200 * F.col("clean_texts")) & (F.col("texts") >= 8)
    fits = (p > share) & (gain > -math.log(0.01 / max(1, candidates))) & (pure | ((ratio >= RATIO) & (rate >= AMONG * among)))
    return counts.where(F.col("words") > 0).where(fits).select("term", gain.alias("gain"), F.when(pure, INSULT).otherwise(F.least(F.log(ratio), F.lit(LIGHT))).alias("weight"), F.when(~pure, rate).alias("rate"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> Grammar:
    """Counts and weighs terms over the training rows on the executors; the ``BEST`` of each round reach the driver.

    Copies of a text count once: rows are first reduced to distinct texts.
    """
    train = common.written(training_rows(docs, labels, label, rows, id_col, text_col).withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "label"]).select("label", "text"), "toxic-train")

    def counter(grammar: Grammar | None):
        def table(texts: Counter, uses: Counter, words: Counter) -> pa.RecordBatch:
            terms = list(texts)
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in (texts, uses, words))], ["term", "texts", "uses", "words"])

        def run(batches):
            held = Counter(), Counter(), Counter()
            for b in batches:
                for text in b.column("text"):
                    text = text.as_py()
                    if grammar is None or sum(len(found) for _, found in grammar.clauses(text)) < 2:
                        seen, n = terms_of(text)
                        held[0].update(dict.fromkeys([*seen, ""], 1))
                        held[1].update(seen)
                        held[2].update(dict.fromkeys([*seen, ""], n))
                        if len(held[0]) > HELD:
                            yield table(*held)
                            held = Counter(), Counter(), Counter()
            if held[0]:
                yield table(*held)

        return run

    common.lean(docs.sparkSession)

    def counts(frame: DataFrame, grammar: Grammar | None, prefix: str = "") -> DataFrame:
        """Per term; the empty one counts all texts."""
        made = frame.select("text").mapInArrow(counter(grammar), "term string, texts long, uses long, words long")
        return made.groupBy("term").agg(*[F.sum(c).alias(prefix + c) for c in ("texts", "uses", "words")])

    def total(frame: DataFrame, column: str) -> int:
        return sum(r[0] for r in frame.where("term = ''").select(column).collect())

    bad, good = train.where("label = 1"), train.where("label = 0")
    usual = common.written(counts(good, None, "clean_"), "clean-terms")
    toxic, clean, clean_words, candidates = bad.count(), good.count(), total(usual, "clean_words"), 0
    learned: dict[str, float] = {}
    rates: dict[str, float] = {}
    while toxic and clean and len(learned) < TERMS:
        rest = counts(bad, Grammar(learned, False, rates)).where("texts > 2 OR term = ''").join(usual, "term", "left").na.fill(0, ["clean_texts", "clean_uses", "clean_words"])
        rest = common.written(rest, "toxic-terms")
        candidates = candidates or rest.count()
        if total(rest, "texts") <= LEFT * toxic:
            break
        best = weighed(rest.where("term <> ''"), toxic, clean, clean_words, candidates).orderBy(F.desc("gain"), F.desc(F.length("term")), "term").limit(BEST).collect()
        new: list = []
        for r in best:
            bare = r["term"].rstrip("$")
            if len(new) < min(TAKE, TERMS - len(learned)) and not any(bare.startswith(t.rstrip("$")) or t.startswith(bare) for t in [*learned, *(x["term"] for x in new)]):
                new.append(r)
        if not new:
            break
        learned |= {r["term"]: r["weight"] for r in new}
        rates |= {r["term"]: r["rate"] for r in new if r["rate"] is not None}
    return Grammar(learned, rates=rates)


def scorer(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> Column:
    """The score of the text column, as a column of docs."""
    common.lean(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([shared.value.score(t) for t in texts], dtype=np.float64))

    return score(F.coalesce(docs[text_col].cast("string"), F.lit("")))


def scored(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: ``doc_id``, held_out, score, predicted."""
    out = docs.select(docs[id_col].alias("doc_id"), scorer(docs, grammar, text_col).alias("score"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
