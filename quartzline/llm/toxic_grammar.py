"""Toxicity: a weighted finite-state grammar over clauses, composed of small transducers."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzline.llm.common import RangeHash, materialize

# Closed word classes of four languages; fixed values.
TARGETS = "you your you're he she they them him her this that tu toi vous ton ta votre il elle ils du dich dir ihr euch dein sie er tú te ti usted ustedes él ella ellos".split()
NEGATIONS = "not no never none nobody isn't aren't wasn't don't pas jamais aucun ni nicht kein keine nie niemals nunca jamás ningún ninguna".split()
REPORTS = "said says say told wrote quoted called reported dit disait déclare écrit appelle sagte sagt schrieb nannte berichtet dijo dice escribió llamó".split()
VIOLENCE = (
    "kill kills killing murder destroy shoot stab strangle beat crush burn hang hurt smash"
    " tuer tuerai tue égorger frapper frapperai brûler étrangler écraser"
    " töten töte umbringen erschießen erschieße schlagen verprügeln erwürgen verbrennen"
    " matar mataré matarte golpear golpearé quemar estrangular aplastar"
).split()
INTENTS = "will i'll we'll gonna going shall werde werden wird vais va allons voy va vamos".split()

#: A letter is any byte of a UTF-8 letter here: ASCII letters and all bytes from 128 up.
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LETTER[39] = True
_CLAUSE_END = np.zeros(256, bool)
_CLAUSE_END[list(b".!?;:\n")] = True
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|')*")


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer: (state, symbol) -> (state, symbol out, factor). Symbols without a rule pass."""

    start: object
    rules: dict
    #: Where a state goes with a symbol it has no rule for.
    rest: dict

    def step(self, state, symbol):
        return self.rules.get((state, symbol)) or (self.rest.get(state, state), symbol, 1.0)


SYMBOLS = ("word", "insult", "violence", "target", "negation", "report", "intent", "threat")


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that feeds what the first puts out to the second; factors multiply."""
    start = (first.start, second.start)
    rules, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in SYMBOLS:
            a, between, x = first.step(state[0], symbol)
            b, out, y = second.step(state[1], between)
            rules[state, symbol] = ((a, b), out, x * y)
            if (a, b) not in seen:
                seen.add((a, b))
                todo.append((a, b))
    return Transducer(start, rules, {})


def negation(scope: int = 3, factor: float = 0.25) -> Transducer:
    """Up to `scope` words after a negation insults count less and acts of violence are words like others."""
    rules = {(s, "negation"): (scope, "word", 1.0) for s in range(scope + 1)}
    rules |= {(s, "insult"): (s - 1, "insult", factor) for s in range(1, scope + 1)}
    rules |= {(s, "violence"): (s - 1, "word", 1.0) for s in range(1, scope + 1)}
    return Transducer(0, rules, {s: s - 1 for s in range(1, scope + 1)})


def reported_speech(factor: float = 0.5) -> Transducer:
    """After a verb of saying, to the end of the clause, whatever insults and threats come of a word count less."""
    rules = {(s, "report"): (1, "word", 1.0) for s in (0, 1)}
    rules |= {(1, x): (1, x, factor) for x in ("insult", "violence", "target")}
    return Transducer(0, rules, {})


def insult(reach: int = 4, alone: float = 0.6) -> Transducer:
    """An insulting word is an insult in full up to `reach` words after someone it is said of, else in part."""
    rules = {(s, "target"): (reach, "target", 1.0) for s in range(reach + 1)}
    rules |= {(0, "insult"): (0, "insult", alone)}
    rules |= {(s, "insult"): (s - 1, "insult", 1.0) for s in range(1, reach + 1)}
    return Transducer(0, rules, {s: s - 1 for s in range(1, reach + 1)})


def threat(reach: int = 4, alone: float = 0.2) -> Transducer:
    """An act of violence is a threat where an intent comes up to `reach` words before, or its target up to `reach` after.

    Alone it counts little. States above 0 await the act, those below it its target.
    """
    rules = {(s, "intent"): (reach, "word", 1.0) for s in range(-reach, reach + 1)}
    rules |= {(s, "violence"): (-reach, "threat", 1.0 if s > 0 else alone) for s in range(-reach, reach + 1)}
    rules |= {(s, "target"): (0, "threat", 1.0) for s in range(-reach, 0)}
    return Transducer(0, rules, {s: s - 1 if s > 0 else s + 1 for s in range(-reach, reach + 1) if s})


def target(reach: int = 3, factor: float = 1.5) -> Transducer:
    """Insults and threats up to `reach` words after someone they can be aimed at count more."""
    rules = {(s, "target"): (reach, "word", 1.0) for s in range(reach + 1)}
    rules |= {(s, x): (s - 1, x, factor) for s in range(1, reach + 1) for x in ("insult", "threat")}
    return Transducer(0, rules, {s: s - 1 for s in range(1, reach + 1)})


def parts() -> list[Transducer]:
    """The grammar's transducers, in the order in which each reads what the one before it puts out."""
    return [negation(), reported_speech(), insult(), threat(), target()]


def grammar() -> Transducer:
    return reduce(compose, parts())


#: What a threat weighs, as the closed classes have no learned weight.
_THREAT = 2.0


@dataclass(frozen=True)
class Lexicon:
    """Weights of insult words and stems, with the closed classes."""

    words: dict[str, float]
    stems: dict[str, float]
    #: Logistic regression on log(1 + insults), log(1 + worst clause), log(1 + threats); intercept last.
    weights: tuple[float, ...] = (3.0, 1.0, 0.5, -3.0)


class Matcher:
    """A lexicon and the composed grammar, ready to scan texts."""

    def __init__(self, lexicon: Lexicon):
        self.machine = grammar()
        entries = [(w, 1, x) for w, x in lexicon.words.items()]
        taken = set(lexicon.words)
        for kind, group in (("violence", VIOLENCE), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("intent", INTENTS)):
            entries += [(w, SYMBOLS.index(kind), 0.0) for w in sorted(set(group) - taken)]
            taken |= set(group)
        self.tables = [(0, *self._table(entries))]
        by_length: dict[int, list] = {}
        for stem, weight in lexicon.stems.items():
            by_length.setdefault(len(stem.encode()), []).append((stem, 1, weight))
        self.tables += [(n, *self._table(x)) for n, x in sorted(by_length.items())]

    @staticmethod
    def _table(entries):
        if not entries:
            return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0)
        hashes = np.array([RangeHash(np.frombuffer(w.encode(), np.uint8))(np.array([0]), np.array([len(w.encode())]))[0] for w, *_ in entries], np.uint64)
        order = np.argsort(hashes)
        return hashes[order], np.array([e[1] for e in entries], np.int8)[order], np.array([e[2] for e in entries])[order]

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Summed weight of insults, of the worst clause, and of threats, over all matched clauses."""
        data = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = _LETTER[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return 0.0, 0.0, 0.0
        hashed = RangeHash(data)
        kind, weight = np.zeros(len(starts), np.int8), np.zeros(len(starts))
        for n, known, kinds, weights in self.tables:
            if not len(known):
                continue
            h = hashed(starts, ends if n == 0 else np.minimum(starts + n, ends))
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = (known[at] == h) & (kind == 0)
            kind[hit], weight[hit] = kinds[at[hit]], weights[at[hit]]
        core = np.flatnonzero((kind == 1) | (kind == 2))
        if not len(core):
            return 0.0, 0.0, 0.0
        breaks = np.flatnonzero(_CLAUSE_END[data])
        clause = np.searchsorted(breaks, starts)
        insults = worst = threats = 0.0
        for c in np.unique(clause[core]).tolist():
            a, b = np.searchsorted(clause, [c, c + 1])
            state, total = self.machine.start, 0.0
            for k, w in zip(kind[a:b].tolist(), weight[a:b].tolist(), strict=True):
                state, out, factor = self.machine.step(state, SYMBOLS[k])
                if out == "insult":
                    insults += w * factor
                    total += w * factor
                elif out == "threat":
                    threats += _THREAT * factor
                    total += _THREAT * factor
            worst = max(worst, total)
        return insults, worst, threats


_SHORT, _LONG = 4, 8


def _terms(text: str, least: int = _SHORT, most: int = _LONG) -> Iterator[tuple[bool, str]]:
    words = set(_WORD.findall(text.lower()))
    yield from ((False, w) for w in words)
    yield from {(True, w[:n]) for w in words for n in range(least, min(most, len(w) - 1) + 1)}


def _sample(docs: DataFrame, labels: DataFrame, positives: int, negatives: int) -> DataFrame:
    labelled = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    known = labelled.join(docs.select("doc_id"), "doc_id", "left_semi")
    # the best of each partition meet, not all rows of a label
    chosen = reduce(DataFrame.union, (known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for label, most in ((1, positives), (0, negatives))))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, *, positives: int = 3000, negatives: int = 6000, evidence: float = 25.0) -> Lexicon:
    """Learns the insult terminals and the score from a bounded sample of labelled rows.

    The sample has `positives` rows of label 1 and `negatives` of label 0 at most, those with the
    smallest hashes of doc_id. Words and word stems are counted once for each text, on the
    executors, equal texts as one; those far commoner in toxic texts, by a likelihood ratio of
    `evidence` or more, are candidates. They become terminals, weighted by
    their log-odds, if the ratio holds for the number of different contexts too, so that the rare
    words of one much copied text don't. Their number is bounded by the sample alone. Null texts or labels teach
    nothing; without a row of both labels the lexicon is empty.
    """
    sample = _sample(docs.where(F.col("text").isNotNull()), labels, positives, negatives)
    sample = materialize(sample.dropDuplicates(["text", "label"]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[int]] = {}
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                for term in _terms(text):
                    found.setdefault(term, [0, 0])[label] += 1
        terms = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([t[0] for t in terms], pa.bool_()), pa.array([t[1] for t in terms], pa.string()), pa.array([found[t][1] for t in terms], pa.int64()), pa.array([found[t][0] for t in terms], pa.int64())],
            ["stem", "term", "pos", "neg"],
        )

    totals = Counter({r.label: r["count"] for r in sample.groupBy("label").count().collect()})
    p, n = totals[1], totals[0]
    if not p or not n:
        return Lexicon({}, {}, (0.0, 0.0, 0.0, -3.0))
    counts = sample.select("text", "label").mapInArrow(count, "stem boolean, term string, pos bigint, neg bigint").groupBy("stem", "term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    likely = lambda k, total: k * F.log((k + 1e-9) / total)
    both = F.col("pos") + F.col("neg")
    ratio = 2 * (likely(F.col("pos"), p) + likely(F.col("neg"), n) - both * F.log(both / (p + n)))
    odds = F.log((F.col("pos") + 0.5) / (p + 1)) - F.log((F.col("neg") + 0.5) / (n + 1))
    rows = counts.where("pos >= 3").withColumns({"ratio": ratio, "odds": odds}).where((F.col("ratio") >= evidence) & (F.col("odds") >= 2.5))
    wanted = {(r.stem, r.term): r for r in rows.collect()}

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = set()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                around = ["", *_WORD.findall(text.lower()), ""]
                for before, w, after in zip(around, around[1:], around[2:], strict=False):
                    for key in ((False, w), *((True, w[:n]) for n in range(_SHORT, min(_LONG, len(w) - 1) + 1))):
                        if key in wanted:
                            found.add((*key, f"{before} {w} {after}", label))
        rows = sorted(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in rows], kind) for i, kind in enumerate((pa.bool_(), pa.string(), pa.string(), pa.int32()))], ["stem", "term", "context", "label"]
        )

    seen = sample.select("text", "label").mapInArrow(contexts, "stem boolean, term string, context string, label int")
    varied = seen.distinct().groupBy("stem", "term").agg(F.count_if(F.col("label") == 1).alias("pos")).collect()
    words, stems = {}, {}
    ranked = []
    for r in varied:
        c = wanted[r.stem, r.term]
        # copies of one toxic text repeat its words in the same contexts: those count once
        pos = min(r.pos, c.pos)
        odds = math.log((pos + 0.5) / (p + 1)) - math.log((c.neg + 0.5) / (n + 1))
        both = pos + c.neg
        ratio = 2 * (pos * math.log((pos + 1e-9) / p) + c.neg * math.log((c.neg + 1e-9) / n) - both * math.log(both / (p + n)))
        if ratio >= evidence and odds >= 2.5:
            ranked.append((-ratio, -pos, r.stem, len(r.term), r.term, odds))
    for *_, stem, _, term, odds in sorted(ranked):
        covered = any(term.startswith(x) for x in stems) or term in words
        if stem and not any(x.startswith(term) for x in [*stems, *words]) and not covered:
            stems[term] = odds
        elif not stem and not covered:
            words[term] = odds
    lexicon = Lexicon(words, stems)

    rows = _features(sample, lexicon, "label").collect()
    x = np.array([[math.log1p(r.insults), math.log1p(r.worst), math.log1p(r.threats), 1.0] for r in rows])
    return Lexicon(words, stems, _logistic(x, np.array([r.label for r in rows], float)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[float, ...]:
    """Newton's method; a penalty on all but the intercept."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _features(docs: DataFrame, lexicon: Lexicon, carried: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            found = [matcher.features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in found], pa.float64()) for i in range(3))], [carried, "insults", "worst", "threats"])

    kind = dict(docs.dtypes)[carried]
    return docs.select(carried, "text").mapInArrow(run, f"{carried} {kind}, insults double, worst double, threats double")


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score (0 to 1), insults, worst and threats of each whole text; one row out for each row in.

    Null and empty texts match nothing and have the score of any text without a match. One pass
    without a shuffle; the lexicon's size is bounded.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _features(texts, lexicon, "doc_id")
    a, b, c, d = lexicon.weights
    z = F.log1p("insults") * a + F.log1p("worst") * b + F.log1p("threats") * c + d
    return found.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"), "insults", "worst", "threats")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from labelled rows that are not held out (crc32 of doc_id, modulo 5, is 0) and scores all."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    lexicon = fit(docs.where(~held_out), labels.where(~held_out))
    return score(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
