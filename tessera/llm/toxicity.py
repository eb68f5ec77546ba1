"""Toxicity: a learned lexicon as a trie, met by misspelled words through Levenshtein automata, weighed in context windows.

The positions of the automata of all words are kept together as (trie node, errors); sets of them are the states of one
deterministic automaton, built as words ask for it. It accepts a word if and only if the word is within a term's allowed
distance, so one run over a word's characters stands for the intersection of the word's automaton with the trie.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, save
from .quality import fold

#: Labelled rows the fit sees at most (smallest id hash); how much likelier a term must be in toxic texts, and how many of all
#: terms may be there by chance.
SAMPLE, ODDS, CHANCE = 20_000, 20, 1.0
THRESHOLD = 0.3
#: Words on either side of a term that count as its context; words in a run, and hashes of runs, that near copies are told by.
WINDOW, RUN, SKETCH = 6, 3, 4
_WORD = re.compile(r"\w+")
#: Marks on both sides of a term that report it rather than use it.
QUOTES = set("\"“”„«»‹›")


def allowed(length: int) -> int:
    """Errors allowed for a term: none under 4 characters, one under 8, then two."""
    return 0 if length < 4 else 1 if length < 8 else 2


class Automaton:
    """Terms, whole ('idiot') or stems ('lowei*', any ending), and their misspellings. ``match``: (term index, errors) or None."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.next: list[dict[str, int]] = [{}]
        self.whole: dict[int, int] = {}
        self.stem: dict[int, int] = {}
        self.limit: list[int] = []
        for i, term in enumerate(terms):
            node = 0
            for c in term.removesuffix("*"):
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                node = self.next[node][c]
            (self.stem if term.endswith("*") else self.whole)[node] = i
            self.limit.append(allowed(len(term.removesuffix("*"))))
        self.most = max(self.limit, default=0)
        self.reset()

    def reset(self) -> None:
        self.states: dict = {}
        self.known: list = []
        self.moves: list[dict[str, int]] = []
        self.ends: list = []
        self.cache: dict[str, tuple[int, int] | None] = {}
        self.start = self._state({0: 0}, None)

    def _state(self, at: dict[int, int], found: tuple[int, int] | None) -> int:
        todo = list(at.items())
        while todo:  # a term's character that the word lacks
            node, e = todo.pop()
            if e < self.most:
                for child in self.next[node].values():
                    if at.get(child, 99) > e + 1:
                        at[child] = e + 1
                        todo.append((child, e + 1))
        for node, e in at.items():
            i = self.stem.get(node)
            if i is not None and e <= self.limit[i] and (found is None or (e, i) < (found[1], found[0])):
                found = (i, e)
        key = (frozenset(at.items()), found)
        if key not in self.states:
            best = found
            for node, e in at.items():
                i = self.whole.get(node)
                if i is not None and e <= self.limit[i] and (best is None or (e, i) < (best[1], best[0])):
                    best = (i, e)
            self.states[key] = len(self.known) if at or found else -1
            if self.states[key] >= 0:
                self.known.append((at, found))
                self.moves.append({})
                self.ends.append(best)
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        at, found = self.known[state]
        to: dict[int, int] = {}
        for node, e in at.items():
            for d, child in self.next[node].items():
                cost = e + (d != c)
                if cost <= self.most and to.get(child, 99) > cost:
                    to[child] = cost
            if e < self.most and to.get(node, 99) > e + 1:
                to[node] = e + 1  # a character that the term lacks
        new = self.moves[state][c] = self._state(to, found)
        return new

    def match(self, word: str) -> tuple[int, int] | None:
        try:
            return self.cache[word]
        except KeyError:
            pass
        if len(self.cache) > 400_000 or len(self.known) > 100_000:  # memory only: what is forgotten is found again
            self.reset()
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                break
        found = self.ends[state] if state >= 0 else None
        if len(word) <= 64:
            self.cache[word] = found
        return found


@dataclass
class Model:
    """Terms, the weight of each with 0, 1 or 2 errors, what words near a term say, and a logistic regression on the context features."""

    terms: list[str]
    weights: np.ndarray
    near: dict[str, float]
    coef: np.ndarray
    bias: float
    _automaton: Automaton | None = field(default=None, repr=False)

    @property
    def automaton(self) -> Automaton:
        if self._automaton is None:
            self._automaton = Automaton(self.terms)
        return self._automaton

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}


def matches(text: str, automaton: Automaton) -> list[tuple[int, int, int, int]]:
    """(word index, start, term, errors) of every word of the whole text that meets a term."""
    lower = text.lower()
    find = automaton.match
    words = _WORD.findall(lower)
    hits = [i for i, w in enumerate(words) if find(w) is not None]
    if not hits:
        return []
    starts = [m.start() for m in _WORD.finditer(lower)]
    return [(i, starts[i], *find(words[i])) for i in hits]


def windows(text: str, found: list[tuple[int, int, int, int]]) -> list[tuple[list[str], bool]]:
    """The words around each match, WINDOW on either side, and whether quotation marks stand on both of its sides there."""
    lower = text.lower()
    spans = [(m.start(), m.end()) for m in _WORD.finditer(lower)]
    out = []
    for i, start, _, _ in found:
        lo, hi = max(0, i - WINDOW), min(len(spans) - 1, i + WINDOW)
        before, after = lower[spans[lo][0] : start], lower[spans[i][1] : spans[hi][1] + 2]
        words = [lower[a:b] for j, (a, b) in enumerate(spans[lo : hi + 1], lo) if j != i]
        out.append((words, bool(QUOTES & set(before) and QUOTES & set(after))))
    return out


def context(text: str, found: list[tuple[int, int, int, int]], weights: np.ndarray, near: dict[str, float]) -> np.ndarray:
    """Features of a text: used, quoted and densest-window weight, weight in abusive company, greatest weight.

    The words near a match are for or against abuse as ``near`` says, by their mean. A match is quoted if marks stand on both of
    its sides or its company is twice as likely in clean texts; it keeps a quarter of its weight in all features but the second.
    """
    out = np.zeros(5)
    if not found:
        return out
    values, at = [], []
    for (i, _, term, errors), (words, marked) in zip(found, windows(text, found), strict=True):
        weight = weights[term, errors]
        if weight <= 0:
            continue
        known = [near[w] for w in words if w in near]
        company = sum(known) / len(known) if known else 0.0
        quoted = marked or company < -0.7
        values.append(weight * (0.25 if quoted else 1))
        at.append(i)
        out[1] += weight * quoted
        out[3] += values[-1] * max(0.0, company)
    if values:
        out[0] = sum(values)
        j, run = 0, 0.0
        for i, (a, x) in enumerate(zip(at, values, strict=True)):
            run += x
            while at[j] < a - WINDOW:
                run -= values[j]
                j += 1
            out[2] = max(out[2], run)
        out[4] = max(values)
    return np.log1p(out)


def sketch(text: str) -> list[int]:
    """SKETCH minima of hashes over a text's runs of RUN words: near copies share most, other texts hardly any."""
    words = _WORD.findall(text.lower())
    runs = {" ".join(words[i : i + RUN]).encode("utf-8", "replace") for i in range(max(1, len(words) - RUN + 1))}
    codes = np.array([zlib.crc32(x) for x in runs], np.uint64)
    return [int((codes * np.uint64(0x9E3779B1 + 2 * j) % np.uint64(4294967291)).min()) for j in range(SKETCH)]


def unlike(sample: DataFrame) -> DataFrame:
    """The rows (toxic, text) of a saved bounded sample that are the first of their label with each value of their sketch.

    Of a group of near copies that leaves about one; no chain of likenesses can take more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([sketch(t) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["toxic", "text", "sketch"])

    rows = map_arrow(sample.select(F.col("toxic").cast("int").alias("toxic"), "text"), run, "toxic int, text string, sketch array<long>")
    rows = save(rows.withColumn("id", F.xxhash64("text")))
    parts = rows.select("toxic", "id", F.posexplode("sketch").alias("j", "value"))
    later = parts.join(parts.groupBy("toxic", "j", "value").agg(F.min("id").alias("first")), ["toxic", "j", "value"]).filter("id <> first")
    return save(rows.join(later.select("id").distinct(), "id", "left_anti").select("toxic", "text"))


def _terms(rows: DataFrame) -> DataFrame:
    """(toxic, term) once a text: its words, and their stems of 4 to 7 characters marked with '*'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = set(_WORD.findall(text.lower()))
                terms = sorted(words | {w[:n] + "*" for w in words for n in (4, 5, 6, 7) if len(w) > n})
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), toxic, np.int32)), pa.array(terms, pa.string())], names=["toxic", "term"])

    return map_arrow(rows.select("toxic", "text"), run, "toxic int, term string")


def by_chance(t: int, n: int, share: float) -> float:
    """The chance that ``t`` or more of ``n`` texts are toxic if the toxic share of all is ``share``."""
    log = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share)
    return sum(math.exp(log(k)) for k in range(t, n + 1))


def lexicon(sample: DataFrame) -> list[str]:
    """Terms that tell toxic texts, from a saved bounded sample (text, toxic) without repeated texts.

    Near copies count once (see ``unlike``), or one family would make terms of all its words. A term is in it if its odds are
    ODDS times higher in toxic texts than in clean ones and if chance alone would give so toxic a term at most CHANCE times
    among all those that are in enough texts to be told (Tarone's count). A stem stays if it is in more toxic texts than any one
    of its words that is a term itself; words under a stem that stays go, for the stem meets them. No other bound: the
    sample bounds the lexicon.
    """
    rows = unlike(sample)
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return []
    counts = save(_terms(rows).groupBy("term").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")))
    share, terms, level = toxic / (toxic + clean), 0, CHANCE
    for r in counts.groupBy("n").agg(F.count("*").alias("terms")).orderBy(F.desc("n")).collect():
        if share ** r["n"] > CHANCE / (terms + r["terms"]):
            break
        terms += r["terms"]
        level = CHANCE / terms
    odds = (F.col("t") + 0.5) / (toxic + 1) / ((F.col("n") - F.col("t") + 0.5) / (clean + 1))
    found = {r["term"]: r["t"] for r in counts.filter((F.col("t") > 1) & (odds >= ODDS)).collect() if by_chance(r["t"], r["n"], share) <= level}
    best: dict[str, int] = defaultdict(int)
    words = [t for t in found if not t.endswith("*")]
    for w in words:
        for n in (4, 5, 6, 7):
            if len(w) > n:
                best[w[:n] + "*"] = max(best[w[:n] + "*"], found[w])
    stems: set[str] = set()
    for t in sorted((t for t in found if t.endswith("*")), key=lambda t: (len(t), t)):
        shorter = {t[:n] + "*" for n in (4, 5, 6) if n < len(t) - 1}
        if not shorter & stems and found[t] > best[t]:
            stems.add(t)
    return sorted([*stems, *(w for w in words if not any(w[:n] + "*" in stems for n in (4, 5, 6, 7) if len(w) > n))])


def weigh(seen: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Weight of each term with 0, 1 or 2 errors, from ``seen``: texts that meet it so, by term, errors and label."""
    # With no evidence a misspelling counts like a term; where clean texts have it, it weighs nothing.
    weights = np.log((seen[:, :, 1] + 2) / (toxic + 2)) - np.log((seen[:, :, 0] + 0.2) / (clean + 2))
    return np.clip(weights, 0, 6) * np.array([1, 0.8, 0.6])


def company(counts: dict[str, list[int]], least: int = 3) -> dict[str, float]:
    """How much each word that ``least`` windows hold speaks for abuse: its log odds, from (clean, toxic) windows with it."""
    clean, toxic = (sum(c[x] for c in counts.values()) for x in (0, 1))
    if not clean or not toxic:
        return {}  # nothing to tell the two apart
    odds = {w: math.log((c[1] + 1) / (toxic + 1)) - math.log((c[0] + 1) / (clean + 1)) for w, c in counts.items() if sum(c) >= least}
    return {w: max(-2.0, min(2.0, x)) for w, x in odds.items()}


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression of labels on context features, drawn towards its starting point."""
    coef, bias = np.array([1.0, 0.0, 0.5, 0.1, 0.5]), -2.0
    start = coef.copy()
    if 0 < y.sum() < len(y):
        for _ in range(3000):
            p = 1 / (1 + np.exp(-(x @ coef + bias)))
            coef -= 0.3 * (x.T @ (p - y) / len(y) + 1e-3 * (coef - start))
            bias -= 0.3 * (p - y).mean()
    return coef, float(bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Lexicon, weights and contexts from at most ``sample`` labelled rows (doc_id, toxic), those of smallest id hash.

    An id with both labels counts as toxic; labels other than 0 and 1 count as none. Texts that repeat count once. Without
    toxic texts, and on an empty table, every text gets the same low score. Texts stay on the executors: counts by term, counts by word near a term
    and five numbers a row reach the driver, all bounded by the sample.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(known), "doc_id")
    rows = save(rows.groupBy("text").agg(F.max("toxic").alias("toxic")))
    terms = lexicon(rows)
    automaton = Automaton(terms)
    if not terms:
        return Model([], np.zeros((0, 3)), {}, np.zeros(5), -2.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = matches(text, automaton)
                around = sorted({w for words, _ in windows(text, found) for w in words})
                out.append((int(toxic), [[int(x) for x in m] for m in found], around, text if found else ""))
            if out:
                kinds = (pa.int32(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["toxic", "found", "around", "text"])

    automaton.reset()
    met = save(map_arrow(rows.select("toxic", "text"), run, "toxic int, found array<array<long>>, around array<string>, text string"))
    hits = F.array_distinct(F.transform("found", lambda m: F.struct(m[2].alias("term"), m[3].alias("errors"))))
    seen = np.zeros((len(terms), 3, 2))
    for r in met.select("toxic", F.explode(hits).alias("hit")).groupBy("toxic", "hit.term", "hit.errors").agg(F.count("*").alias("n")).collect():
        seen[r["term"], r["errors"], r["toxic"]] = r["n"]
    counts = {r["toxic"]: r["n"] for r in met.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    weights = weigh(seen, counts.get(1, 0), counts.get(0, 0))
    around: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for r in met.select("toxic", F.explode("around").alias("word")).groupBy("toxic", "word").agg(F.count("*").alias("n")).collect():
        around[r["word"]][r["toxic"]] += r["n"]
    near = company(around)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [context(text, [tuple(m) for m in found], weights, near).tolist() for found, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    points = sorted((r["toxic"], *r["x"]) for r in map_arrow(met.select("toxic", "found", "text"), measure, "toxic int, x array<double>").collect())
    table = np.array(points, np.float64).reshape(-1, 6)
    return Model(terms, weights, near, *fit(table[:, 1:], table[:, 0]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, terms) of every whole text; null texts are empty. ``terms``: what was met, in the text's order.

    Repeated rows and texts get equal scores; an empty table gives no rows; other columns of docs, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton
        for b in batches:
            scores, met = [], []
            for text in b.column(1).to_pylist():
                found = matches(text or "", automaton)
                z = float(context(text, found, model.weights, model.near) @ model.coef + model.bias) if found else model.bias
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                met.append([model.terms[m[2]] for m in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(met, pa.list_(pa.string()))], names=["doc_id", "score", "terms"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(rows, run, "doc_id long, score double, terms array<string>")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; nulls, empty texts, repeats and empty tables as in ``score``. Held-out labels are not read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold(4) != 2).select("doc_id", "toxic")
    scored = score(docs, train(docs, labels))
    held_out = F.coalesce(fold(4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
