"""Toxicity: misspelled lexicon terms found by a Levenshtein automaton over a trie, scored in context windows."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.quality import logistic, sigmoid
from framelake.llm.sample import labelled_sample
from framelake.llm.text import slices

#: Training rows of each class and learnt terms, at most (fitting only; scoring takes all rows and all words).
PER_CLASS, TERMS = 3000, 160
#: A term is learnt from this many toxic texts, if at least this share of the texts with it are toxic.
MIN_TOXIC, MIN_SHARE = 4, 0.9
STEM = (4, 7)
#: Terms this long are also met with one edit: a character more, less or other, or two neighbours exchanged.
FUZZY_LENGTH = 5
LONGEST = 32
#: Words on either side of a hit that its context window has.
WINDOW = 6

#: Marks that open or close a quotation, words that report speech, words that address somebody.
QUOTES = "\"“”„«»‹›"
REPORTING = frozenset("said says say called calls quote quoted quotes wrote writes word words term phrase reported alleged".split())
ADDRESS = frozenset("you your youre yourself u are so such".split())
LEET = str.maketrans("013457@$", "oieastas")

_JOINERS = "@$*"


class Term(NamedTuple):
    """A word of the lexicon, or a stem that any ending may follow; stems are met exactly."""

    text: str
    stem: bool
    weight: float

    @property
    def edits(self) -> int:
        return 0 if self.stem or len(self.text) < FUZZY_LENGTH else 1


class LexiconAutomaton:
    """The terms' Levenshtein automata run along the trie of the terms, made deterministic.

    A state is the set of (trie node, edits, pending exchange) that a word's beginning can reach. `step` maps
    (state, class of a character) to a state, state 0 is dead and state 1 the start; `found` and `edits` give
    the term of a word that ends in a state (the fewest edits, then the largest weight), or -1.
    """

    def __init__(self, terms: list[Term]):
        self.terms = terms
        children: list[dict[str, int]] = [{}]
        ends: list[list[int]] = [[]]
        reach = [0]
        for i, term in enumerate(terms):
            node = 0
            for c in term.text:
                reach[node] = max(reach[node], term.edits)
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append([])
                    reach.append(0)
                node = children[node][c]
            reach[node] = max(reach[node], term.edits)
            ends[node].append(i)
        self._children, self._ends, self._reach = children, ends, reach
        self.letters = sorted({c for t in terms for c in t.text})
        start = self._closed({(0, 0, "")})
        states: dict[frozenset, int] = {frozenset(): 0, start: 1}
        table, todo = [[0] * (len(self.letters) + 1)], [start]
        for state in todo:
            row = []
            for c in ["", *self.letters]:
                following = self._following(state, c)
                if following not in states:
                    states[following] = len(states)
                    todo.append(following)
                row.append(states[following])
            table.append(row)
        self.step = np.array(table, np.int32)
        answers = [self._answer(s) for s in states]
        self.found = np.array([a[1] for a in answers], np.int32)
        self.edits = np.array([a[0] for a in answers], np.int32)

    def _closed(self, places: set) -> frozenset:
        """Adds letters left out, keeps of each place the fewest edits, and keeps met stems."""
        out: dict[tuple[int, str], int] = {}
        todo = list(places)
        while todo:
            node, edits, pending = todo.pop()
            if edits > max(self._reach[node], 0) or out.get((node, pending), 9) <= edits:
                continue
            out[(node, pending)] = edits
            if not pending and edits == 0:
                todo.extend((child, 1, "") for child in self._children[node].values() if self._reach[child])
        return frozenset((n, e, p) for (n, p), e in out.items())

    def _following(self, state: frozenset, c: str) -> frozenset:
        places = set()
        for node, edits, pending in state:
            children = self._children[node]
            if any(self.terms[i].stem for i in self._ends[node]) and edits == 0 and not pending:
                places.add((node, edits, "stem"))
            if pending == "stem":
                places.add((node, edits, pending))
            elif pending:
                if c == pending:
                    places.add((node, edits, ""))
            else:
                if c in children:
                    places.add((children[c], edits, ""))
                if edits == 0 and self._reach[node]:
                    places.add((node, 1, ""))
                    for other, child in children.items():
                        if other != c and self._reach[child]:
                            places.add((child, 1, ""))
                            if c in self._children[child] and self._reach[self._children[child][c]]:
                                places.add((self._children[child][c], 1, other))
        return self._closed(places)

    def _answer(self, state: frozenset) -> tuple[int, int]:
        met = [
            (edits, -self.terms[i].weight, i)
            for node, edits, pending in state
            if pending in ("", "stem")
            for i in self._ends[node]
            if (self.terms[i].stem or pending == "") and edits <= self.terms[i].edits
        ]
        return (min(met)[0], min(met)[2]) if met else (0, -1)

    def match(self, text: str) -> tuple[int, int]:
        """(term or -1, edits) of one word."""
        found, edits = self.match_all(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([0]), np.array([len(text)]))
        return int(found[0]), int(edits[0])

    def match_all(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for all words at once: one step of all words that are still alive, character by character."""
        classes = np.zeros(0x110000, np.int32)
        classes[[ord(c) for c in self.letters]] = np.arange(1, len(self.letters) + 1)
        state = np.zeros(len(start), np.int32)
        alive = np.arange(len(start))
        now = np.ones(len(start), np.int32)
        for k in range(LONGEST):
            more = start[alive] + k < end[alive]
            state[alive[~more]] = now[~more]
            alive, now = alive[more], now[more]
            now = self.step[now, classes[points[start[alive] + k]]]
            alive, now = alive[now > 0], now[now > 0]
            if not len(alive):
                break
        state[alive] = now
        return self.found[state], self.edits[state]


class Model(NamedTuple):
    automaton: LexiconAutomaton
    weights: np.ndarray
    prior: float


def _folded(text: str) -> str:
    return text.lower().translate(LEET)


def _word_spans(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of digits, letters and non-ASCII characters, with the signs people put in place of letters inside."""
    small = np.minimum(points, 0x80)
    core = np.array([chr(c).isalnum() for c in range(128)] + [True])[small]
    core &= ~np.isin(points, [ord(q) for q in QUOTES])
    joins = np.isin(points, [ord(c) for c in _JOINERS])
    inside = core.copy()
    inside[1:-1] |= joins[1:-1] & core[:-2] & core[2:]
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


N_FEATURES = 6


def features(bodies: list[str | None], automaton: LexiconAutomaton) -> np.ndarray:
    """For each text: strength of plain hits, of misspelled, stem, quoted and addressed hits, and strength a word.

    A hit's strength is its term's weight, less for an edit. A hit counts as quoted when its window has a
    quotation mark on both sides or a word that reports speech; it then adds only to the quoted strength.
    """
    bodies = [_folded(b or "") for b in bodies]
    out = np.zeros((len(bodies), N_FEATURES))
    whole = "\n".join(bodies)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return out
    begins = np.cumsum([0, *(len(b) + 1 for b in bodies)])
    start, end = _word_spans(points)
    found, edits = automaton.match_all(points, start, end)
    hit = np.flatnonzero(found >= 0)
    if not len(hit):
        return out
    row = np.searchsorted(begins, start[hit], "right") - 1
    n_words = np.diff(np.searchsorted(start, begins))
    for i, r, t, e in zip(hit.tolist(), row.tolist(), found[hit].tolist(), edits[hit].tolist()):
        term = automaton.terms[t]
        strength = term.weight * (1 - 0.25 * e)
        low, high = int(begins[r]), int(begins[r + 1]) - 1
        left = whole[max(low, int(start[max(i - WINDOW, 0)])) : int(start[i])]
        right = whole[int(end[i]) : min(high, int(end[min(i + WINDOW, len(end) - 1)]))]
        near = set(re.findall(r"\w+", left)) | set(re.findall(r"\w+", right))
        marked = any(q in left for q in QUOTES) and any(q in right for q in QUOTES)
        if marked or near & REPORTING:
            out[r, 3] += strength
            continue
        out[r, 1 if e else 2 if term.stem else 0] += strength
        if near & ADDRESS:
            out[r, 4] += strength
    plain = out[:, :3].sum(axis=1)
    out[:, 5] = 100 * plain / np.maximum(n_words, 20)
    return np.log1p(out)


def _terms_of(body: str) -> set[tuple[str, bool]]:
    points = np.frombuffer((text := _folded(body)).encode("utf-32-le", "surrogatepass"), np.uint32)
    terms = set()
    if len(points):
        start, end = _word_spans(points)
        seen = {text[a:b] for a, b in zip(start.tolist(), end.tolist()) if 3 < b - a <= LONGEST}
        terms = {(w, False) for w in seen}
        terms.update((w[:n], True) for w in seen for n in range(STEM[0], min(STEM[1], len(w) - 1) + 1))
    return terms


def learn_terms(sample: DataFrame) -> list[Term]:
    """Words and stems that mark the toxic class in a sample of (text, y), at most TERMS of them.

    Words that begin with a kept stem stand beside it for their misspelt forms; they take no place of the TERMS.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            tables = (Counter(), Counter())
            for body, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist()):
                tables[y].update(_terms_of(body))
            keys = list(tables[0].keys() | tables[1].keys())
            yield pa.record_batch(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.bool_()),
                    pa.array([tables[1][k] for k in keys], pa.int64()),
                    pa.array([tables[0][k] for k in keys], pa.int64()),
                ],
                names=["term", "stem", "bad", "good"],
            )

    counted = (
        sample.select("text", "y")
        .mapInArrow(count, "term string, stem boolean, bad long, good long")
        .groupBy("term", "stem")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .where((F.col("bad") >= MIN_TOXIC) & (F.col("bad") >= MIN_SHARE * (F.col("bad") + F.col("good"))))
    )
    weight = F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5))
    best = counted.withColumn("weight", weight).orderBy(
        F.desc(F.col("bad") * F.col("weight")), F.col("stem"), F.desc(F.length("term")), "term"
    )
    kept: list[Term] = []
    count_of: dict[str, int] = {}
    beside: list[Term] = []
    for r in best.limit(20 * TERMS).toLocalIterator():
        term = Term(r.term, r.stem, float(r.weight))
        # A longer form of a kept stem adds its misspelt forms, and nothing where no edit is allowed.
        if any(t.stem and r.term.startswith(t.text) for t in kept):
            if term.edits:
                beside.append(term)
            continue
        # A stem that only a kept word has says nothing new.
        if r.stem and any(not t.stem and t.text.startswith(r.term) and r.bad <= 1.1 * count_of[t.text] for t in kept):
            continue
        if len(kept) < TERMS:
            kept.append(term)
            count_of[r.term] = r.bad
    return kept + beside


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, *, per_class: int = PER_CLASS) -> Model:
    """Lexicon, its automaton and the weights of the hits, from at most `per_class` labelled rows of each class."""
    sample = labelled_sample(docs, labels, label, learn, per_class)
    automaton = LexiconAutomaton(learn_terms(sample))
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = features(part.column("text").to_pylist(), shared.value)
            yield pa.record_batch([pa.array(x.tolist(), pa.list_(pa.float64())), part.column("y")], names=["x", "y"])

    got = sample.select("doc_id", "text", "y").mapInArrow(measure, "x array<double>, y int").toArrow()
    y = got.column("y").to_numpy().astype(float) if got.num_rows else np.zeros(0)
    if not len(y) or y.min() == y.max():
        return Model(automaton, np.zeros(N_FEATURES + 1), float(y[0]) if len(y) else 0.0)
    x = np.array(got.column("x").to_pylist())
    return Model(automaton, logistic(x, y, ridge=0.1), float(y.mean()))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """`docs` with the probability of being toxic in column `name` (replaced if there).

    Null and empty texts have no hit and get the score of a text without hits. Without labelled rows of both
    classes all scores are the known class, 0 if none. Other columns, nulls and repeated rows pass unchanged.
    """
    kept = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TERMS terms at most, whatever the tables' size
    schema = type(kept.schema)([*kept.schema.fields]).add(name, "double")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in slices(batches):
            if m.weights.any():
                x = features(part.column("text").to_pylist(), m.automaton)
                found = sigmoid(x @ m.weights[:-1] + m.weights[-1])
            else:
                found = np.full(part.num_rows, m.prior)
            yield pa.record_batch([*part.columns, pa.array(found, pa.float64())], names=[*part.schema.names, name])

    return kept.mapInArrow(apply, schema)
