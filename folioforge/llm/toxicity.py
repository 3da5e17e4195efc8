"""Operator 10, toxicity by a weighted finite-state pattern grammar.

A lexicon transducer maps words to symbols: insults (words and stems with
weights), threat verbs, targets, negations, reported speech, and boundaries of
clauses. Four transducers are composed behind it: negation marks the insults and
threat verbs in its scope, reported speech those behind it, the target transducer
the insults near an addressed person, and the threat transducer turns a threat
verb that a target follows into a threat. Each is a small machine of its own; the
composition is compiled once to a table of states and symbols, whose arcs put out
a match (an insult or a threat, in a context). Arcs are weighted by their context;
a clause has the weight of its strongest match, and a document's log-odds are the
prior plus the weights of all its matched clauses.

Weights of stems, the weights of contexts and the prior are learned from a
bounded sample of labelled rows (`sample`, chosen by hash): stems by their counts,
with support in distinct min-hash sketches, so that copies of one text count once;
contexts by a logistic regression that is drawn to the usual weights.

Defined cases: null and empty texts get the score of a document without matches;
repeated rows get equal scores; without labels the fixed lexicon and default
weights remain; an empty table gives an empty result; extra columns, whatever
their names, are not read by scoring and kept by the filter. Ids are integers.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, of_text, save, slices

#: Most labelled rows that a fit uses.
SAMPLE = 12_000
THRESHOLD = 0.7

# Fixed lexicon in four languages.
INSULTS = """idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile dumb fool
crétin abruti imbécile connard minable dummkopf trottel abschaum versager widerlich idiota imbécil estúpido basura escoria""".split()
THREATS = "kill hurt destroy beat strangle tuer frapper détruire töten schlagen zerstören matar golpear destruir".split()
TARGETS = "you your yours u they them he she him her this tu toi vous ton votre du dich dir ihr euch tú usted ustedes vosotros".split()
NEGATIONS = "not never no isn't aren't wasn't don't neither nor without pas jamais aucun nicht kein keine niemals nunca jamás tampoco".split()
REPORTS = "said says saying told tells wrote writes called calls quoted claimed dit disait écrit sagte sagt schrieb nannte dijo dice escribió".split()

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: A word, or a boundary of clauses.
_TOKEN = re.compile(r"([^\W\d_]+(?:'[^\W\d_]+)?)|[.!?;:,\n()\"«»“”]+")
PREFIXES = (4, 5, 6, 7)

#: Symbols of the lexicon transducer: other, target, negation, report, threat verb, insult, boundary.
SYMBOLS = "OTNRKIB"
CONTEXTS = ("plain", "targeted", "negated", "reported", "threat", "negated threat", "reported threat")
USUAL = {"plain": 1.0, "targeted": 1.2, "negated": 0.3, "reported": 0.4, "threat": 1.2, "negated threat": 0.3, "reported threat": 0.4}
#: Lexical weight of a threat.
THREAT = 3.0


@dataclass
class Transducer:
    """Deterministic transducer: moves(state, symbol) = (state, output). A symbol is a kind of SYMBOLS with the marks that earlier machines set."""

    start: object
    moves: Callable

    def run(self, symbols: list) -> list:
        state, out = self.start, []
        for symbol in symbols:
            state, symbol = self.moves(state, symbol)
            out.append(symbol)
        return out


def compose(*transducers: Transducer) -> Transducer:
    """One transducer that feeds every output to the next; its state is the tuple of states."""

    def moves(states, symbol):
        after = []
        for t, state in zip(transducers, states):
            state, symbol = t.moves(state, symbol)
            after.append(state)
        return tuple(after), symbol

    return Transducer(tuple(t.start for t in transducers), moves)


def _negation(scope: int = 3) -> Transducer:
    def moves(left, symbol):
        kind, marks = symbol
        if kind in "BN":
            return scope if kind == "N" else 0, symbol
        return max(0, left - 1), (kind, marks | {"negated"}) if kind in "IK" and left else symbol

    return Transducer(0, moves)


def _reported() -> Transducer:
    def moves(on, symbol):
        kind, marks = symbol
        return kind != "B" and (on or kind == "R"), (kind, marks | {"reported"}) if on and kind in "IK" else symbol

    return Transducer(False, moves)


def _targeted(reach: int = 4) -> Transducer:
    def moves(left, symbol):
        kind, marks = symbol
        if kind in "BT":
            return reach if kind == "T" else 0, symbol
        return max(0, left - 1), (kind, marks | {"targeted"}) if kind == "I" and left else symbol

    return Transducer(0, moves)


def _threat(reach: int = 3) -> Transducer:
    """A threat verb waits for a target; the target then carries the threat, with the verb's marks."""

    def moves(waiting, symbol):
        kind, marks = symbol
        if kind == "K":
            return (reach, marks), symbol
        if kind == "B" or not waiting:
            return None, symbol
        left, of_verb = waiting
        if kind == "T":
            return None, (kind, of_verb | {"threat"})
        return ((left - 1, of_verb) if left > 1 else None), symbol

    return Transducer(None, moves)


GRAMMAR = compose(_negation(), _reported(), _targeted(), _threat())


def match_of(symbol) -> int:
    """What an output symbol says: 0 nothing, else 1 + the number of its context."""
    kind, marks = symbol
    if kind == "T" and "threat" in marks:
        return 1 + CONTEXTS.index("negated threat" if "negated" in marks else "reported threat" if "reported" in marks else "threat")
    return 1 + CONTEXTS.index(next((c for c in ("negated", "reported", "targeted") if c in marks), "plain")) if kind == "I" else 0


def compiled(grammar: Transducer) -> tuple[np.ndarray, np.ndarray]:
    """The reachable states of a transducer as tables (state, symbol) -> next state and match."""
    numbers, queue, after, out = {grammar.start: 0}, [grammar.start], [], []
    for state in queue:
        moved = [grammar.moves(state, (kind, frozenset())) for kind in SYMBOLS]
        for target, _ in moved:
            if target not in numbers:
                numbers[target] = len(queue)
                queue.append(target)
        after.append([numbers[target] for target, _ in moved])
        out.append([match_of(symbol) for _, symbol in moved])
    return np.array(after, np.int32), np.array(out, np.int8)


NEXT, MATCH = compiled(GRAMMAR)
_B = SYMBOLS.index("B")
#: Symbols of the clauses that run together.
CELLS = 1 << 20


@dataclass
class Model:
    prior: float = -2.2
    absent: float = -2.0
    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, 3.6))
    stems: dict[str, float] = field(default_factory=dict)
    factors: dict[str, float] = field(default_factory=lambda: dict(USUAL))

    def __post_init__(self):
        self.kinds = {**dict.fromkeys(TARGETS, "T"), **dict.fromkeys(NEGATIONS, "N"), **dict.fromkeys(REPORTS, "R"), **dict.fromkeys(THREATS, "K")}

    def weight(self, word: str) -> float:
        """Weight of a word as an insult, 0 for others."""
        best = self.words.get(word, 0.0)
        for n in PREFIXES:
            if len(word) >= n and (w := self.stems.get(word[:n], 0.0)) > best:
                best = w
        return best

    def symbols(self, chunk: str) -> tuple[list[int], list[float]]:
        """The lexicon transducer: symbols of a piece of text and their lexical weights."""
        kinds, weights = [], []
        for found in _TOKEN.finditer(chunk.lower()):
            word = found.group(1)
            if not word:
                kinds.append(_B), weights.append(0.0)
            else:  # fixed words keep their kind, whatever was learned; a target carries the threat that it completes
                kind = self.kinds.get(word) or ("I" if self.weight(word) else "O")
                kinds.append(SYMBOLS.index(kind)), weights.append(self.weight(word) if kind == "I" else THREAT if kind == "T" else 0.0)
        return kinds, weights

    def matches(self, text: str) -> list[tuple[float, str]]:
        """Weight and context of the strongest match of every matched clause."""
        kinds, weights = self.symbols(text)
        _, values, contexts, _ = matched(np.array(kinds + [_B], np.int8), np.array(weights + [0.0]), np.zeros(len(kinds) + 1, np.int64), self.arcs())
        return [(float(v), CONTEXTS[c]) for v, c in zip(values, contexts)]

    def arcs(self) -> np.ndarray:
        """Weights of arcs by match."""
        return np.array([0.0, *(self.factors[c] for c in CONTEXTS)])

    def score(self, text: str) -> float:
        return float(self.odds(np.array([sum(w for w, _ in self.matches(text))]), np.array([len(self.matches(text))]))[0])

    def odds(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.prior + np.where(counts > 0, sums, self.absent), -30, 30)))


def matched(kinds: np.ndarray, weights: np.ndarray, owner: np.ndarray, arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, weight, context and lexical weight of the strongest match of every matched clause.

    All clauses with an insult or a threat verb run through the table together, a
    symbol at a time, in groups of like length and bounded size. Each text ends in a boundary.
    """
    clause = np.cumsum(kinds == _B) - (kinds == _B)
    n = int(clause[-1]) + 1 if len(clause) else 0
    live = np.bincount(clause, weights=(kinds == SYMBOLS.index("I")) | (kinds == SYMBOLS.index("K")), minlength=n) > 0
    keep = np.flatnonzero(live[clause]) if n else np.zeros(0, np.int64)
    kinds, weights, clause, owner = kinds[keep], weights[keep], clause[keep], owner[keep]
    starts = np.flatnonzero(np.concatenate([[True], clause[1:] != clause[:-1]])) if len(clause) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([starts, [len(clause)]])).astype(np.int64)
    value, context, lexical = np.zeros(len(starts)), np.zeros(len(starts), np.int64), np.zeros(len(starts))
    order, low = np.argsort(sizes, kind="stable"), 0
    while low < len(order):
        high = low + 1
        while high < len(order) and (high + 1 - low) * int(sizes[order[high]]) <= CELLS:
            high += max(1, min(64, len(order) - high))
        rows = order[low : min(high, len(order))]
        state = np.zeros(len(rows), np.int64)
        for j in range(int(sizes[rows[-1]])):
            inside = np.flatnonzero(sizes[rows] > j)
            at = starts[rows[inside]] + j
            s, kind = state[inside], kinds[at]
            match = MATCH[s, kind]
            state[inside] = NEXT[s, kind]
            worth = arcs[match] * weights[at]
            better = np.flatnonzero((match > 0) & (worth > value[rows[inside]]))
            to = rows[inside[better]]
            value[to], context[to], lexical[to] = worth[better], match[better] - 1, weights[at[better]]
        low = high
    hit = value > 0
    return owner[starts[hit]], value[hit], context[hit], lexical[hit]


class Scanner:
    """Runs texts through the lexicon, each distinct piece of text between spaces once, and through the grammar."""

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.kinds, self.weights, self.counts, self.live = array("b"), array("d"), array("q"), array("b")

    def _row(self, chunk: str) -> int:
        row = self.rows.get(chunk)
        if row is None:
            kinds, weights = self.model.symbols(chunk)
            row = self.rows[chunk] = len(self.counts)
            self.kinds.extend(kinds), self.weights.extend(weights), self.counts.append(len(kinds)), self.live.append(any(SYMBOLS[k] in "IK" for k in kinds))
        return row

    def matches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """matched() over a batch; owners are places in it."""
        if len(self.rows) > self.most:
            self.clear()
        lists = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " ")
        coded = lists.flatten().dictionary_encode()
        table = np.array([self._row(chunk) for chunk in coded.dictionary.to_pylist()], np.int64)
        rows = table[coded.indices.to_numpy(zero_copy_only=False)] if len(table) else np.zeros(0, np.int64)
        each = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), each)
        # only texts with a word of the lexicon run
        hits = np.bincount(owner, weights=np.frombuffer(self.live, np.int8)[rows] if len(rows) else None, minlength=len(texts)) > 0
        rows, owner = rows[hits[owner]], owner[hits[owner]]
        counts = np.frombuffer(self.counts, np.int64)
        first, n = (np.cumsum(counts) - counts)[rows], counts[rows]
        ends = np.cumsum(n)
        at = np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        owner = np.repeat(owner, n)
        last = np.flatnonzero(np.concatenate([owner[1:] != owner[:-1], [True]])) + 1 if len(owner) else np.zeros(0, np.int64)
        kinds = np.insert(np.frombuffer(self.kinds, np.int8)[at] if len(at) else np.zeros(0, np.int8), last, _B)
        weights = np.insert(np.frombuffer(self.weights, np.float64)[at] if len(at) else np.zeros(0), last, 0.0)
        return matched(kinds, weights, np.insert(owner, last, owner[last - 1]), self.model.arcs())

    def scores(self, texts: pa.Array) -> np.ndarray:
        owner, values, _, _ = self.matches(texts)
        return self.model.odds(np.bincount(owner, weights=values, minlength=len(texts)), np.bincount(owner, minlength=len(texts)))


def _features(text: str) -> tuple[set[str], int]:
    """Words and prefixes (ending in *) of a text, and its min-hash sketch."""
    words = set(_WORD.findall(text.lower()))
    found = {w for w in words if len(w) >= 4}
    for n in PREFIXES:
        found.update(w[:n] + "*" for w in words if len(w) >= n)
    return found, min((zlib.crc32(w.encode()) for w in words), default=0)


def _collect_features(toxic: int, allowed):
    """Rows (feature, sketch) of the sample's documents with this label; feature "" stands for the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = allowed.value if allowed else None
        for batch in slices(batches, rows=200):
            features, sketches = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if label == toxic:
                    found, sketch = _features(text or "")
                    found = [*(found if only is None else found & only), ""]
                    features += found
                    sketches += [sketch] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(features, pa.string()), pa.array(sketches, pa.int64())], names=["feature", "sketch"])

    return run


def _support(sample: DataFrame, toxic: int, least: int, allowed=None) -> dict[str, int]:
    rows = sample.mapInArrow(lean(_collect_features(toxic, allowed)), "feature string, sketch long").distinct().groupBy("feature").agg(F.count("*").alias("n"))
    return {r.feature: r.n for r in rows.where((F.col("n") >= least) | (F.col("feature") == "")).collect()}  # bounded by the sample


_SUMS = ", ".join(f"c{i} double" for i in range(len(CONTEXTS)))


def _context_sums(model):
    """Per text of the sample the lexical weights of its matched clauses, summed by context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model.value)
        for batch in slices(batches):
            owner, _, contexts, lexical = scanner.matches(batch.column(0))
            sums = np.zeros((batch.num_rows, len(CONTEXTS)))
            np.add.at(sums, (owner, contexts), lexical)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(1).to_numpy(zero_copy_only=False) == 1), *(pa.array(c) for c in sums.T.copy())], names=["toxic", *(f"c{i}" for i in range(len(CONTEXTS)))])

    return run


def context_weights(toxic: np.ndarray, sums: np.ndarray, prior: float, usual: np.ndarray, pull: float = 20.0, steps: int = 25) -> np.ndarray:
    """Weights of contexts by a logistic regression with a fixed prior, drawn to the usual weights; Newton's method, none below 0."""
    w = usual.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(prior + sums @ w, -30, 30)))
        slope = sums.T @ (p - toxic) + pull * (w - usual)
        curve = (sums * (p * (1 - p))[:, None]).T @ sums + pull * np.eye(len(w))
        w = np.clip(w - np.linalg.solve(curve, slope), 0.0, 3.0)
    return w


def training_rows(labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id") -> DataFrame:
    """doc_id and label of at most `sample` labelled rows outside the held-out third."""
    held_out = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1
    usable = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out).select(F.col(id_col).alias("_id"), F.col("toxic").alias("_toxic"))
    return usable.orderBy(F.xxhash64("_id"), "_id", "_toxic").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn the model. Only counts per feature of the bounded sample reach the driver."""
    spark = docs.sparkSession
    rows = F.broadcast(training_rows(labels, sample, id_col))  # at most `sample` pairs of numbers
    train = docs.select(F.col(f"`{id_col}`").alias("_doc"), F.col(f"`{text_col}`").alias("_text")).join(rows, F.col("_doc") == F.col("_id")).select("_text", F.col("_toxic").cast("int").alias("_toxic"))
    # the sample's texts are read three times; keep them beside the input
    train = save(train, "toxicity-sample")
    bad = _support(train, 1, 3)
    if not bad.get(""):
        return Model()
    good = _support(train, 0, 1, spark.sparkContext.broadcast(frozenset(bad)))
    total_bad, total_good = bad.pop(""), max(1, good.pop("", 0))
    share = total_bad / (total_bad + total_good)
    model = Model(prior=math.log(share / (1 - share)))
    bar = math.log(len(bad) + 50) + 2
    for feature, a in bad.items():
        b = good.get(feature, 0)
        n = a + b
        gain = a * math.log(a / (n * share)) + (b * math.log(b / (n * (1 - share))) if b else 0)
        weight = math.log((a + 0.5) / (total_bad + 1)) - math.log((b + 0.5) / (total_good + 1))
        if feature in model.words:
            model.words[feature] = max(0.0, (weight * n + 3.6 * 2) / (n + 2))
        elif gain >= bar and (a + 0.5) / (n + 1) >= 0.85 and weight > 0:
            (model.stems if feature.endswith("*") else model.words)[feature.rstrip("*")] = weight
    sent = spark.sparkContext.broadcast(model)
    rows = np.array(train.mapInArrow(lean(_context_sums(sent)), f"toxic boolean, {_SUMS}").collect(), np.float64)  # at most `sample` rows of numbers
    toxic, sums = rows[:, 0], rows[:, 1:]
    some = sums.any(axis=1)
    fitted = context_weights(toxic[some], sums[some], model.prior, np.array([USUAL[c] for c in CONTEXTS]))
    model.factors = dict(zip(CONTEXTS, fitted.tolist()))
    bad, clean = float(toxic[~some].sum()), float((1 - toxic[~some]).sum())
    model.absent = min(0.0, math.log((bad + 0.5) / (total_bad + 1)) - math.log((clean + 0.5) / (total_good + 1)))
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _score(docs, labels, sample, id_col, text_col).alias("score"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _score(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str):
    """The score of a document as a column; only texts go to Python."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample, id_col, text_col))

    def judge():
        scanner = Scanner(sent.value)
        return lambda texts: pa.array(scanner.scores(texts), pa.float64())

    return of_text(judge, "double")(F.col(f"`{text_col}`"))


def toxicity_filter(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, with their own columns. Null and empty texts, which match nothing, stay."""
    return docs.where(_score(docs, labels, sample, id_col, text_col) < threshold)
