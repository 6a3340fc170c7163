"""Toxicity by a weighted finite-state pattern grammar, scored over clauses.

Five weighted transducers are composed. The insult transducer reads the words of a clause and writes
classes; the arcs of insults carry their weights. The threat transducer turns a threat verb into a threat
where the clause addresses someone, the target transducer marks insults in such a clause, the negation transducer
those within three words after a negation, the reported-speech transducer what a verb of saying governs, before or after
it. Arcs add weights, guesses about words to come (nondeterminism) must be kept by the end of the clause, and the best
accepted path of the composition is what the clause weighs, at least nothing. A document's score is the logistic
of the sum over its clauses that hold an insult or a threat verb.

The insult transducer's entries (whole words and stems) and all weights are fitted on at most
`FIT_ROWS` labelled rows and `FIT_BYTES` of text, the first in the order of a hash of the id, so the model and what the
driver holds do not grow with the data. An entry must be held by more toxic rows than chance over
all candidates allows, counted over documents that are not copies of each other. The weights of the four other transducers are
fitted too, drawn to priors where the rows say little.
A document is read whole: an Aho-Corasick machine finds the entries, and only clauses that hold one run
through the grammar.

Defined results: a null, empty or blank text has no clause and gets the base score; repeated rows
get equal scores; without toxic labels (or an empty labels table) every score is the base rate;
label rows that are null or name no document are ignored; columns other than doc_id and text are carried, whatever their names
(a column score is replaced).
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from .util import beside, read, released

FIT_ROWS, FIT_BYTES, FOLDS, NEED, LONGEST_STEM = 6000, 64 << 20, 5, 3, 8

#: The closed classes of the grammar.
TARGET = "you your yours yourself u ya toi tu te vous ton ta votre du dich dir dein deine euch tú ti tus usted ustedes vosotros".split()
NEGATION = "not never no isn't aren't wasn't don't doesn't without neither pas jamais aucun nicht kein keine nie nunca jamás tampoco sin".split()
REPORTED = "said says say saying wrote writes called calls claimed quoted reported told dit disait écrit sagte sagt schrieb meinte dijo dice escribió".split()
THREAT = "kill murder hurt destroy beat burn shoot stab hang tuer frapper détruire töten schlagen vernichten matar golpear destruir".split()
#: Prior weights: scale of the insults' own, threat (T), target (y), negation (n), reported speech (r); and how strongly the fit is drawn to them.
PRIOR = {"I": 1.0, "T": 6.0, "y": 0.5, "n": -8.0, "r": -4.0}
PULL = 0.5

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
STOP = re.compile(r"[.!?;\n]")


class Transducer:
    """A weighted transducer: arcs (state, class) -> [(state, added mark or class, weight)].

    The class of a symbol is its first character; marks follow it. A symbol whose class has no arc from a state
    passes unchanged and keeps the state, one whose list is empty is refused. All states but `open_` accept.
    """

    def __init__(self, start, arcs: dict, open_: frozenset = frozenset()):
        self.start, self.arcs, self.open = start, arcs, open_

    def step(self, state, symbol: str) -> list[tuple]:
        arcs = self.arcs.get((state, symbol[0]))
        if arcs is None:
            return [(state, symbol, 0.0)]
        return [(to, symbol + out[1:] if out[:1] == "+" else out + symbol[1:], weight) for to, out, weight in arcs]

    def accepts(self, state) -> bool:
        return state not in self.open

    def __matmul__(self, other: Transducer) -> Transducer:
        """Composition: this machine's output is the other's input."""
        return _Composed(self, other)

    def best(self, symbols) -> tuple[float, list[str]]:
        """Weight and output of the heaviest accepted path (0 and nothing if there is none)."""
        paths = {self.start: (0.0, ())}
        for x in symbols:
            then: dict = {}
            for state, (total, out) in paths.items():
                for to, y, weight in self.step(state, x):
                    if to not in then or then[to][0] < total + weight:
                        then[to] = total + weight, (out, y)
            paths = then
        ends = [p for state, p in paths.items() if self.accepts(state)]
        total, out = max(ends, key=lambda p: p[0], default=(0.0, ()))
        written = []
        while out:
            out, y = out
            written.append(y)
        return total, written[::-1]


class _Composed(Transducer):
    def __init__(self, first: Transducer, then: Transducer):
        super().__init__((first.start, then.start), {})
        self.first, self.then = first, then
        self.known: dict = {}

    def step(self, state, symbol):
        key = (state, symbol)
        got = self.known.get(key)
        if got is None:
            got = [((a, b), y, v + w) for a, x, v in self.first.step(state[0], symbol) for b, y, w in self.then.step(state[1], x)]
            if len(symbol) <= 8:  # classes with their marks; words are as many as the text likes
                self.known[key] = got
        return got

    def accepts(self, state) -> bool:
        return self.first.accepts(state[0]) and self.then.accepts(state[1])


class Insults(Transducer):
    """Words to classes: I insult (its weight on the arc), K threat verb, Y target, N negation, R verb of saying, o other."""

    def __init__(self, weight, classes: dict[str, str]):
        super().__init__(0, {})
        self.weight, self.classes = weight, classes

    def step(self, state, symbol):
        w = self.weight(symbol)
        return [(0, "I", w)] if w > 0 else [(0, self.classes.get(symbol, "o"), 0.0)]


def threat(weight: float) -> Transducer:
    """A threat verb in a clause that addresses someone, before (state 1) or after it (state 2, a promise), becomes T; else it is o."""
    arcs = {(0, "Y"): [(1, "Y", 0.0)], (0, "K"): [(0, "o", 0.0), (2, "T", weight)], (1, "K"): [(1, "T", weight)], (2, "Y"): [(1, "Y", 0.0)], (2, "K"): [(2, "T", weight)]}
    return Transducer(0, arcs, frozenset({2}))


def target(weight: float) -> Transducer:
    """An insult in a clause that addresses someone gets the mark y."""
    arcs = {(0, "Y"): [(1, "Y", 0.0)], (0, "I"): [(0, "I", 0.0), (2, "+y", weight)], (1, "I"): [(1, "+y", weight)], (2, "Y"): [(1, "Y", 0.0)], (2, "I"): [(2, "+y", weight)]}
    return Transducer(0, arcs, frozenset({2}))


def negation(weight: float) -> Transducer:
    """An insult or a threat within three words after a negation gets the mark n."""
    arcs = {(s, "N"): [(3, "N", 0.0)] for s in range(4)}
    arcs |= {(s, x): [(s - 1, "+n", weight)] for s in range(1, 4) for x in "IT"}
    arcs |= {(s, x): [(s - 1, x, 0.0)] for s in range(1, 4) for x in "oYR"}
    return Transducer(0, arcs)


def reported(weight: float) -> Transducer:
    """An insult or a threat in a clause with a verb of saying gets the mark r: after it (state 1), or before it (state 2, a promise; state 3 has none)."""
    arcs = {(0, "R"): [(1, "R", 0.0)], (2, "R"): [(1, "R", 0.0)], (3, "R"): []}
    for x in "IT":
        arcs |= {(0, x): [(3, x, 0.0), (2, "+r", weight)], (1, x): [(1, "+r", weight)], (2, x): [(2, "+r", weight)]}
    return Transducer(0, arcs, frozenset({2}))


def grammar(weights: dict[str, float] = PRIOR) -> Transducer:
    """The composition over classes; insults come out as I, threats as T, with the marks y, n, r."""
    return threat(weights["T"]) @ target(weights["y"]) @ negation(weights["n"]) @ reported(weights["r"])


class Model:
    """The entries of the insult transducer, the weights of the others and the base score."""

    def __init__(self, exact: dict[str, float], stems: dict[str, float], base: float, weights: dict[str, float] | None = None):
        self.exact, self.stems, self.base, self.weights = exact, stems, base, weights or dict(PRIOR)
        self.classes = {**dict.fromkeys(TARGET, "Y"), **dict.fromkeys(NEGATION, "N"), **dict.fromkeys(REPORTED, "R"), **dict.fromkeys(THREAT, "K")}
        self._machine = None

    def __getstate__(self):
        return {**self.__dict__, "_machine": None}

    def weight(self, word: str) -> float:
        best = self.exact.get(word, 0.0)
        for k in range(1, min(len(word), LONGEST_STEM) + 1):
            best = max(best, self.stems.get(word[:k], 0.0))
        return best * self.weights["I"]

    def _ready(self):
        if self._machine is None:
            import ahocorasick

            find = ahocorasick.Automaton()
            for x in {*self.exact, *self.stems, *THREAT}:
                find.add_word(x, len(x))
            find.make_automaton()
            self._machine = find, Insults(self.weight, self.classes), grammar(self.weights)
        return self._machine

    def clauses(self, text: str):
        """Weight and written classes of every clause that holds an entry or a threat verb."""
        find, words, machine = self._ready()
        low = text.lower()
        seen = -1
        for end, size in find.iter(low):
            begin = end - size + 1
            if begin <= seen or begin and low[begin - 1].isalpha():
                continue
            a = max(low.rfind(c, 0, begin) for c in ".!?;\n") + 1
            stop = STOP.search(low, end)
            b = stop.start() if stop else len(low)
            seen = b - 1
            tagged = [words.step(0, w)[0] for w in WORD.findall(low, a, b)]
            total, out = machine.best([x for _, x, _ in tagged])
            yield total + sum(w for *_, w in tagged), out

    def total(self, text: str) -> float:
        """The summed weight of a document's clauses, none of which counts less than nothing."""
        return sum(max(0.0, w) for w, _ in self.clauses(text))

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.base + self.total(text or "")))))


_NEGATION, _REPORTED = frozenset(NEGATION), frozenset(REPORTED)
#: Words of the other transducers are no entries of the insult transducer.
_CLOSED = frozenset((*TARGET, *NEGATION, *REPORTED, *THREAT))


def plain_words(text: str) -> list[str]:
    """The words that the grammar would mark neither as negated nor as reported if they were insults."""
    out = []
    for clause in STOP.split(text.lower()):
        words = WORD.findall(clause)
        if not _REPORTED.isdisjoint(words):
            continue
        if _NEGATION.isdisjoint(words):
            out += words
            continue
        free = 0
        for i, w in enumerate(words):
            if w in _NEGATION:
                free = i + 4
            elif i >= free:
                out.append(w)
    return out


def fit(rows: list[tuple[str, int]]) -> Model:
    """rows: (text, toxic).

    Words that are negated or reported count for no entry. An entry is a word, whose presence counts, or a stem, whose second occurrence counts (a stem may
    turn up once by chance), each occurrence with half of the weight. Entries are taken greedily
    until each toxic row holds NEED of them, as far as evidence goes; a logistic fit of the
    documents' totals then sets the base score and the scale.
    """
    bags = [(Counter(plain_words(t or "")), y) for t, y in rows]
    toxic = [b for b, y in bags if y]
    clean = len(bags) - len(toxic)
    if not toxic or not clean:
        rate = (len(toxic) + 0.5) / (len(bags) + 1)
        return Model({}, {}, math.log(rate / (1 - rate)))

    def features(bag: Counter) -> set[tuple[str, bool]]:
        stems: Counter = Counter()
        for w, n in bag.items():
            for k in range(3, min(len(w), LONGEST_STEM) + 1):
                stems[w[:k]] += n
        return {(w, False) for w in bag if w not in _CLOSED} | {(s, True) for s, n in stems.items() if n > 1}

    holders: dict[tuple[str, bool], list[int]] = defaultdict(list)
    for i, b in enumerate(toxic):
        for f in features(b):
            holders[f].append(i)
    holders = {f: h for f, h in holders.items() if len(h) >= 3}
    false: Counter = Counter()
    for b, y in bags:
        if not y:
            false.update(features(b) & holders.keys())
    # evidence that chance would give to one candidate in a hundred runs at most
    least = math.log(0.01 / max(1, len(holders))) / math.log(len(toxic) / len(bags))

    def evident(f) -> bool:
        """Enough of its documents share few words with each other."""
        seen: list[set] = []
        for i in holders[f]:
            b = set(toxic[i])
            if all(len(b & s) < 0.3 * min(len(b), len(s)) + 2 for s in seen):
                seen.append(b)
                if len(seen) >= least + false[f]:
                    return True
        return False

    good = sorted((f for f, h in holders.items() if false[f] <= (0.25 if f[1] else 0.02) * len(h)), key=lambda f: (-len(holders[f]), f[1], len(f[0]), f[0]))
    exact, stems, need, seen = {}, {}, [NEED] * len(toxic), set()
    while True:
        best, most = None, 2
        for f in good:
            if len(holders[f]) <= most:
                break
            if f not in seen and (gain := sum(need[i] > 0 for i in holders[f]) - 2 * false[f]) > most:
                best, most = f, gain
        if best is None:
            break
        seen.add(best)
        text, stem = best
        known = any(text.startswith(s) or stem and s.startswith(text) for s in stems) or stem and any(w.startswith(text) for w in exact)
        if known or not evident(best):
            continue
        odds = min(8.0, math.log((len(holders[best]) + 0.5) / (len(toxic) + 1)) - math.log((false[best] + 0.5) / (clean + 1)))
        (stems if stem else exact)[text] = odds / (2 if stem else 1)
        for i in holders[best]:
            need[i] -= 2 if stem else 1
    model = Model(exact, stems, 0.0)
    model.base, model.weights = _weights([(_counts(model, t or ""), y) for t, y in rows])
    return Model(exact, stems, model.base, model.weights)


def _counts(model: Model, text: str) -> tuple[float, ...]:
    """Of a document's clauses that weigh anything or hold a mark: summed weights of insults, number of threats and of the marks y, n, r."""
    own, marks = 0.0, Counter()
    for total, out in model.clauses(text):
        here = Counter(c for x in out if x[0] in "IT" for c in (x[1:] if x[0] == "I" else x))
        own += total - sum(PRIOR[c] * n for c, n in here.items())
        marks += here
    return own, *(float(marks[c]) for c in "Tynr")


def _weights(points: list[tuple[tuple[float, ...], int]], rounds: int = 50) -> tuple[float, dict[str, float]]:
    """Base score and weights by a logistic fit (Newton steps); a ridge draws the weights to their priors, and none changes its sign."""
    x = np.array([p for p, _ in points])
    y = np.array([v for _, v in points], float)
    x = np.column_stack((x, np.ones(len(x))))
    names = "ITynr"
    prior = np.array([*(PRIOR[c] for c in names), -3.0])
    ridge = np.array([PULL] * len(names) + [1e-6])
    at = prior.copy()
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (q - y) + ridge * (at - prior)
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(ridge), slope)
        at = at - step / max(1.0, np.abs(step).max())
        if np.abs(step).sum() < 1e-9:
            break
    low, high = [0.05, 0, 0, -np.inf, -np.inf, -np.inf], [np.inf, np.inf, np.inf, 0, 0, np.inf]
    at = np.clip(at, low, high)
    return float(at[-1]), dict(zip(names, map(float, at)))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS, most: int = FIT_BYTES) -> list[tuple[str, int]]:
    """At most `limit` labelled rows outside the held-out fold, of at most `most` bytes of text in all."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    some = named.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")
    sizes = texts.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    used, last = 0, len(sizes)
    for i, r in enumerate(sizes):
        used += r.bytes
        if used > most:
            last = i
            break
    if last < len(sizes):
        texts = texts.where(F.col("doc_id").isin([r.doc_id for r in sizes[:last]]))
    rows = texts.select("doc_id", "text", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(last or 1).collect() if last else []
    return [(r.text, r.toxic) for r in rows]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def toxicity(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The rows of docs with the column `name`, the score (replaced if there is one); other columns may have any names and types."""
    names = [c for c in docs.columns if c != name]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield [*b.columns[:-1], pa.array([shared.value.score(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.float64())]

    return beside(docs, names, [F.col("text").cast("string")], released(run), [StructField(name, DoubleType())])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(training_rows(docs, read(spark, sf_dir, "labels")))
    out = toxicity(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
