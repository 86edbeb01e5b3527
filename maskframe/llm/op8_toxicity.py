"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as a sequence of word classes: insult, harm, intent, target, negation, report, other.
Five small transducers mark the words: insult tells the first insult of a clause from those that follow it,
threat tells harm that is announced within a few words from harm that is only mentioned, target marks
clauses that address somebody, negation the next words, reported speech the rest of the clause. They are
composed into one machine, and a clause is one run of it; its output tells for each insult or threat in
which context it stands. A text's score is a logistic function of the weights so gathered over its clauses
that match; words outside a match count for nothing.

The words of the other classes are fixed. Insults are word beginnings learned from labels: those that
toxic texts have and clean ones don't, chosen greedily until the toxic texts are covered several times.
Copies and near copies count as one text in learning. One automaton finds the places of insults and harm
in a text, and only the clauses around them are cut into words.

Learning sees a hash sample of about SAMPLE_TOXIC toxic and SAMPLE_CLEAN clean labelled documents, and
at most LEXICON insults; so its size is bounded. Scoring sees every whole text.

Defined results. Null and empty texts have no clauses and get the score of no match. Without labels of
both kinds nothing is learned and all scores are that of no match, about 1e-13. Repeated rows are scored alike. Documents labelled
more than once are toxic if any label says so.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import chunks, held_out, materialise, shipped, trainable

SAMPLE_TOXIC = 4000
SAMPLE_CLEAN = 12000
LEXICON = 500
COVER = 4
#: Least share of a beginning's texts that are toxic, were both kinds equally many; and texts of clean kind for one toxic one.
PURITY = 0.9
MOST_CLEAN = 0.5
SUPPORT = 0.004
PREFIX = range(3, 9)

# Words of the grammar's classes in the four languages.
INTENTS = frozenset("will shall gonna going must should wanna want let i'll we'll werde werden will wollen muss soll vais va vont allons veux dois voy vas va vamos quiero debo".split())
TARGETS = frozenset("you your yours yourself u he she him her his they them their these those du dich dir dein deine ihr euch euer sie ihn ihm tu te toi ton ta tes vous votre vos il elle lui eux leur tú ti tus usted ustedes él ella ellos ellas vosotros".split())
NEGATIONS = frozenset("not no never none nobody neither nor without isn't aren't wasn't don't doesn't didn't nicht kein keine keinen nie niemals ohne weder ne pas jamais aucun aucune sans ni no nunca jamás ningún ninguna sin tampoco".split())
REPORTS = frozenset("said says say saying called calls claimed claims wrote writes reported quoted told according sagte sagt sagen nannte nennt schrieb laut behauptet dit disait appelle appelait selon écrit prétend dijo dice decía llamó llama según escribió afirma".split())
THREATS = frozenset("kill hurt destroy beat punch stab shoot burn töten schlagen zerstören verbrennen erschießen tuer frapper détruire brûler abattre matar golpear destruir quemar disparar".split())

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n|,()\"«»“”]+")

CLASSES = OTHER, INSULT, HARM, INTENT, TARGET, NEGATION, REPORT = range(7)
#: Words that negation and an intention reach.
NEGATION_REACH, INTENT_REACH = 3, 4


# Transducers ------------------------------------------------------------------------------------


@dataclass
class Transducer:
    """A deterministic transducer over word classes that adds a mark to each word: arcs[state][class] is (state, mark)."""

    arcs: list[list[tuple[int, int]]]
    marks: int

    def compose(self, other: "Transducer") -> "Transducer":
        """Both on the same words; states and marks are pairs, each as one number."""
        n = len(other.arcs)
        arcs = [[(a[c][0] * n + b[c][0], a[c][1] * other.marks + b[c][1]) for c in CLASSES] for a in self.arcs for b in other.arcs]
        return Transducer(arcs, self.marks * other.marks)

    def run(self, classes: list[int], state: int = 0) -> list[int]:
        out = []
        for c in classes:
            state, mark = self.arcs[state][c]
            out.append(mark)
        return out


def insult() -> Transducer:
    """1 for the first insult of a clause, 2 for each that follows it."""
    return Transducer([[(1, 1 + seen) if c == INSULT else (seen, 0) for c in CLASSES] for seen in (0, 1)], 3)


def threat(reach: int) -> Transducer:
    """1 for harm, 2 for harm at most `reach` words after an intention."""
    return Transducer([[(reach if c == INTENT else max(left - 1, 0), 0 if c != HARM else 1 + (left > 0)) for c in CLASSES] for left in range(reach + 1)], 3)


def after(trigger: int, reach: int | None) -> Transducer:
    """Marks words after a word of class `trigger`: the next `reach` ones, or all to the end."""
    last = 1 if reach is None else reach
    fade = lambda left: left if reach is None else max(left - 1, 0)
    return Transducer([[(last if c == trigger else fade(left), int(left > 0)) for c in CLASSES] for left in range(last + 1)], 2)


PARTS = [insult(), threat(INTENT_REACH), after(TARGET, None), after(NEGATION, NEGATION_REACH), after(REPORT, None)]
GRAMMAR = reduce(Transducer.compose, PARTS)
#: The state in which only a target has been seen: clauses with one begin there, as it may follow the insult.
ADDRESSED = math.prod(len(t.arcs) for t in PARTS[3:])
#: Features: matches by mark; the strongest clause; clauses that match.
FEATURES = GRAMMAR.marks + 2


@dataclass
class Grammar:
    insults: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    bias: float = -30.0

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for w in [*self.insults, *THREATS]:
            a.add_word(w, w)
        a.make_automaton()
        return a

    def symbol(self, word: str, insulting: float) -> int:
        """The class of a word, of which the automaton knows whether it begins like an insult."""
        if insulting:
            return INSULT
        return next((c for c, words in ((HARM, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (INTENT, INTENTS)) if word in words), OTHER)

    def features(self, text: str, automaton) -> np.ndarray | None:
        """What the grammar gathers from a text; None if nothing in it matches."""
        text = text.lower()
        places: dict[int, float] = {}
        for end, w in automaton.iter(text):
            begin = end - len(w) + 1
            if not begin or not text[begin - 1].isalpha():
                places[begin] = max(places.get(begin, 0.0), self.insults.get(w, 0.0))
        if not places:
            return None
        edges = [0, *(x for m in _CLAUSE.finditer(text) for x in m.span()), len(text)]
        out, strongest, clauses = np.zeros(FEATURES), 0.0, 0
        for k in sorted({bisect_right(edges, p) - 1 for p in places}):
            words = list(_WORD.finditer(text, edges[k], edges[k + 1]))
            weights = [places.get(m.start(), 0.0) for m in words]
            classes = [self.symbol(m[0], w) for m, w in zip(words, weights)]
            if INSULT not in classes and HARM not in classes:
                continue
            total = 0.0
            for c, weight, mark in zip(classes, weights, GRAMMAR.run(classes, ADDRESSED if TARGET in classes else 0)):
                if c in (INSULT, HARM):
                    out[mark] += weight or 1.0
                    total += weight or 1.0
            strongest, clauses = max(strongest, total), clauses + 1
        if not clauses:
            return None
        out[: GRAMMAR.marks] = np.log1p(out[: GRAMMAR.marks])
        out[-2:] = math.log1p(strongest), math.log1p(clauses)
        return out

    def score(self, x: np.ndarray | None) -> float:
        z = self.bias if x is None else self.bias + float(self.weights @ x)
        return 1.0 / (1.0 + math.exp(-max(min(z, 30.0), -30.0)))


# Learning ---------------------------------------------------------------------------------------


def _beginnings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word beginnings of each text, and the least hash of its five-word shingles."""
    import xxhash

    for part, texts in chunks(batches, "text"):
        sets, least = [], []
        for t in texts:
            words = _WORD.findall(t.decode("utf-8", "replace").lower())
            sets.append(sorted({w[:k] for w in set(words) for k in PREFIX if k <= len(w)}))
            least.append(min((xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0) >> 1)
        kept = part.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sets, pa.list_(pa.string())), pa.array(least, pa.int64())], names=[*kept.schema.names, "beginnings", "shingle"])


def sample_labels(labels: DataFrame, doc_id: str = "doc_id", toxic: str = "toxic", n_toxic: int = SAMPLE_TOXIC, n_clean: int = SAMPLE_CLEAN) -> DataFrame:
    """doc_id and toxic of a bounded hash sample of the labels that may be learned from."""
    rows = labels.where(trainable(F.col(doc_id)) & F.col(toxic).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in rows.where("toxic in (0, 1)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = lambda k, n: int(min(1.0, n / max(1, sizes.get(k, 0))) * 1_000_000)
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    return rows.where(F.when(F.col("toxic") == 1, bucket < share(1, n_toxic)).when(F.col("toxic") == 0, bucket < share(0, n_clean)).otherwise(False))


def choose_insults(owners: dict[str, set[int]], purity: dict[str, float], toxic: int) -> dict[str, float]:
    """Word beginnings in the order in which they cover most toxic texts that aren't covered COVER times yet; the weight is the log odds."""
    need, least = Counter({d: COVER for s in owners.values() for d in s}), max(3, SUPPORT * toxic)
    chosen: dict[str, float] = {}
    rest = dict(owners)
    while rest and len(chosen) < LEXICON:
        gain = lambda w: sum(need[d] > 0 for d in rest[w])
        best = max(rest, key=lambda w: (gain(w), -len(w), w))
        if gain(best) < least:
            break
        for d in rest[best]:
            need[d] -= 1
        chosen[best] = purity[best]
        # Longer and shorter forms of a chosen beginning say nothing new.
        rest = {w: s for w, s in rest.items() if not w.startswith(best) and not best.startswith(w) and sum(need[d] > 0 for d in s) >= least}
    return chosen


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps, with a ridge on the weights; a damped step if the loss would rise."""
    a = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(a.shape[1])
    loss = lambda w: float(np.logaddexp(0, -(2 * y - 1) * (a @ w)).sum() + 0.5 * (penalty * w * w).sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + penalty * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step, rate, before = np.linalg.solve(hessian, gradient), 1.0, loss(w)
        while rate > 1e-4 and loss(w - rate * step) > before:
            rate /= 2
        w = w - rate * step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Grammar:
    sample = materialise(sample_labels(labels), "toxicity-labels")  # at most about SAMPLE_TOXIC + SAMPLE_CLEAN rows
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).join(F.broadcast(sample), "doc_id")
    texts = materialise(texts, "toxicity-texts")
    kind = texts.schema["doc_id"].dataType.simpleString()
    begun = texts.transform(shipped).mapInArrow(_beginnings, f"doc_id {kind}, toxic int, beginnings array<string>, shingle long")
    once = materialise(begun.dropDuplicates(["toxic", "shingle"]), "toxicity-beginnings")
    sizes = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Grammar({})
    listed = once.select("shingle", "toxic", F.explode("beginnings").alias("w"))
    counts = listed.groupBy("w").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    share_p, share_n = F.col("p") / toxic, F.col("n") / clean
    pure = counts.where((F.col("p") >= max(3, SUPPORT * toxic)) & (share_p / (share_p + share_n) >= PURITY) & (F.col("n") <= MOST_CLEAN * F.col("p")))
    pure = pure.withColumn("odds", F.log((F.col("p") + 0.5) / (toxic + 1)) - F.log((F.col("n") + 0.5) / (clean + 1)))
    # Bounded by the sample: its toxic texts' beginnings that are frequent and pure.
    pairs = listed.where("toxic = 1").join(pure, "w").select("w", "shingle", "odds").toPandas()
    owners: dict[str, set[int]] = defaultdict(set)
    for w, d in zip(pairs["w"], pairs["shingle"]):
        owners[w].add(d)
    grammar = Grammar(choose_insults(owners, dict(zip(pairs["w"], pairs["odds"])), toxic))
    rows = texts.transform(shipped).mapInArrow(_features(grammar), "toxic int, x array<double>, h long").toPandas()
    rows = rows.drop_duplicates(["toxic", "h"])
    matched = rows["x"].map(len) > 0
    x = np.array([np.asarray(v) if len(v) else np.zeros(FEATURES) for v in rows["x"]]).reshape(-1, FEATURES)
    if matched.any():
        grammar.weights, grammar.bias = fit_logistic(x, rows["toxic"].to_numpy(float))
    return grammar


def _features(grammar: Grammar):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        automaton = grammar.automaton()
        for part, texts in chunks(batches, "text"):
            found = [grammar.features(t.decode("utf-8", "replace"), automaton) for t in texts]
            hashes = [xxhash.xxh64_intdigest(t) >> 1 for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array([[] if x is None else x.tolist() for x in found], pa.list_(pa.float64())), pa.array(hashes, pa.int64())], names=["toxic", "x", "h"])

    return run


# Scoring ----------------------------------------------------------------------------------------


def score(docs: DataFrame, grammar: Grammar, keys: list[Column], text: str = "text") -> DataFrame:
    """The key columns, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)  # at most LEXICON words

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        automaton = g.automaton()
        for part, texts in chunks(batches, "text"):
            found = [g.score(g.features(t.decode("utf-8", "replace"), automaton)) for t in texts]
            kept = part.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())], names=[*kept.schema.names, "score", "predicted"])

    df = docs.select(*keys, F.col(text).cast("binary").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text")
    return df.transform(shipped).mapInArrow(run, f"{schema}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; learned from labels of those not held out."""
    grammar = learn(docs, labels)
    return score(docs, grammar, [F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")])
