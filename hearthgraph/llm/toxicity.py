"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers read a clause's words one after the other. Insult tells a word of its
lexicon that is addressed or said of somebody (it opens the clause, as a call does, or stands
after a copula, a determiner or an intensifier) from a stray one; threat marks words of its
lexicon that have a target before or soon after them; target binds both to an addressee in the
same clause; negation and reported speech weaken what stands in their scope. They are composed
once into a single deterministic table. What the grammar gives for a clause is the way it matched
(said or stray insult or threat; targeted, negated, reported, and combinations).

A stray insult (no target, nothing that says it of somebody) is no match of the grammar: its way
weighs STRAY, which is below the threshold whatever the word's precision, and only labelled rows
in which clauses of that way are mostly toxic can lift it.

Learned from a bounded sample of labelled rows: the insult lexicon (words, and word beginnings, so
that inflected forms count), further threat words (found before a target in toxic texts only) and
further weakening words (found before insults in texts that are not toxic), and the weight of each
way. A clause's weight is its insult's precision times that of the way; clauses combine as
independent evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .common import fold, stored, table
from .quality import labelled_sample

TOXIC, CLEAN = 2048, 8192  # labelled texts of each kind that the grammar is fitted on, at most
THRESHOLD = 0.3
STEMS = (4, 5, 6, 7, 8)  # lengths of word beginnings that may stand for a family of forms
KEEP = 60_000  # words whose kind a worker keeps; when full it starts again, which bounds memory

THREATS = frozenset("kill hurt destroy burn beat shoot stab strangle murder töte töten schlage tuer tuerai frapper matar mataré golpear".split())
TARGETS = frozenset("you your yours u they them he she him her du dich dir euch ihr sie tu toi vous ton votre usted tú ti ustedes te".split())
NEGATIONS = frozenset("not never no isn't aren't don't nicht kein keine nie pas jamais nunca jamás".split())
REPORTS = frozenset("said says wrote quoted called claimed reported sagte schrieb meinte dit écrit disait dijo escribió llamó".split())

#: What says an insult of somebody: copulas, determiners, intensifiers.
BINDERS = frozenset("is are am was were be being a an the this that these those such so very total complete utter real ist sind bist war der die das den dem ein eine einen einem dieser diese dieses so sehr echt total est es êtes suis sont le la les un une des ce cet cette ces si très vrai es eres son soy era el la los las un una este esta ese esa tan muy".split())

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_STOP = re.compile(r"[.!?;:\n]+")


@dataclass
class Transducer:
    """arcs: (state, symbol) -> (next state, symbol given out). Where none is named, the state's
    default, or else the symbol passes and the state stays. States begin at 0."""

    arcs: dict[tuple[int, str], tuple[int, str]]
    states: int
    otherwise: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol), (self.otherwise.get(state, state), symbol))


#: Symbols: w word, i insult, k threat, t target, n negation, r report, b binder. An event given
#: out is written with what binds it: "i" (said of somebody), "j" (stray) or "k", then n (negated),
#: r (reported), t (target before).
SYMBOLS = "wiktnrb"
EVENTS = ("i", "j", "k")
negation = Transducer(
    {(s, "n"): (1, "n") for s in range(4)} | {(s, e): (s + 1 if s < 3 else 0, e + "n") for s in (1, 2, 3) for e in EVENTS},
    4,
    {1: 2, 2: 3, 3: 0},  # the scope of a negation is the three words after it
)
reported = Transducer({(0, "r"): (1, "r")} | {(1, e + x): (1, e + x + "r") for e in EVENTS for x in ("", "n")}, 2)
target = Transducer({(0, "t"): (1, "t")} | {(1, e + x): (1, e + x + "t") for e in EVENTS for x in ("", "n", "r", "nr")}, 2)
#: A threat counts with a target before it, or if the next three words have one.
threat = Transducer(
    {(s, "k" + x): (0, "k" + x) for s in range(4) for x in ("t", "nt", "rt", "nrt")}
    | {(s, "k" + x): (1, "w") for s in range(4) for x in ("", "n", "r", "nr")}
    | {(s, "t"): (0, "kt") for s in (1, 2, 3)},
    4,
    {1: 2, 2: 3, 3: 0},
)
#: An insult is said of somebody at the clause's start and after a binder; another insult may
#: stand between. State 0 is the start, 1 after a binder or such an insult, 2 elsewhere.
insult = Transducer(
    {(s, "b"): (1, "b") for s in range(3)} | {(s, "i"): (1, "i") for s in (0, 1)} | {(2, "i"): (2, "j")},
    3,
    {0: 2, 1: 2},
)


def compose(*machines: Transducer) -> tuple[dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], str]], tuple[int, ...]]:
    """One table for what the machines do in turn, over the states that can be reached."""
    start = (0,) * len(machines)
    made, todo = {}, [start]
    while todo:
        state = todo.pop()
        for symbol in SYMBOLS:
            if (state, symbol) in made:
                continue
            out, new = symbol, []
            for m, s in zip(machines, state):
                s, out = m.step(s, out)
                new.append(s)
            made[state, symbol] = tuple(new), out
            todo.append(tuple(new))
    return made, start


GRAMMAR, START = compose(insult, negation, reported, target, threat)
WAYS = ["".join(x) for x in product(EVENTS, ("", "n"), ("", "r"), ("", "t"))]
#: What a way weighs before anything is learned.
STRAY = 0.25
PRIOR = {w: (0.15 if "n" in w or "r" in w else 0.95 if "t" in w else STRAY if w == "j" else 0.85) for w in WAYS}
NEAR = 3  # words that a scope reaches


def words(text: str) -> list[str]:
    return _WORD.findall(text)


def lower(text: str | None) -> str:
    return (text or "").lower()


@dataclass
class Model:
    lexicon: dict[str, float]  # word, or beginning with "*", -> precision
    ways: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    #: Precision of an entry where it is all that a text has; else as in lexicon.
    alone: dict[str, float] = field(default_factory=dict)
    threats: frozenset[str] = THREATS
    weakeners: frozenset[str] = NEGATIONS

    def __post_init__(self) -> None:
        self.stems = sorted({len(x) - 1 for x in self.lexicon if x.endswith("*")})
        self.seen: dict[str, tuple[str, str]] = {}

    def kind(self, word: str) -> tuple[str, str]:
        """The grammar's symbol for a word, and for an insult its entry."""
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) >= KEEP:
                self.seen.clear()
            entries = [e for e in (word, *(word[:n] + "*" for n in self.stems if len(word) > n)) if e in self.lexicon]
            sign = next((s for s, x in (("t", TARGETS), ("n", self.weakeners), ("r", REPORTS), ("k", self.threats), ("b", BINDERS)) if word in x), "w")
            got = self.seen[word] = ("i", max(entries, key=lambda e: (self.lexicon[e], -len(e), e))) if entries else (sign, "")
        return got

    def matches(self, text: str) -> list[tuple[str, str]]:
        """(way, entry) of the strongest match of each clause that the grammar matches."""
        kinds = {w: self.kind(w) for w in set(words(text))}
        if not any(k in EVENTS for k, _ in kinds.values()):
            return []
        out = []
        for clause in _STOP.split(text):
            state, best = START, None
            for w in words(clause):
                symbol, entry = kinds.get(w) or self.kind(w)
                state, event = GRAMMAR[state, symbol]
                if event[0] in EVENTS:
                    x = (self.ways[event] * self.lexicon.get(entry, 1.0), event, entry if event[0] != "k" else "")
                    best = max(best, x) if best else x
            if best:
                out.append(best[1:])
        return out

    def score(self, text: str | None) -> float:
        found, clear = self.matches(lower(text)), 1.0
        for way, entry in found:
            p = self.lexicon.get(entry, 1.0)
            clear *= 1 - self.ways[way] * (p if len(found) > 1 else self.alone.get(entry, p))
        if self.ways["j"] <= STRAY and all(way == "j" for way, _ in found):
            return min(1 - clear, STRAY)  # however many stray words there are
        return 1 - clear

    def contexts(self, text: str) -> set[str]:
        """The words just before an insult ("<") and those just before a target (">")."""
        out = set()
        for clause in _STOP.split(text):
            own = words(clause)
            for i, w in enumerate(own):
                sign = self.kind(w)[0]
                if sign in "it":
                    out.update((">" if sign == "t" else "<") + x for x in own[max(0, i - NEAR) : i])
        return out


def _entries(text: str) -> set[str]:
    own = set(words(text))
    return own | {w[:n] + "*" for w in own for n in STEMS if len(w) > n}


def _family(text: str) -> int:
    """The same for most near copies, so that they have one voice: the least hashes of a shingle
    under two seeds, which one shared passage hardly brings together."""
    import xxhash

    w = text.split()
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    least = [min(xxhash.xxh64_intdigest(x, seed) for x in shingles) for seed in (0, 1)]
    return xxhash.xxh64_intdigest(f"{least}") >> 1


def learn_lexicon(rows: DataFrame, n: dict[int, int]) -> dict[str, float]:
    """rows (y, text), n texts of each y: entries far more frequent in toxic texts than chance."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by[y].update(_entries(lower(t)))
        names = sorted(set(by[0]) | set(by[1]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([by[0][x] for x in names], pa.int64()), pa.array([by[1][x] for x in names], pa.int64())], ["entry", "clean", "toxic"])

    total = max(1, n[0] + n[1])
    share = min(max(n[1] / total, 1e-6), 1 - 1e-6)
    counts = rows.select("y", "text").mapInArrow(count, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    precision = (F.col("toxic") + 0.5) / (F.col("toxic") + F.col("clean") + 0.5)
    # so many toxic texts and so few others are beyond chance (tail of the share, to the power)
    beyond = F.col("toxic") * F.lit(-math.log(share)) - F.col("clean") * 3.0
    found = counts.where((F.col("toxic") >= max(3, n[1] // 200)) & (precision > F.when(F.col("entry").endswith("*"), 0.96).otherwise(0.8)) & (beyond > 10.0))
    # words of at most TOXIC texts, each in many of them and in hardly any of the CLEAN others
    return {r.entry: r.p for r in found.select("entry", precision.alias("p")).collect()}


def learn_contexts(rows: DataFrame, lexicon: dict[str, float], n: dict[int, int]) -> Model:
    """Further threats: words before a target that are as telling as an insult's. Further
    weakeners: words before insults that stand in texts that are not toxic, far beyond chance."""
    model = Model(lexicon)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by[y].update(model.contexts(lower(t)))
        names = sorted(set(by[0]) | set(by[1]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([by[0][x] for x in names], pa.int64()), pa.array([by[1][x] for x in names], pa.int64())], ["word", "clean", "toxic"])

    total = max(1, n[0] + n[1])
    share = min(max(n[1] / total, 1e-6), 1 - 1e-6)
    counts = rows.select("y", "text").mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    threat_ = F.col("word").startswith(">") & (F.col("toxic") >= max(3, n[1] // 200)) & (F.col("toxic") * F.lit(-math.log(share)) - F.col("clean") * 3.0 > 10.0)
    weak = F.col("word").startswith("<") & (F.col("clean") >= 5) & (F.col("toxic") * 4 <= F.col("clean"))
    own: dict[str, set[str]] = {"<": set(), ">": set()}
    for r in counts.where(threat_ | weak).select("word").collect():  # as bounded as the lexicon
        if r.word[1:] not in lexicon and model.kind(r.word[1:])[0] != "i":
            own[r.word[0]].add(r.word[1:])
    return Model(lexicon, threats=THREATS | (own[">"] - TARGETS), weakeners=NEGATIONS | (own["<"] - TARGETS - BINDERS))


def learn_ways(rows: DataFrame, model: Model, n: dict[int, int]) -> Model:
    """How much oftener each way occurs in toxic texts (one hardly seen keeps its prior), and how
    often a text is toxic if an entry is its only match."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: Counter = Counter()
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = model.matches(lower(t))
                by.update((way, y) for way in {way for way, _ in found})
                by.update(("=" + e, y) for _, e in found if len(found) == 1)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in by], pa.string()), pa.array([k[1] for k in by], pa.int32()), pa.array(list(by.values()), pa.int64())], ["way", "y", "n"])

    found = rows.select("y", "text").mapInArrow(count, "way string, y int, n long").groupBy("way", "y").agg(F.sum("n").alias("n"))
    seen = {(r.way, r.y): r.n for r in found.collect()}  # two rows for each way and entry at most
    for way, prior in PRIOR.items():
        toxic, clean = seen.get((way, 1), 0), seen.get((way, 0), 0) * max(n[1], 1) / max(n[0], 1)
        model.ways[way] = (toxic + 4 * prior) / (toxic + clean + 4)
    for e, p in model.lexicon.items():
        toxic, clean = seen.get(("=" + e, 1), 0), seen.get(("=" + e, 0), 0)
        model.alone[e] = (toxic + 2 * p) / (toxic + clean + 2)
    return model


def train(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic") -> Model:
    """Fit on up to TOXIC and CLEAN different labelled texts outside held_out (over doc_id)."""
    picked = labelled_sample(docs, labels, label, held_out, (CLEAN, TOXIC))
    family = pandas_udf(lambda s: pd.Series([_family(t) for t in s], dtype="int64"), "long")
    rows = stored(picked.withColumn("family", family("text")).groupBy("y", "family").agg(F.min("text").alias("text")), "toxic-sample")
    n = {0: 0, 1: 0} | {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    lexicon = learn_lexicon(rows, n) if n[1] else {}
    return learn_ways(rows, learn_contexts(rows, lexicon, n), n) if lexicon else Model({})


def score_column(model: Model, text: Column) -> Column:
    """The model, whose size the sample bounds, is sent to each executor once."""
    shared = SparkSession.active().sparkContext.broadcast((model.lexicon, model.ways, model.alone, model.threats, model.weakeners))
    made: list[Model] = []

    @pandas_udf(DoubleType())
    def score(s: pd.Series) -> pd.Series:
        if not made:
            made.append(Model(*shared.value))
        return pd.Series(np.array([made[0].score(t) for t in s], float))

    return score(text)


def scored(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic") -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 from THRESHOLD on).

    Every row is kept as it is; columns named score or predicted are replaced. Null and empty
    texts match nothing and score 0. Without toxic labels the lexicon is empty and only threats
    against a target score."""
    model = train(docs, labels, held_out, label)
    return docs.withColumn("score", score_column(model, F.col("text"))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """scored for the whole documents table; rows of null id are not held out. Nulls, empty texts,
    repeated rows and empty tables as stated there."""
    held_out = fold(F.col("doc_id"), 4) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, table(spark, sf_dir, "labels"), held_out)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
