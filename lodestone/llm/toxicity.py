"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical step gives each word a tag and a weight: insults by learned weighted
patterns (word beginnings), threats by stems, targets, negations and verbs of saying
by short lists.  Transducers for negation, reported speech and targets each rewrite
the tags that they read; a last one takes insults and threats together to the kind of
the whole clause.  They are composed to one machine, which runs once over a clause.
A document's score is a logistic function of the weights of its matched clauses by
kind.
"""

import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import drop_written, materialised, refuse_clash, text_slices
from lodestone.llm.quality import first_by_hash

# Fixed word lists of the grammar, by tag; threats are stems with at most ENDING letters behind.
THREATS = ("kill", "murder", "hurt", "destroy", "strangl", "töte", "umbring", "vernicht", "tuer", "détrui", "frapp", "matar", "destrui", "golpe")
TARGETS = {"you", "your", "yourself", "they", "he", "she", "them", "du", "dich", "dein", "ihr", "euch", "tu", "toi", "vous", "usted", "ustedes", "tú", "él", "ella"}
NEGATIONS = {"not", "never", "no", "nor", "neither", "cannot", "isn", "aren", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "jamás"}
REPORTS = {"said", "says", "called", "claimed", "quoted", "wrote", "sagte", "schrieb", "nannte", "dit", "écrit", "appelé", "dijo", "escribió", "llamó"}
ENDING = 4
THREAT_WEIGHT = 3.0

WORDS = re.compile(r"[^\W\d_]+(?:(?<=n)['’]t\b)?")
CLAUSES = re.compile(r"[.!?;:\n]+")
SHORTEST, LONGEST = 4, 8  # letters of a beginning; whole words have SHORTEST_WORD at least
SHORTEST_WORD = 2
NEGATION_SCOPE, TARGET_SCOPE = 3, 4
KINDS = 16
#: What is learned of kinds: a weight of any match, and what threats, denial, reported speech and targets add to it.
BITS = np.array([[1, k >> 3 & 1, k >> 2 & 1, k >> 1 & 1, k & 1] for k in range(KINDS)], float)
START = np.array([1.0, 0.0, -1.0, -1.0, 0.0])
ASSERTED = ~(BITS[:, 2:4].any(1))  # neither all denied nor all told

#: Tags, and what the transducers add to them.
PLAIN, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
DENIED, TOLD, AIMED = 8, 16, 32


def listed(word: str) -> int:
    """The tag of a word by the fixed lists."""
    if word in TARGETS:
        return TARGET
    if word in NEGATIONS or word.endswith(("n't", "n’t")):
        return NEGATION
    if word in REPORTS:
        return REPORT
    return THREAT if any(word.startswith(x) and len(word) - len(x) <= ENDING for x in THREATS) else PLAIN


def tag(word: str, lexicon: dict) -> tuple[int, float]:
    """The lexical transducer: a word's tag and weight, by its longest pattern."""
    if (weight := lexicon.get(word + "$")) is not None:
        return INSULT, weight
    for k in range(min(len(word), LONGEST), SHORTEST - 1, -1):
        if (weight := lexicon.get(word[:k])) is not None:
            return INSULT, weight
    kind = listed(word)
    return kind, THREAT_WEIGHT if kind == THREAT else 0.0


class Transducer:
    """A deterministic transducer: ``arcs[state][symbol]`` is (next state, output); ``names`` are the states.

    Built from a start state and ``step(state, symbol)`` over all states that
    the alphabet reaches; state 0 is the start.
    """

    def __init__(self, start, step, alphabet):
        number, self.names, self.arcs = {start: 0}, [start], []
        for state in self.names:
            row = {}
            for x in alphabet:
                after, out = step(state, x)
                if after not in number:
                    number[after] = len(self.names)
                    self.names.append(after)
                row[x] = number[after], out
            self.arcs.append(row)
        self.alphabet = alphabet
        self.outputs = sorted({out for row in self.arcs for _, out in row.values()})

    def then(self, step, start) -> "Transducer":
        """The composition with a transducer that reads this one's output."""
        second = Transducer(start, step, self.outputs)

        def both(state, x):
            s, y = self.arcs[state[0]][x]
            t, z = second.arcs[state[1]][y]
            return (s, t), z

        out = Transducer((0, 0), both, self.alphabet)
        out.names = [second.names[t] for _, t in out.names]
        return out


def negation(state: int, x: int) -> tuple[int, int]:
    """Adds DENIED to up to NEGATION_SCOPE words after a negation."""
    if x & 7 == NEGATION:
        return NEGATION_SCOPE, x
    return max(state - 1, 0), x | DENIED if state else x


def reported(state: int, x: int) -> tuple[int, int]:
    """Adds TOLD to all that follows a verb of saying."""
    return int(state or x & 7 == REPORT), x | TOLD if state else x


def targeted(state: tuple[int, int], x: int) -> tuple[tuple[int, int], int]:
    """Adds AIMED to an insult or threat after a target, or to a target after an insult or threat, TARGET_SCOPE words at most."""
    target, hit = state
    kind = x & 7
    after = (TARGET_SCOPE if kind == TARGET else max(target - 1, 0), TARGET_SCOPE if kind in (INSULT, THREAT) else max(hit - 1, 0))
    aimed = target if kind in (INSULT, THREAT) else hit if kind == TARGET else 0
    return after, x | AIMED if aimed else x


def clause_kind(state: int, x: int) -> tuple[int, int]:
    """Takes a clause to its kind, -1 without a match: 8 if it threatens, 4 if all its matches are denied, 2 if all are told, 1 if one is aimed."""
    kind = x & 7
    if kind in (INSULT, THREAT):
        old = 6 if state < 0 else state
        state = (old & 9) | 8 * (kind == THREAT) | (old & 6 & (4 * bool(x & DENIED) + 2 * bool(x & TOLD)))
    if state >= 0 and x & AIMED:
        state |= 1
    return state, state


@cache
def context() -> Transducer:
    """Negation, then reported speech."""
    return Transducer(0, negation, range(6)).then(reported, 0)


@cache
def grammar() -> Transducer:
    """The whole composition; the name of the state at a clause's end is its kind."""
    return context().then(targeted, (0, 0)).then(clause_kind, -1)


def plain_words(text: str) -> set:
    """The distinct words that are neither negated nor reported."""
    out: set = set()
    arcs = context().arcs
    for clause in CLAUSES.split(text.lower()):
        words = WORDS.findall(clause)
        if not any(w in NEGATIONS or w in REPORTS for w in words):
            out.update(words)
            continue
        state = 0
        for w in words:
            state, x = arcs[state][listed(w)]
            if not x & (DENIED | TOLD):
                out.add(w)
    return out


def beginnings(text: str) -> set:
    """What patterns may match: the distinct plain words that no list has, each with ``$`` behind, and their beginnings."""
    words = {w for w in plain_words(text) if listed(w) == PLAIN}
    return {w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)} | {w + "$" for w in words if SHORTEST_WORD <= len(w) <= 2 * LONGEST}


def clauses(text: str, lexicon: dict, tags: dict) -> list[tuple[int, float]]:
    """Kind and weight of each matched clause of a whole text; ``tags`` keeps the tags of words seen so far."""
    found: list = []
    low = text.lower()
    for w in set(WORDS.findall(low)).difference(tags):
        tags[w] = tag(w, lexicon)
    machine = None
    for clause in CLAUSES.split(low):
        of = [tags[w] for w in WORDS.findall(clause)]
        if weight := sum([w for _, w in of]):
            machine = machine or grammar()
            state, arcs = 0, machine.arcs
            for x, _ in of:
                state = arcs[state][x][0]
            found.append((machine.names[state], weight))
    return found


def matches(text: str, lexicon: dict, tags: dict | None = None) -> np.ndarray:
    """Summed weights of the matched clauses of each kind in a whole text."""
    out = np.zeros(KINDS)
    for kind, weight in clauses(text, lexicon, {} if tags is None else tags):
        out[kind] += weight
    return out


def all_matches(texts, lexicon: dict) -> np.ndarray:
    tags: dict = {}
    rows = []
    for t in texts:
        if len(tags) > 1 << 20:
            tags.clear()
        rows.append(matches(t or "", lexicon, tags))
    return np.array(rows).reshape(-1, KINDS)


def _sample(docs, labels, train, text, doc_id, label, most):
    """At most ``most`` labelled training documents of each class, in order of hashed ids."""
    y = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & train)
    total = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [first_by_hash(y.filter(F.col("y") == k), most, total.get(k, 0)) for k in (0, 1)]
    # twice `most` ids: a proven bound
    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(picked[0].unionByName(picked[1])), "_id").select("text", "y", "_id")


def evidence(t: int, c: int, n_toxic: int, n_clean: int) -> float:
    """Nats against equal shares: the chance of ``t`` toxic of ``t + c`` documents or more is exp(-this) at most (Chernoff)."""
    if t * n_clean <= c * n_toxic:
        return 0.0
    toxic = n_toxic / (n_toxic + n_clean)
    return float(t * np.log(t / ((t + c) * toxic)) + (c * np.log(c / ((t + c) * (1 - toxic))) if c else 0.0))


def learn(sample: DataFrame, *, alpha: float = 0.01, times: int = 3) -> dict:
    """Weighted insult patterns: word beginnings that cover the toxic documents of a bounded sample.

    Only plain uses count, neither negated nor reported, so that a word clean
    documents quote can enter.  Candidates are commoner in toxic documents at the level
    ``alpha`` over all patterns tested.  A greedy cover then chooses those that add
    most weight, while what they add is significant itself, until each toxic document
    is covered ``times`` times if it can be: so words that merely stand beside insults
    in copies add little.  Of candidates that add about as much, the most certain and
    then the longest is chosen.
    """

    def count(batches):
        found: Counter = Counter()
        for part in text_slices(batches):
            for x in part.column(0).to_pylist():
                found.update(beginnings(x or ""))
        yield counted(found)

    def counted(found):
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["pattern", "n"])

    schema = "pattern string, n long"
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return {}
    # with fewer no pattern is significant, even as the only one and in no clean document
    least = int(np.ceil(np.log(1 / alpha) / np.log((n[0] + n[1]) / n[1])))
    # patterns of the toxic documents first, then how often only those are in the clean ones
    toxic = {r["pattern"]: r["n"] for r in sample.filter("y = 1").mapInArrow(count, schema).groupBy("pattern").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).collect()}

    def recount(batches):
        found: Counter = Counter()
        for part in text_slices(batches):
            for x in part.column(0).to_pylist():
                found.update(beginnings(x or "") & toxic.keys())
        yield counted(found)

    clean = {r["pattern"]: r["n"] for r in sample.filter("y = 0").mapInArrow(recount, schema).groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    weight = {p: float(np.log(((t + 0.5) / (n[1] + 1)) / ((clean.get(p, 0) + 0.5) / (n[0] + 1)))) for p, t in toxic.items()}
    need = np.log(max(len(toxic), 1) / alpha)
    weight = {p: w for p, w in weight.items() if evidence(toxic[p], clean.get(p, 0), n[1], n[0]) >= need}

    def incidence(batches):
        for part in text_slices(batches):
            found = [sorted(beginnings(x or "") & weight.keys()) for x in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(2), pa.array(found, pa.list_(pa.string()))], ["id", "patterns"])

    # lists for `most` documents at most
    kind = sample.schema["_id"].dataType.simpleString()
    lists = sample.filter("y = 1").mapInArrow(incidence, f"id {kind}, patterns array<string>").orderBy("id", "patterns").collect()
    holders: dict[str, set] = {}
    for k, r in enumerate(lists):
        for p in r["patterns"]:
            holders.setdefault(p, set()).add(k)
    lexicon, covered, done = {}, Counter(), set()
    while holders:
        gain = {p: len(h - done) for p, h in holders.items()}
        gain = {p: g for p, g in gain.items() if g and evidence(g, clean.get(p, 0), n[1], n[0]) >= need}
        if not gain:
            break
        best = max(g * weight[p] for p, g in gain.items())
        p = max((p for p, g in gain.items() if g * weight[p] >= 0.97 * best), key=lambda p: (round(weight[p], 1), len(p), gain[p], p))
        lexicon[p] = float(weight[p])
        covered.update(holders[p])
        done = {k for k, n in covered.items() if n >= times}
        # neither what it covers anyway, nor its own beginnings
        holders = {q: h for q, h in holders.items() if not (q.startswith(p) or p.startswith(q) or q.startswith(p.rstrip("$")))}
    return lexicon


def kind_weights(bits: np.ndarray) -> np.ndarray:
    w = BITS @ bits
    return np.where(ASSERTED, w, np.minimum(w, 0.0))


def fit(docs: DataFrame, labels: DataFrame, train: Column, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", *, most: int = 4000) -> dict:
    """Lexicon and weights from ``most`` labelled documents of each class at most.

    ``train`` is a condition on the id, here called ``_id``.  Without both classes
    the model scores everything 0.5 or the one class's label.

    The weight of a kind is a sum over what the clause is (``BITS``), so scarce kinds
    share evidence.  That of kinds whose matches are all denied or all told is not
    above 0: such clauses never add to a score, however many there are.
    """
    sample = materialised(_sample(docs, labels, train, text, doc_id, label, most))
    lexicon = learn(sample)
    kind = sample.schema["_id"].dataType.simpleString()

    def run(batches):
        for part in text_slices(batches):
            x = np.log1p(all_matches(part.column(0).to_pylist(), lexicon))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part.column(1), part.column(2)], ["x", "y", "id"])

    rows = sample.mapInArrow(run, f"x array<double>, y int, id {kind}").orderBy("id", "x").toPandas()
    drop_written(sample)
    w, b = np.zeros(KINDS), 0.0
    if rows["y"].nunique() == 2:
        x, y = np.stack(rows["x"]), rows["y"].to_numpy()
        v, m, r = np.r_[START, -1.0], 0.0, 0.0
        prior = v.copy()
        for t in range(1, 601):
            w = kind_weights(v[:-1])
            p = 1 / (1 + np.exp(-np.clip(x @ w + v[-1], -30, 30)))
            # where a kind's weight is held at 0 its evidence does not count
            held = x * (ASSERTED | (BITS @ v[:-1] < 0))
            g = np.r_[BITS.T @ (held.T @ (p - y)), (p - y).sum()] / len(y) + 1e-3 * (v - prior)
            m, r = 0.9 * m + 0.1 * g, 0.99 * r + 0.01 * g * g
            v = v - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(r / (1 - 0.99**t)) + 1e-9)
        w, b = kind_weights(v[:-1]), float(v[-1])
    elif len(rows):
        b = 5.0 if rows["y"].iloc[0] else -5.0
    return {"lexicon": lexicon, "w": w, "b": b}


def score(docs: DataFrame, model: dict, text: str = "text", keep=()) -> DataFrame:
    """``score`` (0 to 1), ``predicted`` and ``match_weight`` of every whole text, without a shuffle.

    Null and empty texts have no match.  Repeated rows get equal scores; an empty
    table gives no rows.  Columns of ``keep`` must not have one of the result's names.
    """
    d = docs.select(F.col(text).alias("_text"), *keep)
    refuse_clash(d.columns[1:], "_text", "score", "predicted", "match_weight")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[1:]]
    lexicon, w, b = model["lexicon"], model["w"], model["b"]

    def run(batches):
        for part in text_slices(batches, "_text"):
            x = all_matches(part.column(0).to_pylist(), lexicon)
            p = 1 / (1 + np.exp(-np.clip(np.log1p(x) @ w + b, -30, 30)))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(x.sum(1))], [*part.schema.names[1:], "score", "predicted", "match_weight"])

    return d.mapInArrow(run, ", ".join([*kinds, "score double, predicted int, match_weight double"]))
