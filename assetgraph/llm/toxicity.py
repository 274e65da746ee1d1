"""Toxicity by a weighted finite-state grammar over clauses.

A clause is the words between two of . ! ? ; : and line ends.  Its words become
symbols: INSULT, THREAT, SECOND, THIRD and SELF (persons), COPULA, NEGATION, REPORT (speech of
others), or OTHER.  Transducers rewrite them in a cascade, each reading what the one
before wrote:

target     SECOND becomes TARGET; THIRD does so if a COPULA follows at once
negation   within three words after a NEGATION, INSULT becomes NEGATED_INSULT, and THREAT NEGATED_THREAT
reported   after a REPORT, INSULT becomes REPORTED_INSULT, and THREAT REPORTED_THREAT
insult     an INSULT becomes an AIMED_INSULT if a TARGET stands within four words before it, or follows within two; SELF_INSULT if SELF is the nearer before it
threat     a THREAT becomes an AIMED_THREAT if a TARGET or a THIRD follows within four words

What follows is not known yet when a word is read, so three of them guess: one path writes the rewritten symbol and owes what must follow,
and ends if it does not come in time; another writes the plain one.  The cascade is composed into one
machine.  A last one, the acceptor, gives each aimed symbol that it reads the word's weight times a factor, a larger one for a further
aimed match in the same clause.  All other matches (bare words, those about oneself, reported, negated) are weak: one of a clause, the heaviest, gets a factor of a few
hundredths.  A clause's score is that of the best path (the largest sum), bounded; a text's
evidence is the sum over its aimed clauses, and w / (1 + w) with w the sum over its weak ones.  So any number of bare words weighs less than one aimed clause.

Word weights: a fixed seed list, and words and word starts learned from labels (log-odds
of different texts with the term; a term must stand in several different contexts, so that
copies of one text teach nothing).  A learned term is a THREAT if it shares more of its neighbours with the seeds of threats than with those of
insults (as shares of the neighbours of each), else an INSULT.  A monotone table maps evidence to a
probability; it is fitted to counts of labelled texts by evidence.  Training uses
the labelled rows outside the held-out fold, at most about `max_labels` of them,
chosen by a hash of the id (the documented bound of the classifier).

Every text is scored whole.  Null and empty texts have no evidence and get the
score of that.  Rows with equal ids are scored each.  Without labels the
score is 1 - exp(-evidence / 4).  Labels that are null or of absent documents are
ignored.  Only id and text are read for a score.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .wordhash import LOWER, Words, chunks, hash_words, mix

OTHER, INSULT, THREAT, SECOND, THIRD, SELF, COPULA, NEGATION, REPORT = range(9)
TARGET, NEGATED_INSULT, NEGATED_THREAT, REPORTED_INSULT, REPORTED_THREAT, SELF_INSULT, AIMED_INSULT, AIMED_THREAT = range(9, 17)

# Seed words by symbol.
SEEDS = {
    INSULT: "idiot idiots moron morons loser losers scum trash stupid dumb pathetic worthless disgusting clown fool imbecile jerk garbage filth coward idiotisch dummkopf trottel abschaum imbécile crétin ordure estúpido imbécil basura",
    THREAT: "kill hurt destroy beat burn shoot stab crush murder attack töten schlagen vernichten tuer frapper détruire matar golpear destruir",
    SECOND: "you your yours yourself u dich dir du ihr euch toi tu vous ton ta votre tú te usted ustedes vosotros",
    THIRD: "they them their he she him her sie er ihnen ils elles ellos ellas",
    SELF: "i me my myself mich mir ich je moi yo mí",
    COPULA: "are re is am s m m bin bist sind ist seid suis es est êtes sont soy eres son sois",
    NEGATION: "not never no nobody neither nor isn aren wasn don doesn didn nicht kein keine nie niemals pas jamais aucun nunca jamás tampoco",
    REPORT: "said says say called calls wrote writes quoted claimed reported sagte sagt schrieb behauptete dit écrit déclaré dijo dice escribió afirmó",
}
SEED_WEIGHT = 3.0
STARTS = (4, 5, 6)  # bytes of a word's start that can be learned as a term


Arcs = list[tuple[object, int, float]]  # next state, symbol written, factor of the word's weight


class Transducer:
    """A machine over symbols, which may have several arcs for one: arcs(state, symbol); accepts(state) at the end."""

    def __init__(self, start: object, arcs: Callable[[object, int], Arcs], accepts: Callable[[object], bool] = lambda state: True) -> None:
        self.start, self.arcs, self.accepts = start, arcs, accepts

    def then(self, other: Transducer) -> Transducer:
        """The composition: other reads what this one writes, and factors add up."""

        def arcs(state: tuple, symbol: int) -> Arcs:
            return [((a, b), out, w + v) for a, mid, w in self.arcs(state[0], symbol) for b, out, v in other.arcs(state[1], mid)]

        return Transducer((self.start, other.start), arcs, lambda state: self.accepts(state[0]) and other.accepts(state[1]))

    def compiled(self, symbols: int = 9) -> tuple[list[list[list[tuple[int, float]]]], list[bool]]:
        """Arcs by numbered state and symbol of all states that can be reached, and which of them accept."""
        numbers, todo, table = {self.start: 0}, [self.start], []
        for state in todo:  # grows while it is read
            row = []
            for symbol in range(symbols):
                best: dict[int, float] = {}
                for to, _, w in self.arcs(state, symbol):
                    if to not in numbers:
                        numbers[to] = len(numbers)
                        todo.append(to)
                    best[numbers[to]] = max(w, best.get(numbers[to], w))
                row.append(list(best.items()))
            table.append(row)
        return table, [self.accepts(state) for state in todo]


def after(opens: int, length: int | None, rewrites: dict[int, int]) -> Transducer:
    """In the `length` words after `opens` (None: in all that follow), symbols are rewritten."""
    reach = 1 if length is None else length

    def arcs(state: int, symbol: int) -> Arcs:
        left = reach if symbol == opens else state if length is None else max(0, state - 1)
        return [(left, rewrites.get(symbol, symbol) if state else symbol, 0.0)]

    return Transducer(0, arcs)


def target() -> Transducer:
    """Whom it is said to or of: SECOND, and THIRD with a COPULA after it; a state of 1 owes the COPULA."""

    def arcs(state: int, symbol: int) -> Arcs:
        if state and symbol != COPULA:
            return []
        if symbol == THIRD:
            return [(1, TARGET, 0.0), (0, THIRD, 0.0)]
        return [(0, {SECOND: TARGET, COPULA: OTHER}.get(symbol, symbol), 0.0)]

    return Transducer(0, arcs, lambda state: not state)


def aimed(what: int, written: int, targets: tuple[int, ...], before: int, following: int, own: int | None = None) -> Transducer:
    """`what` is rewritten if a target stands within `before` words before it, or comes within `following` after it; as `own` if SELF is the nearer before it.

    A state is (words since which a target still counts, negative for SELF; words in which one is owed).
    """

    def arcs(state: tuple[int, int], symbol: int) -> Arcs:
        near, owed = state
        if symbol in targets:
            return [((before, 0), symbol, 0.0)]
        if owed == 1:
            return []  # not in time
        later = (near - 1 if near > 0 else near + 1 if near < 0 else 0, max(0, owed - 1))
        if symbol == SELF and own is not None:
            return [((-before, later[1]), symbol, 0.0)]
        if symbol != what:
            return [(later, symbol, 0.0)]
        if near:
            return [(later, written if near > 0 else own, 0.0)]
        # plain, or a guess that a target follows (an older debt is due first)
        return [(later, what, 0.0), ((0, later[1] or following), written, 0.0)]

    return Transducer((0, 0), arcs, lambda state: not state[1])


# Factors of a word's weight by the pattern that it completes.
FACTORS = {AIMED_INSULT: 1.4, AIMED_THREAT: 1.2, INSULT: 0.04, THREAT: 0.02, REPORTED_INSULT: 0.02, REPORTED_THREAT: 0.01, NEGATED_INSULT: 0.01, NEGATED_THREAT: 0.005, SELF_INSULT: 0.01}
AGAIN = 0.2  # more for each aimed match after the first
STRONG = 1.0  # what every aimed clause reaches, and no weak one


def acceptor() -> Transducer:
    """Matched patterns get factors; the state is 2 after an aimed one, 1 after the one weak match that a path counts."""

    def arcs(state: int, x: int) -> Arcs:
        if x in (AIMED_INSULT, AIMED_THREAT):
            return [(2, x, FACTORS[x] + (AGAIN if state == 2 else 0.0))]
        return [(state, x, 0.0), *([(1, x, FACTORS[x])] if x in FACTORS and not state else [])]

    return Transducer(0, arcs)


STAGES = (
    target(),
    after(NEGATION, 3, {INSULT: NEGATED_INSULT, THREAT: NEGATED_THREAT}),
    after(REPORT, None, {INSULT: REPORTED_INSULT, THREAT: REPORTED_THREAT}),
    aimed(INSULT, AIMED_INSULT, (TARGET,), 4, 2, SELF_INSULT),
    aimed(THREAT, AIMED_THREAT, (TARGET, THIRD), 0, 4),
    acceptor(),
)
CLAUSE_MOST = 12.0


@cache
def machine() -> tuple[list[list[list[tuple[int, float]]]], list[bool]]:
    """The composed machine; it is made once in a process."""
    return reduce(Transducer.then, STAGES).compiled()


def clause_score(symbols: list[int], weights: list[float]) -> float:
    """The best path of the composed machine over one clause."""
    table, accepts = machine()
    paths = {0: 0.0}
    for symbol, weight in zip(symbols, weights):
        grown: dict[int, float] = {}
        for state, total in paths.items():
            for to, factor in table[state][symbol]:
                score = total + factor * weight
                if grown.get(to, -1.0) < score:
                    grown[to] = score
        paths = grown
    return min(CLAUSE_MOST, max(total for state, total in paths.items() if accepts[state]))


_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?;:\n\r"]] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True


def _words(column: pa.Array) -> Words:
    return hash_words(column, _LETTERS, LOWER)


def _start_keys(w: Words, k: int) -> np.ndarray:
    """A hash of each word's first k bytes; 0 for words that are not longer."""
    raw = np.concatenate([LOWER[w.raw], np.zeros(8, np.uint8)])
    key = np.zeros(len(w.starts), np.uint64)
    for j in range(k):
        key = key << np.uint64(8) | raw[w.starts + j].astype(np.uint64)
    return np.where(w.ends - w.starts > k, mix(key + np.uint64(k << 56)), np.uint64(0))


def _all_keys(w: Words) -> list[np.ndarray]:
    return [w.hashes, *(_start_keys(w, k) for k in STARTS)]


def _contexts(w: Words) -> np.ndarray:
    """A hash of each word's neighbours."""
    h = np.concatenate([[np.uint64(1)], w.hashes, [np.uint64(2)]])
    with np.errstate(over="ignore"):
        return mix(h[:-2] * np.uint64(3) + h[2:])


class Lexicon:
    """Hash -> (symbol, weight): seeds and learned terms."""

    def __init__(self, learned: dict[int, tuple[int, float]]) -> None:
        entries: dict[int, tuple[int, float]] = dict(learned)
        for symbol, words in SEEDS.items():
            hashes = _words(pa.array([words], pa.large_string())).hashes
            for h in hashes.tolist():
                entries[h] = (symbol, max(SEED_WEIGHT, entries[h][1]) if h in entries else SEED_WEIGHT)
        self.keys = np.array(sorted(entries), np.uint64)
        self.symbols = np.array([entries[k][0] for k in self.keys.tolist()], np.int8)
        self.weights = np.array([entries[k][1] for k in self.keys.tolist()])
        self.quick = np.zeros(1 << 20, bool)
        self.quick[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def lookup(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and weight of each word; the heaviest of the word and its starts."""
        symbols, weights = np.zeros(len(w.hashes), np.int8), np.zeros(len(w.hashes))
        for keys in _all_keys(w):
            at = np.flatnonzero(self.quick[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)])
            i = np.searchsorted(self.keys, keys[at])
            i[i == len(self.keys)] = 0
            ok = self.keys[i] == keys[at]
            at, i = at[ok], i[ok]
            more = self.weights[i] > weights[at]
            symbols[at[more]], weights[at[more]] = self.symbols[i[more]], self.weights[i[more]]
        return symbols, weights

    def evidence(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Evidence and number of matched clauses of each text."""
        w = _words(column)
        n = len(w.bounds) - 1
        total, weak, clauses = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        if not len(w.hashes):
            return total, clauses
        symbols, weights = self.lookup(w)
        hits = np.flatnonzero((symbols == INSULT) | (symbols == THREAT))
        breaks = np.cumsum(_BREAK[w.raw])[w.starts]
        doc = w.doc_of()
        new = np.r_[True, (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])]
        first = np.flatnonzero(new)
        which = np.unique(np.searchsorted(first, hits, side="right") - 1)
        last = np.r_[first[1:], len(breaks)]
        for c in which.tolist():
            a, b = first[c], last[c]
            score = clause_score(symbols[a:b].tolist(), weights[a:b].tolist())
            (total if score >= STRONG else weak)[doc[a]] += score
            clauses[doc[a]] += 1
        return total + weak / (1 + weak), clauses


def _summed(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal terms added up."""
    terms, at = np.unique(np.concatenate([t for t, _ in counts]), return_inverse=True)
    return terms, np.bincount(at, weights=np.concatenate([n for _, n in counts]), minlength=len(terms)).astype(np.int64)


def _count_terms(train: DataFrame, toxic: bool, wanted: np.ndarray | None) -> DataFrame:
    """(term, n): texts of one label with each term (all terms, or the wanted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for whole in batches:
            for b in chunks(whole, "text"):
                w = _words(b.column(0))
                doc = w.doc_of()
                for keys in _all_keys(w):
                    at = np.flatnonzero(np.isin(keys, wanted)) if wanted is not None else np.flatnonzero(keys)
                    pairs = np.unique(np.stack([keys[at], doc[at].astype(np.uint64)]), axis=1) if len(at) else np.zeros((2, 0), np.uint64)
                    held.append(np.unique(pairs[0], return_counts=True))
                if len(held) > 64:
                    held = [_summed(held)]
        keys, n = _summed(held)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["term", "n"])

    rows = train.where(F.col("toxic") == int(toxic)).select("text")
    return rows.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _count_contexts(train: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(term, n): different neighbourhoods of each wanted term in toxic texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text"):
                w = _words(b.column(0))
                near = _contexts(w)
                for keys in _all_keys(w):
                    at = np.flatnonzero(np.isin(keys, wanted))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at].astype(np.int64)), pa.array(near[at].astype(np.int64))], names=["term", "near"])

    rows = train.where(F.col("toxic") == 1).select("text").mapInArrow(run, "term bigint, near bigint")
    return rows.distinct().groupBy("term").agg(F.count("*").alias("n"))


def _threats(train: DataFrame, terms: list[int]) -> set[int]:
    """The terms that share a larger part of the neighbours of threats' seeds than of insults'."""
    seeds = {h: symbol for symbol in (INSULT, THREAT) for h in _words(pa.array([SEEDS[symbol]], pa.large_string())).hashes.tolist()}
    wanted = np.array(sorted({*terms, *seeds}), np.uint64)
    kinds = {INSULT: "insult", THREAT: "threat"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text"):
                w = _words(b.column(0))
                h = np.concatenate([[np.uint64(1)], w.hashes, [np.uint64(2)]])
                for keys in _all_keys(w):
                    at = np.flatnonzero(np.isin(keys, wanted))
                    near = np.concatenate([mix(h[at]), h[at + 2]])  # the word before and the word after
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(keys[at], 2).astype(np.int64)), pa.array(near.astype(np.int64))], names=["term", "near"])

    met = train.where(F.col("toxic") == 1).select("text").mapInArrow(run, "term bigint, near bigint").distinct()
    kind = F.create_map(*(F.lit(x) for h, symbol in seeds.items() for x in (int(np.uint64(h).astype(np.int64)), kinds[symbol])))
    known = met.withColumn("kind", kind[F.col("term")]).where("kind is not null").select("kind", "near").distinct()
    sizes = {r.kind: r.n for r in known.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    shared = met.join(known, "near").groupBy("term", "kind").agg(F.count("*").alias("n"))
    part: dict[int, dict[str, float]] = {}
    for r in shared.collect():  # two rows for each learned term at most
        part.setdefault(int(np.int64(r.term).astype(np.uint64)), {})[r.kind] = r.n / sizes[r.kind]
    return {t for t in terms if part.get(t, {}).get("threat", 0) > part.get(t, {}).get("insult", 0)}


def learn_terms(train: DataFrame, least_share: float = 0.002, least: int = 5, least_ratio: float = 8.0) -> dict[int, tuple[int, float]]:
    """Terms far more common in toxic texts, with their symbol and the log of that ratio (at most 8).

    Terms in fewer than `least_share` of the toxic texts are left out, which bounds
    their number by the terms of a text over that share.  Copies of a text count once.
    """
    train = written(train.select("text", "toxic").distinct(), "toxic-texts")
    texts = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = texts.get(1, 0), texts.get(0, 0)
    if not bad or not good:
        return {}
    often = {r.term: r.n for r in _count_terms(train, True, None).where(F.col("n") >= max(least, least_share * bad)).collect()}
    if not often:
        return {}
    wanted = np.array(sorted(np.array(list(often), np.int64).astype(np.uint64)), np.uint64)
    clean = {r.term: r.n for r in _count_terms(train, False, wanted).collect()}
    ratio = {t: (n / bad) / ((clean.get(t, 0) + 0.5) / good) for t, n in often.items()}
    kept = np.array([t for t, r in ratio.items() if r >= least_ratio], np.int64).astype(np.uint64)
    varied = {r.term: r.n for r in _count_contexts(train, np.sort(kept)).collect()} if len(kept) else {}
    learned = {int(np.int64(t).astype(np.uint64)): min(8.0, math.log(ratio[t])) for t, n in varied.items() if n >= max(least, 0.5 * often[t])}
    threats = _threats(train, list(learned)) if learned else set()
    return {t: (THREAT if t in threats else INSULT, weight) for t, weight in learned.items()}


STEPS = 4  # bins for each unit of evidence of aimed clauses
WEAK_STEPS = 100  # and of weak ones, which stay below 1
BINS = 300


def bin_of(evidence: Column) -> Column:
    """Bin 0 is no evidence at all."""
    strong = 1 + WEAK_STEPS + F.floor((evidence - 1) * STEPS)
    return F.when(evidence == 0, 0).when(evidence < 1, 1 + F.floor(evidence * WEAK_STEPS)).otherwise(F.least(strong, F.lit(BINS - 1))).cast("int")


def fit_scores(counts: dict[int, tuple[int, int]]) -> list[float]:
    """Probability for each bin of evidence: pooled so that it never falls (smoothed by one text of even odds)."""
    pools: list[list[float]] = []  # positives, texts, bins
    for b in range(BINS):
        pos, n = counts.get(b, (0, 0))
        pools.append([pos, n, 1])
        while len(pools) > 1 and (not pools[-1][1] or not pools[-2][1] or pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
            if not pools[-1][1] and pools[-2][1]:  # no text here: as the bin before
                pools[-2][2] += pools.pop()[2]
                continue
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    return [p for pos, n, width in pools for p in [(pos + 0.5) / (n + 1)] * int(width)]


def _with_evidence(docs: DataFrame, lexicon: Lexicon, extra: str = "") -> DataFrame:
    """id, evidence, clauses (and one more integer column)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text"):
                total, clauses = shared.value.evidence(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total), pa.array(clauses), *([b.column(2)] if extra else [])], names=["doc_id", "evidence", "clauses", *([extra] if extra else [])])

    return docs.mapInArrow(run, f"doc_id {kind}, evidence double, clauses bigint" + (f", {extra} int" if extra else ""))


def score_toxicity(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", max_labels: int = 50_000) -> DataFrame:
    """One row per document: doc_id, evidence, clauses, score.  `train` is a condition on the labels' doc_id."""
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    known = labels.where(train).select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > max_labels:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(max_labels / n * (1 << 20)))
    sample = written(docs.join(F.broadcast(known), "doc_id").where("text is not null").select("doc_id", "text", "toxic"), "toxic-sample")
    lexicon = Lexicon(learn_terms(sample))
    counts = {r.bin: (r.pos, r.n) for r in _with_evidence(sample, lexicon, "toxic").groupBy(bin_of(F.col("evidence")).alias("bin")).agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).collect()}
    out = _with_evidence(docs, lexicon)
    if not counts:
        return out.withColumn("score", 1 - F.exp(-F.col("evidence") / 4))
    table = F.array(*(F.lit(p) for p in fit_scores(counts)))
    return out.withColumn("score", F.element_at(table, bin_of(F.col("evidence")) + 1))
