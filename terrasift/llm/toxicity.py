"""Toxicity by a lexicon trie intersected with Levenshtein automata, weighed by context.

The lexicon is learnt: whole words and word beginnings that occur in toxic training texts and
hardly in clean ones, chosen greedily so that every toxic text is covered a few times. A word
is matched by running it through the product of the trie and the Levenshtein automaton of all
its terms at once; product states are built when first met. Long terms, whole words and
beginnings alike, allow one edit, very long ones two. A beginning comes with the telling whole
words of its family, so that short ones have a term for their misspellings too. Near forms are
let pass where clean training texts use them well more often than toxic ones do.

Every hit is scored in a window of words around it: quotation marks, words of reporting and
words of address tell a quotation from abuse. A logistic model over the hits' sums gives the
score of a text; every text is read whole.

The fit reads at most ``TOXIC`` and ``CLEAN`` labelled texts of the training folds, chosen by a
hash of the id and read whole; near copies among them count once.

Defined cases: null and empty texts have no hits and get the score of none; without toxic
labels every score is 0; a doc_id with several labels is toxic if any says so; null ids are in
the training folds but have no labels; repeated rows get equal scores; an empty table gives an
empty result; labels other than 0 and 1, and labels without an id, teach nothing; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import fold, stage

FOLDS, HELD_OUT = 3, 1
TOXIC, CLEAN, SEED = 2_000, 10_000, 13
THRESHOLD = 0.7
#: Beginnings of words that may become terms, by length.
STEMS = range(4, 9)
#: How often every toxic text is to be covered.
COVER = 8
#: Terms expected to be chosen by chance.
CHANCE = 0.05
#: Shortest terms that allow one and two edits.
ONE_EDIT, TWO_EDITS = 5, 10
#: A near form is let pass if so many clean texts use it, at this share of its rate in toxic texts at least.
SEEN_CLEAN, ORDINARY = 2, 0.1
WINDOW = 8
#: Words whose match a task remembers, and product states; emptied when full.
REMEMBERED, STATES = 300_000, 200_000

WORDS = re.compile(r"\w+")
# Words of reporting and of address, and quotation marks.
REPORTING = frozenset(
    "said says say wrote writes called calls quoted quote quotes claimed reported report allegedly word term "
    "sagte sagt schrieb nannte zitat angeblich wort dit disait écrit appelé citation mot dijo dice escribió llamó "
    "cita palabra según".split()
)
ADDRESS = frozenset("you your you're youre u du dich dein ihr tu toi ton vous votre usted tú te tus".split())
QUOTES = '"“”„«»‹›'


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


class Lexicon:
    """Terms as a trie, matched through lazily built states of trie x Levenshtein automaton."""

    def __init__(self, terms: Iterable[str], passed: Iterable[str] = ()):
        self.terms, self.passed = sorted(terms), frozenset(passed)
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, int, bool] | None] = [None]  # (term, edits allowed, is a beginning)
        self.slack = [0]  # edits that some term below allows
        for number, term in enumerate(self.terms):
            stem = term.endswith("*")
            letters = term.rstrip("*")
            allowed = int(len(letters) >= ONE_EDIT) + int(len(letters) >= TWO_EDITS)
            node = 0
            self.slack[0] = max(self.slack[0], allowed)
            for c in letters:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.slack.append(0)
                node = self.children[node][c]
                self.slack[node] = max(self.slack[node], allowed)
            self.ends[node] = (number, allowed, stem)
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.memory: dict[str, tuple[int, int] | None] = {}
        self.start = self._state({(0, 0)})

    def _state(self, places: set[tuple[int, int]]) -> int:
        """Number of the state closed under skipped term letters; -1 for the dead one."""
        best: dict[int, int] = {}
        todo = list(places)
        while todo:
            node, edits = todo.pop()
            if edits > self.slack[node] or best.get(node, 9) <= edits:
                continue
            best[node] = edits
            todo += [(child, edits + 1) for child in self.children[node].values()]
        if not best:
            return -1
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return self.ids[key]

    def _step(self, state: int, letter: str) -> int:
        places: set[tuple[int, int]] = set()
        for node, edits in self.states[state]:
            if letter in self.children[node]:
                places.add((self.children[node][letter], edits))
            places.add((node, edits + 1))
            places.update((child, edits + 1) for child in self.children[node].values())
        self.steps[state][letter] = found = self._state(places)
        return found

    def _end(self, state: int, letter: str | None = None) -> tuple[int, int] | None:
        """(edits, term) of the closest whole term that ends here, or with ``letter``, the last read, of the closest beginning.

        A beginning's last letter must be there: without it, the edit would make a shorter beginning of it.
        """
        return min((
            (edits, self.ends[node][0]) for node, edits in self.states[state]
            if self.ends[node] and self.ends[node][2] == (letter is not None) and edits <= self.ends[node][1]
            and (not edits or letter is None or self.terms[self.ends[node][0]][-2] == letter)
        ), default=None)

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the closest term, or None."""
        if word in self.memory:
            return self.memory[word]
        if len(self.memory) >= REMEMBERED or len(self.states) >= STATES:
            self._reset()
        found = min((k for k, form in self.matches(word) if not k[0] or form not in self.passed), default=None)
        self.memory[word] = found
        return found

    def matches(self, word: str) -> list[tuple[tuple[int, int], str]]:
        """(edits, term) and form of every match: the word, or as far as a beginning reaches, starred."""
        state, out = self.start, []
        for at, letter in enumerate(word, 1):
            state = self.steps[state].get(letter, -2) if letter in self.steps[state] else self._step(state, letter)
            if state < 0:
                return out
            if stem := self._end(state, letter):
                out.append((stem, f"{word[:at]}*"))
        if whole := self._end(state):
            out.append((whole, word))
        return out


@dataclass
class Hit:
    word: str
    term: int
    edits: int
    quoted: bool
    reported: bool
    addressed: bool


def hits(text: str | None, lexicon: Lexicon) -> tuple[list[Hit], int]:
    """The text's hits with their context, and its number of words."""
    low = (text or "").lower()
    words = WORDS.findall(low)
    memory, match = lexicon.memory, lexicon.match
    marked = {w for w in set(words) if (memory[w] if w in memory else match(w)) is not None}
    if not marked:
        return [], len(words)
    found, spans = [], [m.span() for m in WORDS.finditer(low)]
    for i, word in enumerate(words):
        if word not in marked:
            continue
        edits, term = lexicon.match(word)
        near = set(words[max(0, i - WINDOW): i + WINDOW + 1])
        left = low[spans[max(0, i - WINDOW)][0]: spans[i][0]]
        right = low[spans[i][1]: spans[min(len(spans) - 1, i + WINDOW)][1] + 1]
        quoted = sum(map(left.count, QUOTES)) % 2 == 1 and any(q in right for q in QUOTES)
        found.append(Hit(word, term, edits, quoted, bool(near & REPORTING), bool(near & ADDRESS)))
    return found, len(words)


def features(found: list[Hit], words: int) -> list[float]:
    """Sums over the hits: abuse, misspelled abuse, quotations, address, density."""
    abuse = sum(1.0 for h in found if not h.quoted and not h.edits)
    near = sum(1.0 for h in found if not h.quoted and h.edits)
    quoted = sum(1.0 for h in found if h.quoted)
    return [
        1.0, float(abuse > 0), math.log1p(abuse), float(near > 0), math.log1p(near), float(quoted > 0 and not abuse),
        math.log1p(quoted), float(any(h.addressed and not h.quoted for h in found)),
        float(bool(found) and all(h.reported for h in found)), 10.0 * abuse / (10.0 + words),
    ]


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    passed: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self, text: str | None, lexicon: Lexicon) -> tuple[float, int]:
        found, words = hits(text, lexicon)
        if not self.weights:
            return 0.0, len(found)
        z = sum(w * x for w, x in zip(self.weights, features(found, words)))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z)))), len(found)


def units(words: set[str]) -> set[str]:
    """Candidate terms of a text: its words, and their beginnings marked by a star."""
    out = {w for w in words if len(w) >= STEMS[0]}
    out |= {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}
    return out


def without_near_copies(texts: list[list[str]], rounds: int = 4) -> list[int]:
    """Places of texts that share none of a few minimum hashes of five-word runs with an earlier one."""
    random = np.random.default_rng(SEED)
    factors = random.integers(1, 1 << 31, rounds, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    seen: set[tuple[int, int]] = set()
    kept = []
    for place, words in enumerate(texts):
        runs = {zlib.crc32(" ".join(words[i:i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 4))}
        base = np.fromiter(runs, np.uint64, len(runs))
        with np.errstate(over="ignore"):
            least = {(k, int((base * f).min())) for k, f in enumerate(factors)}
        if not least & seen:
            kept.append(place)
        seen |= least
    return kept


def learn_terms(toxic: list[list[str]], clean: list[list[str]]) -> list[str]:
    """Terms that cover the toxic texts; a term must be too frequent there to be chance."""
    toxic = [toxic[i] for i in without_near_copies(toxic)]
    counts: Counter[str] = Counter()
    for words in toxic:
        counts.update(units(set(words)))
    often = {u: n for u, n in counts.items() if n >= 3}
    spoiled: Counter[str] = Counter()
    for words in clean:
        spoiled.update(u for u in units(set(words)) if u in often)
    # A bound on the terms of all candidates that would be pure by chance.
    base = len(toxic) / max(1, len(toxic) + len(clean))
    least = max(3, math.ceil(math.log(max(len(often), 1) / CHANCE) / -math.log(min(max(base, 1e-6), 0.9))))
    # Not more than one clean text in fifty of what the toxic rate would give.
    pure = {u for u, n in often.items() if n >= least and spoiled[u] / max(1, len(clean)) <= 0.02 * n / len(toxic)}
    holders: dict[str, list[int]] = {u: [] for u in pure}
    for i, words in enumerate(toxic):
        for u in units(set(words)) & pure:
            holders[u].append(i)
    # A beginning stands for a family of words: it must hold well more texts than any one of them.
    largest: Counter[str] = Counter()
    for word in (u for u in counts if u[-1] != "*"):
        for n in STEMS:
            if len(word) > n:
                largest[f"{word[:n]}*"] = max(largest[f"{word[:n]}*"], counts[word])
    pure = {u for u in pure if u[-1] != "*" or counts[u] >= 1.5 * largest[u]}
    need = np.full(len(toxic), COVER)
    chosen: list[str] = []
    family: set[str] = set()
    while pure:
        # Whole words and the longest, most telling beginnings first among equals.
        gain, _, _, unit = max((int((need[holders[u]] > 0).sum()), u[-1] != "*", len(u), u) for u in pure)
        if gain < least:
            break
        chosen.append(unit)
        need[holders[unit]] -= 1
        stem = unit.rstrip("*")
        # A word under a beginning stays a term, for misspellings that the beginning misses; it adds no cover.
        family |= {u for u in pure if unit[-1] == "*" and u[-1] != "*" and u.startswith(stem)}
        # What a beginning covers is done, and so is a shorter one that holds hardly more texts.
        pure = {
            u for u in pure if u != unit and not (unit[-1] == "*" and (
                u.startswith(stem) or u[-1] == "*" and stem.startswith(u[:-1]) and counts[u] < 1.2 * counts[unit]
            ))
        }
    return chosen + sorted(family.difference(chosen))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, steps: int = 60) -> np.ndarray:
    """Newton's method with a small penalty; the intercept comes first."""
    weights, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - y) + shrink * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9)
        change = np.linalg.solve(curve, slope)
        weights -= change * min(1.0, 3.0 / max(1e-12, float(np.abs(change).max())))
        if np.abs(change).max() < 1e-6:
            break
    return weights


def training_texts(docs: DataFrame, labels: DataFrame) -> list[tuple[int, str]]:
    """(toxic, text) of a bounded hash sample of the training folds' labelled rows."""
    marks = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = stage(marks.withColumn("_u", F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id"), 11) / F.lit(float(1 << 53))), "toxic-marks")
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bound = {1: TOXIC, 0: CLEAN}
    near = F.lit(False)
    for label, n in sizes.items():
        near |= (F.col("toxic") == label) & (F.col("_u") * n <= 1.2 * bound[label] + 20)
    # The chosen marks are bounded like the sample, so the texts stay where they are.
    chosen = stage(marks.filter(near), "toxic-chosen")
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("toxic", "_u", "text")
    rows = stage(rows, "toxic-sample")
    out = []
    for label in sorted(sizes):
        drawn = rows.filter(F.col("toxic") == label).orderBy("_u", "text").limit(bound[label])
        out += [(label, r["text"]) for r in drawn.select("text").collect()]
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    # Equal words of all texts are one object.
    sample = [(label, text, list(map(sys.intern, words_of(text)))) for label, text in training_texts(docs, labels)]
    toxic, clean = [w for y, _, w in sample if y], [w for y, _, w in sample if not y]
    if not toxic or not clean:
        return Model()
    terms = learn_terms(toxic, clean)
    lexicon = Lexicon(terms)
    near: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
    for label, _, words in sample:
        near[label].update({
            form for w in set(words) if (m := lexicon.match(w)) and m[0] for k, form in lexicon.matches(w)
        })
    # Nothing is learnt from near forms of clean texts: what is seen there once may be wrongly labelled.
    taught = Lexicon(terms, near[0])
    x = np.array([features(*hits(text, taught)) for _, text, _ in sample])
    passed = (w for w, n in near[0].items() if n >= SEEN_CLEAN and n / len(clean) >= ORDINARY * near[1][w] / len(toxic))
    model = Model(terms, sorted(passed))
    model.weights = logistic(x, np.array([y for y, _, _ in sample], float)).tolist()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, n_hits."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.terms, model.passed)
        for batch in batches:
            rated = [model.score(t.as_py(), lexicon) for t in batch.column("text")]
            scores = np.array([s for s, _ in rated], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores),
                 pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array([n for _, n in rated], pa.int32())],
                ["doc_id", "held_out", "score", "predicted", "n_hits"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    held = (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(
        rate, f"doc_id {kind}, held_out boolean, score double, predicted int, n_hits int"
    )
