"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, look-alike letters of other scripts to Latin ones, digits and
signs that stand for letters to those letters, invisible characters dropped. The lexicon holds word
beginnings and whole words with weights, found in one Aho-Corasick pass; exception phrases cancel the
terms inside them. The weighted hits, alone and against the text's length, go through a logistic curve.

Lexicon, exceptions and curve are learned from a bounded sample of labelled rows. Scoring is one
narrow pass over whole texts. Null texts count as empty; an empty text gets the score of no hits.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, keyed, slices, written

#: Characters read as Latin letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
}
INVISIBLE = "­​‌‍⁠﻿"
FOLD = str.maketrans(LOOKALIKES | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | dict.fromkeys(INVISIBLE, ""))
#: Phrases in which a term is no insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clown car", "stupid simple")
#: Common insults, folded; what the lexicon starts from before anything is learned.
INSULTS = (
    "arsehole asshole bastard bitch bollocks brainless clown coward crap creep cretin cunt degenerate despicable dickhead dimwit dirtbag disgusting douchebag dumb dumbass "
    "dunce fatso fool freak fuck fucker garbage halfwit idiot idiotic imbecile jackass jerk lame liar loser lowlife lunatic maggot moron moronic motherfucker nitwit nobody "
    "numbskull parasite pathetic pig prick psycho rat retard revolting rubbish scum scumbag shit shitty sicko slut spineless stupid swine thug trash twat twit ugly useless vermin vile wanker whore worthless wretch "
    "abschaum arschloch bloedmann dummkopf hurensohn idioten mistkerl scheisse schlampe schwachkopf spasti trottel versager wichser widerlich "
    "abruti batard connard connasse cretin debile degueulasse encule imbecile merde minable ordure pourriture salaud salope "
    "basura cabron escoria estupido gilipollas imbecil inutil mierda pendejo perdedor puta tonto"
).split()
WORD = re.compile(r"[^\W_]+")
#: At most so many labelled rows of either label are learned from.
SAMPLE = 3_000
#: Lengths of word beginnings that may become terms.
STEMS = range(3, 11)


def fold(text: str) -> str:
    return text.lower().translate(FOLD)


def features(text: str) -> set[str]:
    """Word beginnings, as is, and whole words, with a closing blank."""
    out = set()
    for word in set(WORD.findall(fold(text))):
        out.update(word[:n] for n in STEMS if n <= len(word))
        out.add(word + " ")
    return out


@dataclass
class Lexicon:
    """Terms with weights, exception phrases, and the curve's bias and two slopes."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] | None = None
    _automaton: object = None

    def __getstate__(self):
        return {"terms": self.terms, "exceptions": self.exceptions, "curve": self.curve, "_automaton": None}

    def matches(self, folded: str) -> list[tuple[int, int, str]]:
        """(start, end, term) of every term that counts."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            both = {t.rstrip(" ") for t in self.terms}
            for stem in both:  # a stem may be a beginning and a whole word as well
                kinds = tuple(t for t in (stem, stem + " ") if t in self.terms)
                self._automaton.add_word(stem, (stem, kinds))
            for phrase in self.exceptions:
                if phrase not in both:
                    self._automaton.add_word(phrase, (phrase, None))
            self._automaton.make_automaton()
        found, spared = [], []
        size = len(folded)
        for last, (word, kinds) in self._automaton.iter(folded):
            start, end = last + 1 - len(word), last + 1
            if start and folded[start - 1].isalnum():
                continue
            closed = end == size or not folded[end].isalnum()
            if kinds is None:
                if closed:
                    spared.append((start, end))
                continue
            for term in kinds:
                if term[-1] != " " or closed:
                    found.append((start, end, term))
        if spared:
            found = [m for m in found if not any(a <= m[0] and m[1] <= b for a, b in spared)]
        best: dict[int, tuple[int, int, str]] = {}
        for m in found:  # of the terms that begin one word, the heaviest counts
            if m[0] not in best or self.terms[m[2]] > self.terms[best[m[0]][2]]:
                best[m[0]] = m
        return list(best.values())

    def measures(self, text: str) -> tuple[float, float]:
        """Weighted hits, and weighted hits in a thousand characters, both as log1p."""
        if not self.terms:
            return 0.0, 0.0
        total = sum(self.terms[m[2]] for m in self.matches(fold(text)))
        return math.log1p(total), math.log1p(1000 * total / max(len(text), 200))

    def score(self, text: str) -> float:
        if self.curve is None:
            return 0.0
        a, b, c = self.curve
        x, y = self.measures(text)
        return round(1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y)))), 6)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> tuple[float, ...]:
    """Newton's method for a ridge logistic regression; the classes weigh alike."""
    x = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w, penalty = np.zeros(x.shape[1]), ridge * np.r_[0.01, np.ones(x.shape[1] - 1)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def held_out(modulus: int, rest: int, id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves ``rest``; false for null ids."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % modulus == rest, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, modulus: int, rest: int, size: int = SAMPLE) -> DataFrame:
    """(text, toxic): at most ``size`` training rows of either label, the first by a hash of the id."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where("doc_id is not null and toxic in (0, 1)").where(~held_out(modulus, rest)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for label in (0, 1):
        part = marked.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
        picked = part if picked is None else picked.unionByName(part)
    # two times ``size`` rows of an id and a label at most
    return written(docs.join(F.broadcast(picked), "doc_id").where("text <> ''").dropDuplicates(["text", "toxic"]).select("text", "toxic").repartition(8), "toxicity-sample")


def learn(rows: DataFrame, support: int = 3, share: float = 0.01, odds: float = 2.0, cover: int = 4, most: int = 2_000) -> Lexicon:
    """A lexicon from (text, toxic) rows.

    Known insults come first: one that the rows have keeps its place if toxic rows have it ``odds``
    times as often (as a logarithm) as clean ones, with that as its weight; one that they lack stays with
    two thirds of the full weight. Further candidates are features in ``support`` toxic rows and in a
    ``share`` of them at least whose log odds ratio is ``odds`` at least. Of these, terms are taken while they cover toxic
    rows not yet covered ``cover`` times, so that words that merely keep company with terms are left out.
    Of a beginning and its extensions that cover nearly the same rows, the longest is the term.

    The defaults of ``share``, ``odds`` and ``cover`` have the lowest log loss in threefold cross-validation inside
    training rows (see the README); no held-out row was looked at for them.
    """

    def count(wanted: frozenset[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tally: Counter = Counter()
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    found = features(text)
                    tally.update(found if wanted is None else found & wanted)
                    if len(tally) > 300_000:
                        yield pa.RecordBatch.from_arrays([pa.array(list(tally)), pa.array(list(tally.values()), pa.int64())], names=["feature", "n"])
                        tally.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], names=["feature", "n"])

        return run

    def totals(label: int, wanted: frozenset[str] | None, least: int) -> dict[str, int]:
        part = rows.where(F.col("toxic") == label).select("text").mapInArrow(count(wanted), "feature string, n long")
        return {r.feature: r.n for r in part.groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toLocalIterator()}

    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon()
    known = frozenset(w + " " for w in INSULTS)
    support = max(support, math.ceil(share * n_toxic))
    toxic = totals(1, known, 1) | totals(1, None, support)
    clean = totals(0, frozenset(toxic) | known, 1)
    weight = {f: math.log((t + 0.5) / (n_toxic + 1)) - math.log((clean.get(f, 0) + 0.5) / (n_clean + 1)) for f, t in toxic.items()}
    seeds = {f: weight.get(f, 0.0 if f in clean else 8 / 3) for f in known}
    seeds = {f: w for f, w in seeds.items() if w >= odds}
    wanted = frozenset(f for f, w in weight.items() if w >= odds and (toxic[f] >= support or f in seeds))

    def incidence(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([sorted(features(t) & wanted) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))], names=["found"])

    held = [r.found for r in by_batch(rows.where("toxic = 1").select("text"), incidence, "found array<string>").toLocalIterator()]
    having: dict[str, list[int]] = {}
    for i, found in enumerate(held):
        for f in found:
            having.setdefault(f, []).append(i)
    need = np.full(len(held), cover)
    terms: dict[str, float] = {f: round(min(4.0, w) / 4, 4) for f, w in sorted(seeds.items())}
    for f in seeds:
        need[[i for i in having.pop(f, ()) if need[i]]] -= 1
    for f in list(having):
        having[f] = [i for i in having[f] if need[i]]
        if not having[f] or any(f.startswith(t.rstrip(" ")) or t.startswith(f) for t in seeds):
            del having[f]
    queue = sorted(having, key=lambda f: (-len(having[f]), f))
    gain = {f: len(having[f]) for f in queue}
    while queue and len(terms) < most:
        best = max(queue, key=lambda f: (gain[f] * min(weight[f], 4.0), f))
        if gain[best] < support:
            break
        longer = [f for f in queue if f.startswith(best) and gain[f] >= 0.85 * gain[best]]
        best = max(longer, key=lambda f: (len(f), gain[f], f))
        terms[best] = round(min(4.0, weight[best]) / 4, 4)
        rows_of = np.array(having[best])
        used = rows_of[need[rows_of] > 0]
        need[used] -= 1
        done = set(used[need[used] == 0].tolist())
        queue = [f for f in queue if f != best and not (f.startswith(best) or best.startswith(f))]
        if done:
            for i in done:
                for f in held[i]:
                    if f in gain:
                        gain[f] -= 1
        queue = [f for f in queue if gain[f] >= support]
    lexicon = Lexicon(terms)

    def neighbours(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[str]] = []
        for text in batch.column(0).to_pylist():
            folded, phrases = fold(text), set()
            for start, end, _ in lexicon.matches(folded):
                word_end = end
                while word_end < len(folded) and folded[word_end].isalnum():
                    word_end += 1
                if m := re.search(r"([^\W_]+) $", folded[max(0, start - 40) : start]):
                    phrases.add(f"{m[1]} {folded[start:word_end]}")
                if m := re.match(r" ([^\W_]+)", folded[word_end : word_end + 40]):
                    phrases.add(f"{folded[start:word_end]} {m[1]}")
            out.append(sorted(phrases))
        return pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string())), batch.column(1)], names=["phrase", "toxic"])

    near = by_batch(rows.select("text", "toxic"), neighbours, "phrase array<string>, toxic int").select(F.explode("phrase").alias("phrase"), "toxic")
    tally = near.groupBy("phrase").agg(F.count_if(F.col("toxic") == 0).alias("c"), F.count_if(F.col("toxic") == 1).alias("t"))
    spared = [r.phrase for r in tally.where(f"c >= {support} and c >= 8 * t").orderBy(F.desc("c"), "phrase").limit(most).collect()]
    lexicon = Lexicon(terms, tuple(dict.fromkeys([*EXCEPTIONS, *spared])))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [lexicon.measures(t) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.float64()), pa.array([p[1] for p in pairs], pa.float64()), batch.column(1)], names=["x", "y", "toxic"])

    seen = by_batch(rows.select("text", "toxic"), measure, "x double, y double, toxic int").toPandas()
    lexicon.curve = logistic(seen[["x", "y"]].to_numpy(), seen["toxic"].to_numpy())
    return lexicon


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, rest: int = 1, threshold: float = 0.7, lexicon: Lexicon | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Learns from rows of ``labels`` (doc_id, toxic) outside the held-out part unless ``lexicon`` is
    given; without toxic and clean training rows every score is 0. Null, conflicting and repeated
    labels: null ones are left out, and of several for one id the largest counts.
    """
    docs = keyed(docs, id_col, text_col)
    lexicon = lexicon or learn(sample(docs, labels, modulus, rest))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [lexicon.score(t) for texts in slices(batch.column(1)) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = by_batch(docs, run, "doc_id long, score double", "toxicity")
    return scored.select("doc_id", held_out(modulus, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
