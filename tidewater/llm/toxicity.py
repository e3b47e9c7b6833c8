"""Toxicity by a weighted finite-state pattern grammar.

Words become classes (insult, threat, target, negation, report verb, other). Transducers for negation, reported speech, targets, insults and
threats, composed (see ``toxicity_grammar``), turn a clause into its gravest event: an insult, plain, heaped or aimed, denied or
reported, or a threat at a target. A text's score is a logistic function
of how many clauses hold each event. Insult stems are learned from labelled rows; the
closed classes are short lists; the event weights start at a prior and are fitted on the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .shared import by_batch, written
from .toxicity_grammar import CODE, EVENTS, INSULT, NEGATION, REPORT, TARGET, THREAT, clause_events

#: Labelled rows that stems and weights are learned from at most.
SAMPLE_ROWS = 20_000
#: Share of chance finds among the learned stems, about.
FALSE_SHARE = 0.05
#: Bytes of the word beginnings that are learned as stems, besides whole words (0).
STEM_SIZES = (0, 4, 6)

CLOSED = {
    THREAT: "kill hurt destroy shoot stab burn beat murder tuer frapper töten schlagen matar golpear",
    TARGET: "you your yours he him she her they them these those vous tu toi ils elles du dich ihr euch sie usted tú te ellos ustedes",
    NEGATION: "not never no isn aren don without pas jamais nicht kein keine niemals nunca jamás",
    REPORT: "said says called wrote writes quoted reported claims dit disait écrit sagte schrieb nannte dijo llamó escribió",
}
SEEDS = "idiot moron"


PRIOR_BASE = -2.5


def _stem_hashes(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For each stem size, each word's stem hash (0 where the word is no longer than the stem)."""
    out = []
    for size in STEM_SIZES:
        h = k.range_hash(running, starts, np.minimum(starts + size, ends) if size else ends)
        h = k.mix(h ^ np.uint64(size + 1))
        if size:
            h[ends - starts <= size] = 0
        out.append(h)
    return out


def stem_hash(word: str, size: int = 0) -> int:
    """Hash of a word, or of its first ``size`` bytes."""
    data = np.frombuffer(word.lower().encode(), np.uint8)
    data = data[:size] if size else data
    h = k.range_hash(k.prefix_hash(data), np.array([0]), np.array([data.size]))
    return int(k.mix(h ^ np.uint64(size + 1))[0])


def chance(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n: int) -> np.ndarray:
    """How probable it is that so many or more of a stem's rows are toxic if it has nothing to do with the label (hypergeometric tail)."""
    fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    choose = lambda m, k: fact[m] - fact[k] - fact[m - k]
    out = np.ones(toxic.size)
    for i, (a, b) in enumerate(zip(toxic.tolist(), clean.tolist(), strict=True)):
        x = np.arange(max(a, a + b - (n - n_toxic)), min(a + b, n_toxic) + 1)
        out[i] = np.exp(choose(n_toxic, x) + choose(n - n_toxic, a + b - x) - choose(n, a + b)).sum()
    return np.minimum(out, 1.0)


def learn_stems(rows: DataFrame, label_col: str = "y", text_col: str = "text", least: int = 3, false_share: float = FALSE_SHARE, least_odds: float = 3.5) -> np.ndarray:
    """Hashes of the stems that tell toxic rows apart: in ``least`` toxic rows, with log-odds over ``least_odds``, and significant.

    All stems of the rows are tested by their counts, and as many are taken as keep the share of chance finds under ``false_share``
    (Benjamini and Hochberg). No share of the toxic rows is asked for, so stems of a language with few toxic rows count too.
    """

    def count(batch):
        y = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b, data, off in k.string_slices(batch.column(0)):
            starts, ends, first = k.words(data, off, k.ALNUM)
            running = k.prefix_hash(k.LOWER[data])
            row = np.repeat(np.arange(b - a), np.diff(first)).astype(np.uint64)
            stems = _stem_hashes(running, starts, ends)
            h, row = np.concatenate(stems), np.concatenate([row] * len(stems))
            h, row = h[h != 0], row[h != 0]
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            new = np.ones(h.size, bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, toxic = h[new], y[a:b][row[new].astype(np.int64)] > 0
            kinds, at = np.unique(h, return_inverse=True)
            n_toxic = np.bincount(at, toxic, kinds.size).astype(np.int64)
            yield {"stem": kinds.view(np.int64), "toxic": n_toxic, "clean": np.bincount(at, minlength=kinds.size) - n_toxic}

    sizes = rows.agg(F.sum("y"), F.count("*")).first()
    n_toxic, n = int(sizes[0] or 0), int(sizes[1])
    if not n_toxic or n_toxic == n:
        return np.empty(0, np.uint64)
    counts = by_batch(rows.select(text_col, label_col), "stem long, toxic long, clean long", count).groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = written(counts, "toxicity-stems")
    pairs = counts.groupBy("toxic", "clean").count().collect()  # a row for each pair of counts, not for each stem
    toxic, clean, stems = (np.array([r[c] for r in pairs], np.int64) for c in ("toxic", "clean", "count"))
    p = chance(toxic, clean, n_toxic, n)
    order = np.argsort(p, kind="stable")
    upto = np.cumsum(stems[order])
    fits = np.flatnonzero(p[order] <= false_share * upto / stems.sum()) if upto.size else order
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n - n_toxic + 1))
    good = np.zeros(toxic.size, bool)
    good[order[: fits[-1] + 1 if fits.size else 0]] = True
    good &= (toxic >= least) & (odds >= least_odds)
    if not good.any():
        return np.empty(0, np.uint64)
    chosen = rows.sparkSession.createDataFrame(list(zip(toxic[good].tolist(), clean[good].tolist(), strict=True)), "toxic long, clean long")
    found = counts.join(F.broadcast(chosen), ["toxic", "clean"]).select("stem").collect()
    return np.sort(np.array([r.stem for r in found], np.int64).view(np.uint64))


def _member(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not table.size:
        return np.zeros(h.size, bool)
    at = np.searchsorted(table, h)
    return table[np.minimum(at, table.size - 1)] == h


_CLAUSE_END = np.zeros(256, bool)
_CLAUSE_END[list(b".!?;:\n")] = True


def events(docs: DataFrame, stems: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: its id and, by event kind, how many clauses hold one."""
    insults = np.unique(np.concatenate([stems, np.array([stem_hash(w) for w in SEEDS.split()], np.uint64)]))
    closed = {c: np.sort(np.array([stem_hash(w) for w in text.split()], np.uint64)) for c, text in CLOSED.items()}

    def run(batch):
        for a, b, data, off in k.string_slices(batch.column(1)):
            starts, ends, first = k.words(data, off, k.ALNUM)
            counts = np.zeros((b - a, len(EVENTS) + 1), np.int64)
            if starts.size:
                stem = _stem_hashes(k.prefix_hash(k.LOWER[data]), starts, ends)
                kind = np.zeros(starts.size, np.int8)
                for c, table in closed.items():
                    kind[_member(stem[0], table)] = c
                for h in stem:
                    kind[_member(h, insults) & (h != 0)] = INSULT
                running = np.concatenate([[0], np.cumsum(_CLAUSE_END[data])])
                cut = np.zeros(starts.size, bool)
                cut[1:] = running[starts[1:]] > running[ends[:-1]]
                cut[first[:-1][np.diff(first) > 0]] = True
                rows = np.searchsorted(first, np.flatnonzero(cut), side="right") - 1
                np.add.at(counts, (rows, clause_events(kind, np.cumsum(cut) - 1)), 1)
            yield {id_col: batch.column(0).slice(a, b - a)} | {e: counts[:, CODE[e]] for e in EVENTS}

    source = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return by_batch(source, f"`{id_col}` {source.schema[0].dataType.simpleString()}, " + ", ".join(f"`{e}` long" for e in EVENTS), run)


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> tuple[float, np.ndarray]:
    """Logistic weights by Newton's method, drawn towards the prior."""
    prior = np.array([PRIOR_BASE, *EVENTS.values()])
    if not y.size:
        return PRIOR_BASE, prior[1:]
    design = np.column_stack([np.ones(y.size), x])
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        g = design.T @ (p - y) + ridge * (w - prior)
        h = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(w.size)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), np.maximum(w[1:], 0.0)


@dataclass
class Model:
    """Learned stems and event weights."""

    stems: np.ndarray
    base: float
    weights: np.ndarray


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``sample_rows`` labelled rows, those with the smallest hash of the id, whole texts. Null labels are left out; of repeated labels the largest counts."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id")
    stems = learn_stems(rows.select("text", "y"))
    counts = events(rows, stems, "id").join(F.broadcast(known), "id").groupBy(*EVENTS, "y").count().collect()
    x = np.array([[np.log2(1 + r[e]) for e in EVENTS] for r in counts for _ in range(r["count"])], float).reshape(-1, len(EVENTS))
    base, weights = fit_weights(x, np.array([r.y for r in counts for _ in range(r["count"])], float))
    return Model(stems, base, weights)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How toxic each text is.

    Returns a row for each row of ``docs``: its id, score (0 to 1) and by event kind the clauses that hold one. Null and empty texts have no
    clauses and get the base score; repeated rows get equal scores; very long texts are read whole; an empty table gives an empty one; other columns are
    ignored, whatever their names.
    """
    raw = F.lit(model.base)
    for e, w in zip(EVENTS, model.weights.tolist(), strict=True):
        raw = raw + F.log2(1 + F.col(e)) * w
    return events(docs, model.stems, id_col, text_col).select(id_col, (1 / (1 + F.exp(-raw))).alias("score"), *EVENTS)
