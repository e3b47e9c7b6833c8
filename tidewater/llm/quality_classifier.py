"""Quality classifier: histogram gradient-boosted trees over statistics of a text.

Trees grow level by level over histograms of binned features; the fitted forest is flat arrays (feature, threshold,
children, value), walked for many rows and all trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .quality_rules import SYMBOLS, text_statistics
from .shared import by_batch

#: Labelled rows that a model is fitted on at most.
SAMPLE_ROWS = 20_000


def _bytes(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_CLASSES = {"upper": _bytes(range(0x41, 0x5B)), "lower": _bytes(range(0x61, 0x7B)), "digit": _bytes(range(0x30, 0x3A)), "space": _bytes(b" \t\r"), "line": _bytes(b"\n"), "stop": _bytes(b".?"), "comma": _bytes(b",;:"), "shout": _bytes(b"!"), "pipe": _bytes(b"|"), "symbol": SYMBOLS, "bracket": _bytes(b"()[]{}\"'"), "beyond": _bytes(range(0x80, 0x100)), "control": _bytes([*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F])}


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of numbers for each text; an empty text has zeros."""
    rows = off.size - 1
    stats, of_lines = text_statistics(data, off)
    line_row, line_words = of_lines["row"], of_lines["to"] - of_lines["from"]
    starts, ends, first = k.words(data, off)
    n = np.maximum(stats["n_words"], 1)
    size = np.maximum(np.diff(off), 1)
    counts = {x: k.row_sums(table[data], off) for x, table in _CLASSES.items()}
    lengths = ends - starts
    out = [np.log1p(stats["n_words"]), np.log1p(np.diff(off))]
    out += [c / size for c in counts.values()]
    out += [k.row_sums(lengths, first) / n, k.row_sums(lengths <= 2, first) / n, k.row_sums(lengths >= 12, first) / n]
    mean = out[-3]
    out.append(np.sqrt(np.maximum(k.row_sums(lengths * lengths, first) / n - mean * mean, 0)))
    heads, tails = data[starts], data[ends - 1] if starts.size else data[:0]
    out += [k.row_sums(_CLASSES["upper"][heads], first) / n, k.row_sums((_CLASSES["stop"] | _CLASSES["shout"])[tails], first) / n, k.row_sums(SYMBOLS[tails], first) / n]
    row = np.repeat(np.arange(rows), stats["n_words"])
    hashes = k.range_hash(k.prefix_hash(k.LOWER[data]), starts, ends)
    same = np.zeros(starts.size, bool)
    if starts.size > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    out.append(k.row_sums(same, first) / n)
    _, at, times = np.unique(k.mix(hashes ^ k.mix(row.astype(np.uint64))), return_index=True, return_counts=True)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, row[at], times)
    out += [np.bincount(row[at], minlength=rows) / n, most / n]
    lines = np.bincount(line_row, minlength=rows)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, line_row, line_words)
    out += [np.log1p(lines), stats["n_words"] / np.maximum(lines, 1), longest / n, stats["n_dup_lines"] / np.maximum(lines, 1), stats["n_repeat_words"] / n]
    return np.stack(out, 1).astype(np.float32)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x: the statistics) for each row of ``docs``; a null text counts as empty, other columns are ignored."""

    def run(batch):
        for a, b, data, off in k.string_slices(batch.column(1)):
            x = statistics(data, off)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield {id_col: batch.column(0).slice(a, b - a), "x": lists}

    source = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return by_batch(source, f"`{id_col}` {source.schema[0].dataType.simpleString()}, x array<float>", run)


@dataclass
class Forest:
    """Flat trees; a leaf has feature -1."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray, block: int = 2048) -> np.ndarray:
        """Probability of label 1 for each row."""
        out = np.full(x.shape[0], self.base)
        for a in range(0, x.shape[0], block):
            part = x[a : a + block]
            node = np.broadcast_to(self.roots, (part.shape[0], self.roots.size)).copy()
            rows = np.arange(part.shape[0])[:, None]
            for _ in range(self.depth):
                f = self.feature[node]
                go_left = part[rows, np.maximum(f, 0)] <= self.threshold[node]
                node = np.where(f < 0, node, np.where(go_left, self.left[node], self.right[node]))
            out[a : a + block] += self.value[node].sum(1)
        return 1 / (1 + np.exp(-out))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Forest:
    """Boosted trees for the log-odds of y. Without rows, or with one label, every score is that label's smoothed share."""
    share = (y.sum() + 0.5) / (y.size + 1)
    base = float(np.log(share / (1 - share)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    if y.size < 2 * least or y.min() == y.max():
        trees = 0
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for c in x.T] if trees else []
    binned = [np.searchsorted(c, col) for c, col in zip(cuts, x.T, strict=True)] if trees else []
    raw = np.full(y.size, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        roots.append(len(feature))
        node = np.zeros(y.size, np.int64)  # place in the level's list, -1 in a finished leaf
        level = [len(feature)]
        leaf_of = np.zeros(y.size, np.int64)

        def add(gs: float, hs: float) -> int:
            for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, -rate * gs / (hs + ridge))):
                a.append(v)
            return len(feature) - 1

        level = [add(g.sum(), h.sum())]
        leaf_of[:] = level[0]
        for _ in range(depth):
            live = node >= 0
            best = [(1e-6, -1, 0, 0.0, 0.0)] * len(level)
            total_g = np.bincount(node[live], g[live], len(level))
            total_h = np.bincount(node[live], h[live], len(level))
            for f, col in enumerate(binned):
                width = cuts[f].size + 1
                if width < 2:
                    continue
                key = node[live] * width + col[live]
                sg, sh, sn = (np.bincount(key, w, len(level) * width).reshape(len(level), width).cumsum(1)[:, :-1] for w in (g[live], h[live], None))
                n_all = np.bincount(node[live], minlength=len(level))[:, None]
                gain = sg**2 / (sh + ridge) + (total_g[:, None] - sg) ** 2 / (total_h[:, None] - sh + ridge) - (total_g**2 / (total_h + ridge))[:, None]
                gain[(sn < least) | (n_all - sn < least)] = -1
                at = gain.argmax(1)
                for i, j in enumerate(at.tolist()):
                    if gain[i, j] > best[i][0]:
                        best[i] = (float(gain[i, j]), f, j, float(sg[i, j]), float(sh[i, j]))
            following, place = [], np.full(len(level), -1)
            for i, (_, f, j, gs, hs) in enumerate(best):
                if f >= 0:
                    own = level[i]
                    feature[own], threshold[own] = f, float(cuts[f][j])
                    left[own], right[own] = add(gs, hs), add(total_g[i] - gs, total_h[i] - hs)
                    place[i] = len(following)
                    following += [left[own], right[own]]
            if not following:
                break
            split = live & (place[np.maximum(node, 0)] >= 0)
            at = node[split]
            own = np.array(level)[at]
            f_of, t_of = np.array(feature)[own], np.array(threshold, np.float32)[own]
            to_right = x[split, f_of] > t_of
            node[live & ~split] = -1
            node[split] = place[at] + to_right
            leaf_of[split] = np.array(following)[node[split]]
            level = following
        raw += np.array(value)[leaf_of]
    if not trees:
        feature, threshold, left, right, value, roots = [-1], [0.0], [0], [0], [0.0], [0]
    return Forest(base, np.array(roots), np.array(feature), np.array(threshold, np.float32), np.array(left), np.array(right), np.array(value), depth)


def train(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Fit on at most ``sample_rows`` labelled rows, those with the smallest hash of the id. Null labels are left out; of repeated labels the largest counts."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    rows = features.join(known, id_col).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows).select("x", "y").collect()
    x = np.array([r.x for r in rows], np.float32) if rows else np.zeros((0, 1), np.float32)
    return fit_forest(x, np.array([r.y for r in rows], float))


def score(features: DataFrame, forest: Forest, id_col: str = "doc_id") -> DataFrame:
    """(id, score: 0 to 1) for each row of ``features``."""
    model = features.sparkSession.sparkContext.broadcast(forest)

    def run(batch):
        x = batch.column(1)
        values = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        yield {id_col: batch.column(0), "score": model.value.score(values)}

    source = features.select(id_col, "x")
    return by_batch(source, f"`{id_col}` {source.schema[0].dataType.simpleString()}, score double", run)
