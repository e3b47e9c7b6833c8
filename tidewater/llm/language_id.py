"""Language ID: each text as a mixture of languages.

A language is a distribution of hashed byte trigrams of letters. For each text, expectation-maximisation estimates the
share of each language from the trigram likelihoods. The set of languages grows one by one: of all others the one whose addition raises the likelihood
most enters while that gain is over the penalty of another parameter. Languages lie in blocks of bounded size; a task holds one block at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .shared import by_batch

BUCKETS = 1 << 15
_PART = 1 << 11
#: Languages in a block of the model, and languages whose counts a task holds at once.
BLOCK_LANGS = 128

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_ASCII_LETTER = _LETTER.copy()
_ASCII_LETTER[0x80:] = False


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams around each letter, and where each row's begin. Anything but a letter counts as a space; Latin-1 capitals are lowered."""
    low = np.where(_LETTER[data], k.LOWER[data], 0x20).astype(np.uint8)
    if low.size > 1:
        capital = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][capital] += 0x20
    n = data.size
    padded = np.full(n + 2, 0x20, np.uint8)
    padded[1:-1] = low
    a, b, c = padded[:-2].copy(), low, padded[2:].copy()
    inner = off[(off > 0) & (off < n)]
    a[inner] = 0x20
    c[inner - 1] = 0x20
    keep = b != 0x20
    h = a.astype(np.uint32) * np.uint32(0x9E3779B1) + b.astype(np.uint32) * np.uint32(0x85EBCA6B) + c.astype(np.uint32) * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    grams = (h >> np.uint32(17)).astype(np.int64)
    running = np.concatenate([[0], np.cumsum(keep)])
    return grams[keep], running[off]


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Trigram counts of each language over all rows; null languages are left out."""

    def count(batches):
        total: dict[str, np.ndarray] = {}

        def out():
            for lang, n in total.items():
                yield pa.RecordBatch.from_pydict({"lang": [lang] * (BUCKETS // _PART), "part": list(range(BUCKETS // _PART)), "n": list(n.reshape(-1, _PART))}, schema=pa.schema([("lang", pa.string()), ("part", pa.int32()), ("n", pa.list_(pa.int64()))]))
            total.clear()

        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for a, b, data, off in k.string_slices(batch.column(0)):
                grams, first = trigrams(data, off)
                own = langs[a:b]
                for lang in set(own.tolist()):
                    picked = np.repeat(own == lang, np.diff(first))
                    n = np.bincount(grams[picked], minlength=BUCKETS)
                    total[lang] = total[lang] + n if lang in total else n
            if len(total) >= BLOCK_LANGS:
                yield from out()
        yield from out()

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [frame.lang.iloc[0]], "part": [frame.part.iloc[0]], "n": [np.sum(np.stack(list(frame.n)), 0)]})

    source = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    parts = source.mapInArrow(count, "lang string, part int, n array<long>").groupBy("lang", "part").applyInPandas(summed, "lang string, part int, n array<long>")
    out: dict[str, np.ndarray] = {}
    for row in parts.toLocalIterator():  # of a fixed size for each language
        out.setdefault(row.lang, np.zeros(BUCKETS, np.int64))[row.part * _PART : (row.part + 1) * _PART] = row.n
    return dict(sorted(out.items()))


class Likelihoods:
    """Trigram probabilities of a block of languages."""

    def __init__(self, counts: dict[str, np.ndarray], smooth: float = 0.5):
        self.langs = list(counts)
        p = np.stack([(n + smooth) / (n.sum() + smooth * BUCKETS) for n in counts.values()], 1)
        self.p = p.astype(np.float32)


def blocks_of(counts: dict[str, np.ndarray], langs: int = BLOCK_LANGS) -> list[Likelihoods]:
    names = list(counts)
    return [Likelihoods({x: counts[x] for x in names[a : a + langs]}) for a in range(0, len(names), langs)]


def _added(p: np.ndarray, mixed: np.ndarray, weight: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """For each language (column of ``p``), the share with which it joins a mixture best, and how much the log-likelihood gains."""
    ratio = p / mixed[:, None]
    share, total = np.full(p.shape[1], 0.5), weight.sum()
    for _ in range(rounds):
        part = share * ratio
        share = weight @ (part / (part + (1 - share))) / total
    return share, weight @ np.log1p(share * (ratio - 1))


def shares(grams: np.ndarray, blocks: list, rounds: int = 12, penalty: float = 2.0) -> dict[str, float]:
    """Share of each chosen language in a text's trigrams. ``blocks`` are functions that give a block of likelihoods."""
    n = np.bincount(grams, minlength=BUCKETS)
    kinds = np.flatnonzero(n)
    weight = n[kinds].astype(float)
    cost = penalty * np.log(max(grams.size, 2))
    chosen: list[str] = []
    columns = np.empty((kinds.size, 0))
    pi = np.empty(0)
    while True:
        best = (-np.inf, "", np.empty(0))
        for block in blocks:
            own = block()
            p = own.p[kinds].astype(float)
            gain = _added(p, columns @ pi, weight, rounds)[1] if chosen else weight @ np.log(p)
            gain[[i for i, x in enumerate(own.langs) if x in chosen]] = -np.inf
            at = int(gain.argmax())  # ties go to the first language
            if gain[at] > best[0]:
                best = (float(gain[at]), own.langs[at], p[:, at])
        if chosen and best[0] <= cost:
            return dict(zip(chosen, pi.tolist(), strict=True))
        chosen.append(best[1])
        columns = np.column_stack([columns, best[2]])
        pi = np.full(len(chosen), 1 / len(chosen))
        for _ in range(rounds if len(chosen) > 1 else 0):
            pi = pi * ((weight / (columns @ pi)) @ columns) / weight.sum()


def identify(docs: DataFrame, counts: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", block_langs: int = BLOCK_LANGS) -> DataFrame:
    """The languages of each text.

    Returns a row for each row of ``docs``: its id, lang_pred (the language with the largest share; ties go to the one that
    fits the whole text best), score (that share, 0 to 1) and shares (map of the chosen languages). A null text or one without a letter is ``und`` with score 0, as is
    every text if no language is known. Repeated rows get equal results; very long texts are read whole; an empty table gives an empty one; other columns
    are ignored, whatever their names. The model is broadcast in blocks of ``block_langs`` languages (128 KiB each); with several a task loads them in turn.
    """
    sent = [docs.sparkSession.sparkContext.broadcast(x) for x in blocks_of(counts, block_langs)]

    def block(of):
        def read():
            for x in sent:
                if x is not of and hasattr(x, "_value"):
                    del x._value  # what a broadcast has read stays on disk
            return of.value

        return read

    def run(batch):
        blocks = [block(x) for x in sent]
        for a, b, data, off in k.string_slices(batch.column(1)):
            grams, first = trigrams(data, off)
            plain = k.row_sums(_ASCII_LETTER[data], off)
            langs, scores, all_shares = [], [], []
            for i in range(b - a):
                lettered = plain[i] > 0 or (off[i + 1] > off[i] and any(map(str.isalpha, data[off[i] : off[i + 1]].tobytes().decode())))
                if not lettered or not blocks:
                    langs.append("und")
                    scores.append(0.0)
                    all_shares.append([])
                    continue
                found = shares(grams[first[i] : first[i + 1]], blocks)
                top = max(found, key=found.get)
                langs.append(top)
                scores.append(min(1.0, max(0.0, found[top])))
                all_shares.append(list(found.items()))
            yield {id_col: batch.column(0).slice(a, b - a), "lang_pred": langs, "score": scores, "shares": pa.array(all_shares, pa.map_(pa.string(), pa.float64()))}

    source = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return by_batch(source, f"`{id_col}` {source.schema[0].dataType.simpleString()}, lang_pred string, score double, shares map<string,double>", run)
