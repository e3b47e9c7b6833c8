"""Substring deduplication of words by super-k-mer partitioning.

Consecutive windows of ``width`` words that share a minimiser travel as one packed string to the minimiser's bucket
(see ``repeats``); there the windows are sorted, as offsets into one buffer, and equal neighbours counted, byte for byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .repeats import SHARD_BYTES, Words, marks, repeated_runs, text_names
from .shared import by_batch

class SortedWords(Words):
    def judge(self, text, starts, sizes, disk):
        first = np.cumsum(sizes) - sizes
        flags = disk.array(int(sizes.sum()), np.bool_)
        begin, end, key, number = disk.spool(np.int64), disk.spool(np.int64), disk.spool(np.uint64), disk.spool(np.int64)
        ends = np.append(starts[1:], text.size)
        i = 0
        while i < sizes.size:  # a stretch of segments at a time
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + k.CHUNK_BYTES, side="right")))
            off = np.append(starts[i:j], ends[j - 1]) - starts[i]
            values, _, head, a, b = self.read(np.asarray(text[starts[i] : ends[j - 1]]), off)
            n = sizes[i:j]
            at = np.repeat(head[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            begin.add(a[at] + starts[i])
            end.add(b[at + self.width - 1] + starts[i])
            key.add(k.window_hash(values, self.width)[at])
            number.add(np.repeat(first[i:j] - (np.cumsum(n) - n), n) + np.arange(n.sum()))
            i = j
        begin, end, key, number = (x.array() for x in (begin, end, key, number))
        rounds = max(1, -(-key.size // disk.budget))
        for part in range(rounds):  # as many windows at a time as memory holds; equal ones have equal keys
            chosen = np.concatenate([np.flatnonzero(key[x : x + disk.budget] % np.uint64(rounds) == part) + x for x in range(0, key.size, disk.budget)] or [np.empty(0, np.int64)])
            chosen = chosen[np.argsort(key[chosen], kind="stable")]
            same = np.flatnonzero(key[chosen][1:] == key[chosen][:-1])
            if not same.size:
                continue
            a, b = begin[chosen], end[chosen]
            equal = np.array([b[x] - a[x] == b[x + 1] - a[x + 1] and bytes(text[a[x] : b[x]]) == bytes(text[a[x + 1] : b[x + 1]]) for x in same.tolist()])
            flags[number[chosen[same[equal]]]] = True
            flags[number[chosen[same[equal] + 1]]] = True
            for x in np.unique(key[chosen[same[~equal]]]):  # unequal windows with one key: by their bytes alone
                places: dict[bytes, list[int]] = {}
                for w in chosen[key[chosen] == x].tolist():
                    places.setdefault(bytes(text[begin[w] : end[w]]), []).append(int(number[w]))
                for found in places.values():
                    if len(found) > 1:
                        flags[found] = True
        return flags, first


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, gram: int = 12, shard_bytes: int = SHARD_BYTES, memory: int = 1 << 20) -> DataFrame:
    """Texts without the words of any ``width``-word sequence that starts in two places of the corpus.

    A word is a run of bytes without ASCII white space, taken unchanged. Returns a row for each row of ``docs``: its id, n_words, n_removed,
    kept (the remaining words joined by one space) and kept_sha256. Every place counts, the first one and places in the
    same text too; windows are judged on the input. Null and empty texts have no words; texts under ``width`` words lose none; a repeated row
    repeats all its windows, whatever its id; null ids stay null; very long texts are read whole; an empty table gives an empty one; other columns are
    ignored, whatever their names. A task judges about ``shard_bytes`` of packed windows and sorts ``memory`` windows at a time; beyond, its arrays lie in files.
    """
    source = docs.select(F.col(id_col).alias("id"), *text_names(F.col(text_col).cast("string")), F.col(text_col).cast("string").alias("text"))
    runs = repeated_runs(source.select("t1", "t2", "text"), SortedWords(width, min(gram, width), memory), shard_bytes)
    joined = source.join(runs, ["t1", "t2"], "left").select("id", "text", "runs")

    def run(batch):
        found = batch.column(2)
        for a, b, data, off in k.string_slices(batch.column(1)):
            raw = data.tobytes()
            n_words, n_removed, kept = [], [], []
            for r in range(b - a):
                own = raw[off[r] : off[r + 1]].split()  # bytes split at ASCII white space
                spans = found[a + r].as_py()
                n_words.append(len(own))
                if spans:
                    cut = marks(spans, width, len(own))
                    n_removed.append(int(cut.sum()))
                    own = [w for w, c in zip(own, cut.tolist(), strict=True) if not c]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(own).decode())
            yield {"id": batch.column(0).slice(a, b - a), "n_words": n_words, "n_removed": n_removed, "kept": kept, "kept_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in kept]}

    kind = source.schema[0].dataType.simpleString()
    return by_batch(joined, f"id {kind}, n_words long, n_removed long, kept string, kept_sha256 string", run).withColumnRenamed("id", id_col)
