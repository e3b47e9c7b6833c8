"""Suffix-array deduplication of bytes by external induced sorting.

Windows of ``width`` bytes meet by minimiser (see ``repeats``). Each task sorts the suffixes of its shard by external induced
sorting and takes neighbours that share ``width`` bytes as the same string.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import induced
from . import kernels as k
from .repeats import SHARD_BYTES, Bytes, marks, repeated_runs, text_names
from .shared import by_batch


class SuffixBytes(Bytes):
    separator = b"\xfe"  # in no UTF-8 text

    def judge(self, text, starts, sizes, disk):
        symbols = disk.array(text.size, np.uint8)
        window = disk.array(text.size, np.bool_)  # places where a window starts
        for a in range(0, text.size, k.CHUNK_BYTES):
            symbols[a : a + k.CHUNK_BYTES] = text[a : a + k.CHUNK_BYTES] + np.uint8(1)
        for a in range(0, sizes.size, 10_000):
            n = sizes[a : a + 10_000]
            window[np.repeat(starts[a : a + 10_000] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = True
        flags = disk.array(text.size, np.bool_)
        for group in induced.repeats(symbols, self.width, disk):
            held = 0
            for part in group:
                part = part[part < text.size]
                part = part[window[part]]
                if held + part.size > 1:
                    flags[part] = True
                    if held == 1:
                        flags[first] = True
                if not held and part.size:
                    first = part[0]
                held += part.size
        return flags, starts


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, gram: int = 64, shard_bytes: int = SHARD_BYTES, memory: int = 1 << 20) -> DataFrame:
    """Texts without the bytes of any ``width``-byte string that starts in two places of the corpus.

    Returns a row for each row of ``docs``: its id, n_bytes, n_removed, removed (runs: start, end), kept (the remaining bytes; they may
    cut a code point) and kept_sha256. Every place counts, the first one and places in the same text too; strings are judged on
    the input. Null and empty texts have no bytes; texts under ``width`` bytes lose none; a repeated row repeats all its strings, whatever its id; null
    ids stay null; very long texts are read whole; an empty table gives an empty one; other columns are ignored, whatever their names. A task sorts about
    ``shard_bytes`` of packed segments, with arrays and queues of over ``memory`` items on disk.
    """
    source = docs.select(F.col(id_col).alias("id"), *text_names(F.col(text_col).cast("string")), F.col(text_col).cast("string").alias("text"))
    runs = repeated_runs(source.select("t1", "t2", "text"), SuffixBytes(width, min(gram, width), memory), shard_bytes)
    joined = source.join(runs, ["t1", "t2"], "left").select("id", "text", "runs")

    def run(batch):
        found = batch.column(2)
        for a, b, data, off in k.string_slices(batch.column(1)):
            raw = data.tobytes()
            removed, kept, n_removed = [], [], []
            for r in range(b - a):
                x, y = int(off[r]), int(off[r + 1])
                spans = found[a + r].as_py()
                cut = marks(spans, width, y - x) if spans else np.zeros(0, bool)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]]))).tolist()
                removed.append([{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2], strict=True)])
                n_removed.append(int(cut.sum()))
                kept.append(raw[x:y] if not edges else b"".join(raw[x + s : x + e] for s, e in zip([0, *edges[1::2]], [*edges[::2], y - x], strict=True)))
            yield {"id": batch.column(0).slice(a, b - a), "n_bytes": np.diff(off), "n_removed": np.array(n_removed, np.int64), "removed": _spans(removed), "kept": kept, "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}

    kind = source.schema[0].dataType.simpleString()
    out = by_batch(joined, f"id {kind}, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary, kept_sha256 string", run)
    return out.withColumnRenamed("id", id_col)


def _spans(rows):
    import pyarrow as pa

    return pa.array(rows, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
