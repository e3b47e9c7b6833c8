"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become normalised word strings. Each run of ``window`` words of a test item
is a pattern. Patterns of like length form a class with a block shift table (how far the
search may jump when a block of bytes is seen) and buckets of patterns by the hash
of the last block; direct comparison confirms each occurrence. The search runs over
many places of a text at once, each jumping by its own shift.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .repeats import text_names
from .shared import by_batch, written

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER_TO_LOWER = bytes(k.LOWER)
#: Text of test items held by one search table; more items are searched block by block.
BLOCK_BYTES = 4 << 20
#: Bytes of text that one search pointer runs over.
LANE = 512


class PatternClass:
    """Shift table and buckets for patterns of at least ``m`` bytes."""

    def __init__(self, patterns: list[bytes]):
        self.m = min(map(len, patterns))
        self.block = min(6, self.m)
        self.bits = 18
        self.mask = (1 << self.bits) - 1
        heads = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(len(patterns), self.m)
        self.shift = np.full(1 << self.bits, self.m - self.block + 1, np.int64)
        for j in range(self.m - self.block + 1):  # later blocks allow smaller shifts, so they come last
            self.shift[self.hash([heads[:, j + x] for x in range(self.block)])] = self.m - self.block - j
        last = self.hash([heads[:, self.m - self.block + x] for x in range(self.block)])
        self.buckets: dict[int, list[bytes]] = defaultdict(list)
        for h, p in zip(last.tolist(), patterns, strict=True):
            self.buckets[h].append(p)

    def hash(self, block: list[np.ndarray]) -> np.ndarray:
        h = block[0].astype(np.int64)
        for x in block[1:]:
            h = h * 0x2F0B4C47 + x
            h ^= h >> 15
        return (h ^ (h >> 23)) & self.mask

    def occurrences(self, text: np.ndarray) -> list[tuple[int, bytes]]:
        """(place, pattern) of every occurrence."""
        last = text.size - self.m
        if last < 0:
            return []
        at = np.arange(0, last + 1, LANE)
        ends = np.minimum(at + LANE, last + 1)
        tail = self.m - self.block
        places, hashes = [], []
        while at.size:
            h = self.hash([text[at + (tail + x)] for x in range(self.block)])
            jump = self.shift[h]
            zero = jump == 0
            if zero.any():
                places.append(at[zero])
                hashes.append(h[zero])
                jump[zero] = 1
            at = at + jump
            going = at < ends
            if not going.all():
                at, ends = at[going], ends[going]
        if not places:
            return []
        raw, out = text.tobytes(), []
        for place, h in zip(np.concatenate(places).tolist(), np.concatenate(hashes).tolist(), strict=True):
            for p in self.buckets.get(h, ()):
                if raw.startswith(p, place):
                    out.append((place, p))
        return out


class Search:
    """Finds the windows of a block of test items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.items_of: dict[bytes, set[str | None]] = defaultdict(set)
        self.words_of: dict[bytes, int] = {}
        for item, text in items:
            found = WORD.findall(text.encode().translate(_UPPER_TO_LOWER))
            for i in range(max(1, len(found) - window + 1) if found else 0):
                part = found[i : i + window]
                pattern = b" " + b" ".join(part) + b" "
                self.items_of[pattern].add(item)
                self.words_of[pattern] = len(part)
        classes = defaultdict(list)
        for p in self.items_of:
            classes[min(len(p).bit_length(), 6)].append(p)
        self.classes = [PatternClass(x) for _, x in sorted(classes.items())]


def normalised(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case words with a space before and after each, rows parted by a line feed; each word's place; each row's first word."""
    starts, ends, first = k.words(data, off, k.ALNUM)
    lengths = ends - starts
    row = np.repeat(np.arange(off.size - 1), np.diff(first))
    place = np.cumsum(lengths + 1) - (lengths + 1) + 2 * (row + 1)
    text = np.full(int(lengths.sum()) + starts.size + 2 * off.size, 0x20, np.uint8)
    if starts.size:
        source = np.flatnonzero(k.ALNUM[data])
        text[source + np.repeat(place - starts, lengths)] = k.LOWER[data[source]]
    begins = np.append(place, text.size)[first[:-1]] - 2 if starts.size else np.empty(0, np.int64)
    text[begins[np.diff(first) > 0] if starts.size else begins] = 0x0A
    return text, place, first


#: The table that this worker made last, by the name of its block; a block's job makes it once a worker.
_made: dict[str, Search] = {}


def _table(name: str, block, window: int, builds) -> Search:
    if name not in _made:
        _made.clear()
        _made[name] = Search(block.value, window)
        if builds is not None:
            builds.add(1)
    return _made[name]


_HITS = "array<struct<start:long,end:long>>"
_HIT_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _spans(hit: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [{"start": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2], strict=True)]


def _searched(source: DataFrame, table, everything: bool) -> DataFrame:
    """id, t1, t2, n_words, hits and items for each row, or for those with a hit only."""
    kind = source.schema[0].dataType.simpleString()

    def run(batch):
        search = table()
        for a, b, data, off in k.string_slices(batch.column(3)):
            text, place, first = normalised(data, off)
            marks = np.zeros(place.size + 1, np.int64)
            items: dict[int, set[str | None]] = defaultdict(set)
            for group in search.classes:
                found = group.occurrences(text)
                if not found:
                    continue
                word = np.searchsorted(place, np.array([x[0] for x in found]) + 1)
                np.add.at(marks, word, 1)
                np.add.at(marks, word + np.array([search.words_of[p] for _, p in found]), -1)
                row = np.searchsorted(first, word, side="right") - 1
                for r, (_, p) in zip(row.tolist(), found, strict=True):
                    items[r] |= search.items_of[p]
            hit = np.cumsum(marks)[:-1] > 0
            some = k.row_sums(hit, first) > 0
            rows = np.arange(b - a) if everything else np.flatnonzero(some)
            spans = [_spans(hit[first[r] : first[r + 1]]) if some[r] else [] for r in rows.tolist()]
            chosen = pa.array(rows)
            yield {x: batch.column(i).slice(a, b - a).take(chosen) for i, x in enumerate(("id", "t1", "t2"))} | {"n_words": np.diff(first)[rows], "hits": pa.array(spans, _HIT_TYPE), "items": pa.array([list(items.get(r, ())) for r in rows.tolist()], pa.list_(pa.string()))}

    return by_batch(source, f"id {kind}, t1 long, t2 long, n_words long, hits {_HITS}, items array<string>", run)


def _united(found: DataFrame) -> DataFrame:
    """Hits and items of a text out of those by block: overlapping runs become one."""

    def run(batch):
        out = []
        for spans in batch.column(2).to_pylist():
            own: list[dict[str, int]] = []
            for x in sorted(spans, key=lambda x: x["start"]):
                if own and x["start"] <= own[-1]["end"]:
                    own[-1]["end"] = max(own[-1]["end"], x["end"])
                else:
                    own.append(dict(x))
            out.append(own)
        yield {"t1": batch.column(0), "t2": batch.column(1), "hits": pa.array(out, _HIT_TYPE), "items": batch.column(3)}

    # copies of a text say the same; collect_set would leave out the null that stands for items of null id
    grouped = found.groupBy("t1", "t2").agg(F.flatten(F.collect_set("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return by_batch(grouped.select("t1", "t2", "hits", "items"), f"t1 long, t2 long, hits {_HITS}, items array<string>", run)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES, builds=None) -> DataFrame:
    """Words of each text that lie in a passage of a test item.

    A word is a run of ASCII digits, ASCII letters (lower-cased) and characters beyond ASCII. An item of
    fewer than ``window`` words is one window. Returns a row for each row of ``docs``: its id,
    n_words, n_hit, hits (runs of hit words: start, end) and items (ids whose windows occur, as
    strings, sorted; all items of null id are one null, which comes last). Null and empty texts have no words and no hits; items without words
    match nothing; repeated rows and repeated ids stay as they are; equal texts of several items
    count for each item; very long texts are searched whole; an empty table gives an empty one; other columns are ignored, whatever their names.

    The items are dealt into blocks of about ``block_bytes`` of text; the driver holds and broadcasts one block at a time. The texts are read once for each
    block, and a worker makes a block's table once. ``builds``: an accumulator that counts the tables made.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("id"), *text_names(text), text.alias("text"))
    chosen = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0]
    blocks = max(1, -(-int(size or 0) // block_bytes))
    # by hash, so that a block is about as large as asked for; equal rows are one item's window twice
    dealt = chosen.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    # items are dealt by hash, so with few items many blocks are empty: these need no pass over the texts
    present = [0] if blocks == 1 else sorted(r.block for r in dealt.select("block").distinct().collect())  # a number for each block
    found = None
    for i in present:
        items = [(r.item, r.text) for r in dealt.where(F.col("block") == i).distinct().collect()]  # one block
        block, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def table(block=block, name=name):
            return _table(name, block, window, builds)

        if len(present) == 1:
            out = _searched(source, table, True)
            break
        part = written(_searched(source, table, False).drop("id", "n_words"), "decontamination-hits")
        found = part if found is None else found.unionByName(part)
        block.destroy()
    else:
        counted = by_batch(source.select("id", "t1", "t2", "text"), f"id {source.schema[0].dataType.simpleString()}, t1 long, t2 long, n_words long", _words)
        out = counted.join(_united(found), ["t1", "t2"], "left").select("id", "n_words", F.coalesce("hits", F.expr(f"cast(array() as {_HITS})")).alias("hits"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    ordered = F.concat(F.array_sort(F.array_compact("items")), F.filter("items", lambda x: x.isNull()))
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "hits", ordered.alias("items"))


def _words(batch):
    for a, b, data, off in k.string_slices(batch.column(3)):
        yield {x: batch.column(i).slice(a, b - a) for i, x in enumerate(("id", "t1", "t2"))} | {"n_words": np.diff(k.words(data, off, k.ALNUM)[2])}
