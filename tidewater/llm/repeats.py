"""Repeated windows of a corpus: what suffix-array and super-k-mer deduplication share.

A window is ``width`` consecutive units (bytes, words) of one text. Its minimiser is the least hash of its ``gram``-unit
parts; consecutive windows with the same minimiser form a segment. A window that occurs twice has the same minimiser
both times, so only segments whose minimiser occurs twice (in two segments, or twice in one) can hold one, and all places of a window meet in its
minimiser's bucket. Equal segments (by two hashes of 64 and 62 bits) collapse into one with a weight before any text travels. A
minimiser that stands once in a single distinct segment leaves nothing to compare: the weight says whether its windows occur
again. Every other distinct segment travels once, as one packed string, to its bucket, where a judge finds the windows that occur
twice. A bucket much larger than a shard is cut again, by a second minimiser under another hash, and so on; what is still large after
``LEVELS`` of them is judged as it is, on disk. Verdicts go back to the texts by segment.

Texts are named by two 64-bit hashes, so equal rows share their work and repeated or null ids do no harm.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .shared import by_batch, written

#: Windows that a segment holds at most; longer runs of one minimiser are cut.
MOST_WINDOWS = 256
#: Bytes of packed segments that one task judges, about.
SHARD_BYTES = 4 << 20
#: A bucket of so many shards is cut again.
HOT_SHARDS = 4
LEVELS = 3
#: Texts that a task remembers, so as not to send the segments of copies again; beyond, they travel twice.
_SEEN = 1 << 16


class Disk:
    """Arrays in memory up to ``budget`` items, beyond that in files of one folder."""

    def __init__(self, folder: str, budget: int):
        self.folder, self.budget, self.files = folder, budget, 0

    def path(self) -> str:
        self.files += 1
        return os.path.join(self.folder, f"{id(self)}-{self.files}")

    def array(self, size: int, kind) -> np.ndarray:
        """Zeros."""
        return np.zeros(size, kind) if size <= self.budget else np.memmap(self.path(), kind, "w+", shape=(size,))

    def spool(self, kind) -> Spool:
        return Spool(self, kind)


class Spool:
    """An array that grows at its end."""

    def __init__(self, disk: Disk, kind):
        self.disk, self.kind = disk, np.dtype(kind)
        self.parts: list[np.ndarray] = []
        self.held = self.size = 0
        self.file = None

    def add(self, values: np.ndarray) -> None:
        self.parts.append(np.asarray(values, self.kind))
        self.held += self.parts[-1].size
        self.size += self.parts[-1].size
        if self.held > self.disk.budget:
            self.file = self.file or open(self.disk.path(), "w+b")  # noqa: SIM115
            self._flush()

    def _flush(self) -> None:
        for x in self.parts:
            x.tofile(self.file)
        self.parts, self.held = [], 0

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.parts) if self.parts else np.empty(0, self.kind)
        self._flush()
        self.file.close()
        return np.memmap(self.file.name, self.kind, "r")


@dataclass(frozen=True)
class Units:
    """What windows consist of; ``memory``: items of an array that a judge holds in memory at most, about."""

    width: int
    gram: int
    memory: int = 1 << 20
    separator = b""

    def read(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, k.Running, np.ndarray, np.ndarray, np.ndarray]:
        """The units' values, their running hash, each row's first unit, and the units' starts and ends in ``data``."""
        raise NotImplementedError

    def pack(self, raw: bytes) -> bytes:
        """Bytes of a run of units, alike for equal units."""
        return raw

    def judge(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, disk: Disk) -> tuple[np.ndarray, np.ndarray]:
        """Of packed segments at ``starts`` of ``text``, each followed by the separator, with ``sizes`` windows: whether each window occurs again, and where each segment's windows begin in that array."""
        raise NotImplementedError


class Bytes(Units):
    def read(self, data, off):
        at = np.arange(data.size)
        return k.SPREAD[data], k.prefix_hash(data), off, at, at + 1


class Words(Units):
    separator = b" "

    def read(self, data, off):
        starts, ends, first = k.words(data, off)
        values = k.range_hash(k.prefix_hash(data), starts, ends)
        return values, k.value_prefix_hash(values), first, starts, ends

    def pack(self, raw):
        return b" ".join(raw.split())


def segments(values: np.ndarray, running: k.Running, first: np.ndarray, width: int, gram: int, level: int = 0, most: int = MOST_WINDOWS) -> tuple[np.ndarray, ...]:
    """(row, start among the row's units, windows, minimiser, hash of the whole, whether the minimiser stands in it twice) of each segment."""
    n = values.size
    if n < width:
        none = np.empty(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.view(bool)
    span = width - gram + 1
    hashes = k.rolling(values, gram, level)
    low = k.sliding(np.minimum, hashes, span)
    begin, end = first[:-1], first[1:] - width + 1
    rows = np.flatnonzero(end > begin)
    begin, end = begin[rows], end[rows]
    new = np.zeros(n + 1, bool)
    new[1 : low.size] = low[1:] != low[:-1]
    new[begin] = True
    new[end] = True
    cuts = np.flatnonzero(new)
    row = np.searchsorted(begin, cuts, side="right") - 1
    ok = (row >= 0) & (cuts < end[np.maximum(row, 0)])
    upto = np.append(cuts[1:], n)[ok]
    start, row = cuts[ok], row[ok]
    size = upto - start
    pieces = -(-size // most)
    if (pieces > 1).any():
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, upto, row = np.repeat(start, pieces) + nth * most, np.repeat(upto, pieces), np.repeat(row, pieces)
        size = np.minimum(most, upto - start)
    anchor = low[start]
    # places that are a minimiser of some window: there the largest minimum around equals the hash
    padded = np.concatenate([np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)])
    minima = np.flatnonzero(k.sliding(np.maximum, padded, span) == hashes)
    a, b = np.searchsorted(minima, start), np.searchsorted(minima, start + size + span - 1)
    owner = np.repeat(np.arange(start.size), b - a)
    inside = minima[np.arange(owner.size) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]
    times = np.bincount(owner[hashes[inside] == anchor[owner]], minlength=start.size)
    return rows[row], start - begin[row], size, anchor, k.range_hash(running, start, start + size + width - 1), times > 1


def text_names(text: Column) -> list[Column]:
    """Two hashes that name a text; a null text has the name of an empty one."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _cut(source: DataFrame, units: Units) -> DataFrame:
    def run(batch):
        t1, t2 = (batch.column(i).to_numpy() for i in (0, 1))
        for a, b, data, off in k.string_slices(batch.column(2)):
            values, running, first, starts, ends = units.read(data, off)
            row, start, size, low, whole, twice = segments(values, running, first, units.width, units.gram)
            if row.size:
                filled = np.concatenate([[0], np.cumsum(ends - starts + len(units.separator))])
                at = first[row] + start
                load = filled[at + size + units.width - 1] - filled[at]  # bytes of the packed segment
                yield {"t1": t1[a:b][row], "t2": t2[a:b][row], "start": start, "size": size.astype(np.int32), "load": load.astype(np.int32), "anchor": low.view(np.int64), "whole": whole.view(np.int64), "times": 1 + twice.astype(np.int32)}

    return by_batch(source, "t1 long, t2 long, start long, size int, load int, anchor long, whole long, times int", run)


def _bodies(source: DataFrame, groups: DataFrame, units: Units) -> DataFrame:
    """The packed segments of ``groups``, read from the texts that they name."""
    wanted = groups.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "size", "anchor", "whole", "weight")).alias("wanted"))  # a text's own segments
    joined = source.join(wanted, ["t1", "t2"]).select("t1", "t2", "text", "wanted")
    names = ("anchor", "whole", "weight", "size", "body")

    def run(batches):
        seen: set[tuple[int, int]] = set()  # copies of a text say the same
        for batch in batches:
            t1, t2 = (batch.column(i).to_pylist() for i in (0, 1))
            lists = batch.column(3)
            for a, b, data, off in k.string_slices(batch.column(2)):
                fresh = [r for r in range(a, b) if (t1[r], t2[r]) not in seen]
                if not fresh:
                    continue
                _, _, first, starts, ends = units.read(data, off)
                raw, out = data.tobytes(), {x: [] for x in names}
                for r in fresh:
                    if (t1[r], t2[r]) in seen:
                        continue
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add((t1[r], t2[r]))
                    for w in lists[r].as_py():
                        x = int(first[r - a]) + w["start"]
                        body = units.pack(raw[starts[x] : ends[x + w["size"] + units.width - 2]])
                        for name, v in zip(names, (w["anchor"], w["whole"], w["weight"], w["size"], body), strict=True):
                            out[name].append(v)
                if out["anchor"]:
                    kinds = {"size": pa.int32(), "body": pa.binary()}
                    yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(x, kinds.get(x, pa.int64())) for x in names]))

    return joined.mapInArrow(run, _BODY)


_BODY = "anchor long, whole long, weight long, size int, body binary"
_PART = "parent long, parent_whole long, offset int, weight long, anchor long, whole long, times int, size int, load int, body binary"


def _recut(bodies: DataFrame, units: Units, level: int) -> DataFrame:
    """Segments cut again by another minimiser; the new bucket is the old one's part."""

    def run(batch):
        for i in range(batch.num_rows):
            anchor, whole, weight, _, body = (batch.column(c)[i].as_py() for c in range(5))
            data = np.frombuffer(body, np.uint8)
            values, running, first, starts, ends = units.read(data, np.array([0, data.size]))
            _, start, size, low, own, twice = segments(values, running, first, units.width, units.gram, level)
            n = start.size
            parts = [units.pack(body[starts[x] : ends[x + y + units.width - 2]]) for x, y in zip(start.tolist(), size.tolist(), strict=True)]
            yield {
                "parent": np.full(n, anchor), "parent_whole": np.full(n, whole), "offset": start.astype(np.int32), "weight": np.full(n, weight),
                "anchor": k.mix(low ^ np.int64(anchor).view(np.uint64)).view(np.int64), "whole": own.view(np.int64), "times": 1 + twice.astype(np.int32),
                "size": size.astype(np.int32), "load": pa.array([len(x) + len(units.separator) for x in parts], pa.int32()), "body": pa.array(parts, pa.binary()),
            }

    return by_batch(bodies.select("anchor", "whole", "weight", "size", "body"), _PART, run)


def _runs(flags: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Runs of flagged windows of each segment (flags of all in a row): which segments have some, and their runs."""
    ends = np.cumsum(sizes)
    cut = np.zeros(flags.size + 1, bool)
    cut[0] = True
    cut[ends] = True
    begin = np.flatnonzero(flags & (cut[:-1] | ~np.concatenate([[False], flags[:-1]])))
    end = np.flatnonzero(flags & (cut[1:] | ~np.concatenate([flags[1:], [False]])))
    owner = np.searchsorted(ends, begin, side="right")
    counts = np.bincount(owner, minlength=sizes.size)
    base = (ends - sizes)[owner]
    some = np.flatnonzero(counts)
    runs = pa.StructArray.from_arrays([pa.array((begin - base).astype(np.int32)), pa.array((end + 1 - base).astype(np.int32))], ["a", "b"])
    return some, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts[some])]).astype(np.int32)), runs)


_VERDICT = "anchor long, whole long, found array<struct<a:int,b:int>>"


def _judged(bodies: DataFrame, shards: int, units: Units) -> DataFrame:
    def run(batches):
        # a task's own files, gone with it; a task that is lost starts anew
        with tempfile.TemporaryDirectory() as folder:
            disk = Disk(folder, units.memory)
            spools = {x: disk.spool(y) for x, y in (("anchor", np.int64), ("whole", np.int64), ("copies", np.bool_), ("size", np.int64), ("length", np.int64))}
            text, last = disk.spool(np.uint8), None
            for batch in batches:
                keys = np.stack([batch.column(i).to_numpy() for i in (0, 1)], 1)
                new = np.ones(len(keys), bool)  # segments that came twice lie side by side
                new[1:] = (keys[1:] != keys[:-1]).any(1)
                new[:1] = last is None or (keys[0] != last).any()
                last = keys[-1]
                kept = [x + units.separator for x, y in zip(batch.column(4).to_pylist(), new.tolist(), strict=True) if y]
                text.add(np.frombuffer(b"".join(kept), np.uint8))
                for x, y in zip(spools, (keys[new, 0], keys[new, 1], batch.column(2).to_numpy()[new] > 1, batch.column(3).to_numpy()[new], [len(x) for x in kept]), strict=True):
                    spools[x].add(y)
            anchor, whole, copies, size, length = (x.array() for x in spools.values())
            if not size.size:
                return
            starts = np.cumsum(length) - length
            flags, first = units.judge(text.array(), starts, size, disk)
            for i in range(0, size.size, 10_000):
                part = slice(i, min(i + 10_000, size.size))
                n = size[part]
                at = np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                some, runs = _runs(flags[at] | np.repeat(copies[part], n), n)
                if some.size:
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[part][some]), pa.array(whole[part][some]), runs], ["anchor", "whole", "found"])

    return bodies.repartition(shards, "anchor").sortWithinPartitions("anchor", "whole").mapInArrow(run, _VERDICT)


def _verdicts(groups: DataFrame, read: Callable[[DataFrame], DataFrame], units: Units, shard_bytes: int, level: int = 0) -> DataFrame:
    """Which windows of each distinct segment (anchor, whole, weight, times, size, load) occur again; ``read`` gives the bodies of some."""
    loads = groups.groupBy("anchor").agg(F.sum("load").alias("bucket"), F.count("*").alias("distinct"), F.max("times").alias("places"))
    # places of the minimiser in distinct segments: two or more have to be compared
    loads = loads.withColumn("compared", (F.col("distinct") > 1) | (F.col("places") > 1))
    hot = F.col("compared") & (F.col("bucket") > (HOT_SHARDS * shard_bytes if level < LEVELS else 1 << 62))
    loads = loads.withColumn("hot", hot)
    total, large = loads.where("compared").agg(F.sum("bucket"), F.max(F.col("hot").cast("int"))).first()
    placed = groups.join(loads.select("anchor", "compared", "hot"), "anchor")
    alone = placed.where("not compared and weight > 1").select("anchor", "whole", F.array(F.struct(F.lit(0).alias("a"), F.col("size").alias("b"))).alias("found"))
    cold = _judged(read(placed.where("compared and not hot").drop("compared", "hot")), max(1, -(-int(total or 0) // shard_bytes)), units)
    out = alone.unionByName(cold)
    if large:
        parts = written(_recut(read(placed.where("hot").drop("compared", "hot")), units, level + 1), "repeats-parts")
        same = ["anchor", "whole"]
        # one of equal parents is enough; of equal parts one body travels
        parts = parts.dropDuplicates(["parent", "parent_whole", "offset"])
        merged = written(parts.groupBy(*same).agg(F.sum("weight").alias("weight"), F.max("times").alias("times"), *(F.first(c).alias(c) for c in ("size", "load", "body"))), "repeats-merged")
        below = _verdicts(merged.drop("body"), lambda some: merged.join(some.select(*same), same).select("anchor", "whole", "weight", "size", "body"), units, shard_bytes, level + 1)
        shifted = F.transform("found", lambda x: F.struct((x["a"] + F.col("offset")).cast("int").alias("a"), (x["b"] + F.col("offset")).cast("int").alias("b")))
        out = out.unionByName(parts.drop("body").join(below, same).select(F.col("parent").alias("anchor"), F.col("parent_whole").alias("whole"), shifted.alias("found")))
    return out


def repeated_runs(source: DataFrame, units: Units, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(t1, t2, runs: starts of the repeated windows, as ranges of units) of the texts that hold one. ``source`` has t1, t2 and text."""
    cut = _cut(source, units)
    twice = written(cut.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor"), "repeats-anchors")
    held = cut.join(twice, "anchor").groupBy("anchor", "whole", "t1", "t2", "start", "size", "load").agg(F.count("*").alias("copies"), F.max("times").alias("times"))
    held = written(held, "repeats-segments")
    groups = held.groupBy("anchor", "whole").agg(F.sum("copies").alias("weight"), F.max("times").alias("times"), *(F.first(c).alias(c) for c in ("t1", "t2", "start", "size", "load")))
    groups = written(groups, "repeats-groups")  # any of the equal segments will do, but the same one for all that follows
    verdicts = _verdicts(groups, lambda some: _bodies(source, some, units), units, shard_bytes)
    runs = held.join(verdicts, ["anchor", "whole"]).select("t1", "t2", F.transform("found", lambda x: F.struct((x["a"] + F.col("start")).alias("a"), (x["b"] + F.col("start")).alias("b"))).alias("runs"))
    return runs.groupBy("t1", "t2").agg(F.flatten(F.collect_list("runs")).alias("runs"))  # one text's own


def marks(runs, width: int, n: int) -> np.ndarray:
    """Which of a text's n units lie in a window that starts in one of the runs."""
    steps = np.zeros(n + 1, np.int64)
    for r in runs:
        steps[r["a"]] += 1
        steps[min(n, r["b"] + width - 1)] -= 1
    return np.cumsum(steps[:n]) > 0
