"""N-gram Jaccard self-join with token-combination prefixes, down to connected components.

Tokens (hashed word shingles) have one order: by frequency class, from a count sketch of fixed size, then by hash. Two
sets that link share a token among the first n - ceil(t n) + 1 of each (the prefix). A token that few sets index pairs its
sets by itself. A set with a frequent token in its prefix extends the prefix to all its tokens, deals them out to G classes by hash
and indexes the combination of each class's tokens: two linked sets differ in D tokens at most, so of any D + 1 classes one
is alike in both. G is over D + 1, and each set indexes only its D + 1 largest classes, so the number k
of tokens in a combination is as large as the set's size allows and no list holds more than sets with these k tokens in common.

Equal sets are one set. Each index list first offers its sets to one pivot, the set that shares most; verified links are
joined to components, and only pairs of a list that lie in different components are looked at again, a growing number of
outsiders in each round. Sizes and a parity signature with two bits or more for each token (a lower bound of the difference) rule pairs
out; what is left is verified token by token.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .components import components
from .repeats import text_names
from .shared import by_batch, written

_CELLS = 1 << 20
_CHUNK = 1 << 16
#: Sets that index a token singly at most; tokens with more are frequent.
RARE = 64
#: Outsiders of a list that are offered to all others in the first round, about; eight times as many in each further one.
OFFERED = 16
#: Names of texts that are broadcast at most, 16 bytes each.
FEW = 1 << 18
#: Names that a task remembers, so as not to send copies again; beyond, copies travel twice.
_SEEN = 1 << 16
_RATIO = 2.0
#: Ways to deal a set's tokens out to classes.
_DEALS = 4


def _token_sets(data: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    starts, ends, first = k.words(data, off)
    return k.shingles(k.range_hash(k.prefix_hash(k.LOWER[data]), starts, ends), first, size)


def _names(sets: list[np.ndarray], clashes: frozenset[int] = frozenset(), bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two independent names of each set. Sets of different second names may clash in the first: then both names make the first one."""
    sizes = np.array([x.size for x in sets], np.int64)
    ends = np.cumsum(sizes)
    whole, out = np.concatenate(sets), []
    for salt in (np.uint64(0x9E6C63D0676A9A99), np.uint64(0x5851F42D4C957F2D)):
        running = np.zeros(whole.size + 1, np.uint64)
        np.cumsum(k.mix(whole ^ salt), out=running[1:])
        out.append(k.mix((running[ends] - running[ends - sizes]) ^ k.mix(sizes.astype(np.uint64) + salt)).view(np.int64))
    first, second = out
    if bits < 64:
        first = first & ((1 << bits) - 1)
    if clashes:
        first = np.where(np.isin(first, np.fromiter(clashes, np.int64)), first ^ second, first)
    return first, second


def _signature(tokens: np.ndarray) -> np.ndarray:
    """Parity of the tokens by bit, a power of two of bits, at least two for each token; equal tokens of two sets cancel out."""
    bits = 1 << max(8, int(tokens.size).bit_length() + 1)
    return np.packbits((np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _described(source: DataFrame, size: int, bits: int) -> DataFrame:
    """For each row: id, t1, t2, n, s and s2 (the set's names) and signature; besides, each task's token counts by sketch cell."""
    kind = source.schema[0].dataType.simpleString()
    head = f"id {kind}, t1 long, t2 long, n long, s long, s2 long, sign array<long>, chunk int, cells binary"

    def run(batches):
        cells, target = np.zeros(_CELLS, np.uint32), None
        for batch in batches:
            if target is None:
                target = pa.schema([("id", batch.schema[0].type), *((x, pa.int64()) for x in ("t1", "t2", "n", "s", "s2")), ("sign", pa.list_(pa.int64())), ("chunk", pa.int32()), ("cells", pa.binary())])
            for a, b, data, off in k.string_slices(batch.column(3)):
                sets = _token_sets(data, off, size)
                cells += np.bincount((np.concatenate(sets) >> np.uint64(44)).astype(np.int64), minlength=_CELLS).astype(np.uint32)
                s, s2 = _names(sets, bits=bits)
                signs = [_signature(x) if x.size else np.empty(0, np.int64) for x in sets]
                edges = np.concatenate([[0], np.cumsum([x.size for x in signs])]).astype(np.int32)
                arrays = [batch.column(i).slice(a, b - a) for i in range(3)]
                arrays += [pa.array([x.size for x in sets], pa.int64()), pa.array(s), pa.array(s2), pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(signs)))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())], schema=target)
        if target is not None:
            for i in range(_CELLS // _CHUNK):
                part = np.minimum(cells[i * _CHUNK : (i + 1) * _CHUNK], 65535).astype(np.uint16).tobytes()
                yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in target][:-2] + [pa.array([i], pa.int32()), pa.array([part], pa.binary())], schema=target)

    return source.mapInArrow(run, head)


def _classes(described: DataFrame) -> np.ndarray:
    """Frequency class of each sketch cell: the power of two in what its count has above the noise that rare tokens make."""

    def total(frame):
        import pandas as pd

        added = np.zeros(_CHUNK, np.int64)
        for x in frame.cells:
            added += np.frombuffer(x, np.uint16)
        return pd.DataFrame({"chunk": [frame.chunk.iloc[0]], "cells": [added.tobytes()]})

    cells = np.zeros(_CELLS, np.int64)
    parts = described.where("chunk is not null").select("chunk", "cells").groupBy("chunk").applyInPandas(total, "chunk int, cells binary")
    for row in parts.collect():  # of a fixed size
        cells[row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK] = np.frombuffer(row.cells, np.int64)
    floor = float(np.median(cells))
    return np.log2(np.maximum(cells - floor - 3 * np.sqrt(floor), 0) + 1).astype(np.uint8)


def _least_overlap(n: int, percent: int) -> int:
    return -(-n * percent // 100)


@dataclass(frozen=True)
class _Model:
    """What every task needs to read sets from texts."""

    size: int
    percent: int
    bits: int
    classes: np.ndarray
    clashes: frozenset[int]

    def names(self, sets: list[np.ndarray]) -> np.ndarray:
        return _names(sets, self.clashes, self.bits)[0]

    def ordered(self, tokens: np.ndarray) -> np.ndarray:
        return tokens[np.lexsort((tokens, self.classes[(tokens >> np.uint64(44)).astype(np.int64)]))]


def _prefixes(source: DataFrame, model) -> DataFrame:
    """(token, s, n) for the prefix of each row's set."""

    def run(batch):
        m = model.value
        for _, _, data, off in k.string_slices(batch.column(0)):
            sets = [x for x in _token_sets(data, off, m.size) if x.size]
            if sets:
                heads = [m.ordered(x)[: x.size - _least_overlap(x.size, m.percent) + 1] for x in sets]
                lengths = [x.size for x in heads]
                sizes = np.array([x.size for x in sets], np.int64)
                yield {"token": np.concatenate(heads).view(np.int64), "s": np.repeat(m.names(sets), lengths), "n": np.repeat(sizes, lengths)}

    return by_batch(source.select("text"), "token long, s long, n long", run)


def _bodies(source: DataFrame, wanted: DataFrame, model) -> DataFrame:
    """(s, tokens: 8 bytes each) of the sets whose texts are ``wanted`` (t1, t2).

    Few names are broadcast, up to ``FEW`` by count; beyond that texts and names are dealt out by name.
    """

    def run(batches):
        m = model.value
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, off in k.string_slices(batch.column(0)):
                sets = [x for x in _token_sets(data, off, m.size) if x.size]
                names, bodies = [], []
                for name, x in zip(m.names(sets).tolist() if sets else (), sets, strict=True):
                    if name not in seen:
                        if len(seen) >= _SEEN:
                            seen.clear()
                        seen.add(name)
                        names.append(name)
                        bodies.append(x.tobytes())
                if names:
                    yield pa.RecordBatch.from_pydict({"s": pa.array(names, pa.int64()), "tokens": pa.array(bodies, pa.binary())})

    wanted = wanted.select("t1", "t2")
    if wanted.limit(FEW + 1).count() <= FEW:
        wanted = F.broadcast(wanted)
    return source.join(wanted, ["t1", "t2"], "left_semi").select("text").mapInArrow(run, "s long, tokens binary")


def _size_classes(n: int, percent: int) -> range:
    """Size classes in which a set of n tokens meets others: those of the larger set of a pair, its own first."""
    return range(int(np.log(n) / np.log(_RATIO)), int(np.log(n * 100 // percent) / np.log(_RATIO)) + 1)


def class_keys(tokens: np.ndarray, q: int, percent: int) -> np.ndarray:
    """Keys of a set among sets of size class q: the token combinations of its larger classes.

    A set that may differ from others in D tokens indexes its D + 1 largest classes (ties by content), so one that is alike in both sets of a linked pair.
    Of the two the set whose least indexed class is larger has one that the other indexes too. Where too many classes are empty (small
    sets) the tokens are dealt out again by another hash, at last with empty classes as keys.
    """
    largest = int(_RATIO ** (q + 1)) + 1
    groups = 2 * largest * (100 - percent) // (100 + percent)
    groups = (groups + 1) * 4 // 3 + 1 if groups else 1
    apart = (tokens.size + min(largest, tokens.size * 100 // percent)) * (100 - percent) // (100 + percent)
    out = []
    for deal in range(_DEALS):
        salt = np.uint64((q * _DEALS + deal + 1) * 0x9E3779B97F4A7C15 % 2**64)
        spread = k.mix(tokens ^ salt)
        part = (spread % np.uint64(groups)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        sizes = np.bincount(part, minlength=groups)
        running = np.zeros(tokens.size + 1, np.uint64)
        np.cumsum(k.mix(spread[order]), out=running[1:])
        ends = np.cumsum(sizes)
        keys = k.mix((running[ends] - running[ends - sizes]) ^ k.mix(salt + np.arange(groups, dtype=np.uint64)))
        chosen = np.lexsort((keys, sizes))[groups - 1 - apart :]
        if sizes[chosen[0]]:
            out.append(keys[chosen])
            break
        out.append(keys if deal == _DEALS - 1 else keys[sizes > 0])
    return np.concatenate(out)


def _combinations(bodies: DataFrame, percent: int) -> DataFrame:
    """(key, s): the index lists of sets with frequent tokens."""

    def run(batch):
        names, keys = [], []
        for s, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(body, np.uint64)
            for q in _size_classes(x.size, percent):
                keys.append(class_keys(x, q, percent))
                names.append(np.full(keys[-1].size, s))
        if names:
            yield {"key": np.concatenate(keys).view(np.int64), "s": np.concatenate(names)}

    return by_batch(bodies.select("s", "tokens"), "key long, s long", run)


def _sizes_allow(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _band_bit(n: Column, percent: int, shift: int = 0) -> Column:
    """One of 64 bits for the band of a size; sizes that allow a link lie in the same band or in neighbours."""
    width = max(float(np.log(100 / percent)), 1e-6) * 1.0001
    band = F.pmod(F.floor(F.log(n) / width).cast("long") + shift, F.lit(64)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), band)


def _has_partner(n: Column, bands: Column, m: Column, percent: int) -> Column:
    """Whether a list of m sets whose band bits are ``bands`` may hold another set that a set of size n could link with; rules out no link."""
    beside = _band_bit(n, percent, 1).bitwiseOR(_band_bit(n, percent, -1))
    return (F.bit_count(bands) < m) | (bands.bitwiseAND(beside) != 0)


def _folded(sign: Column, percent: int) -> Column:
    """The signature folded as often as leaves unlike sets twice as far apart as a link allows: what travels with the lists."""
    kept = 1.0
    while kept / 2 >= 4 * (100 - percent) / (100 + percent) and kept > 0.25:
        kept /= 2
        half = (F.size(sign) / 2).cast("int")
        sign = F.zip_with(F.slice(sign, F.lit(1), half), F.slice(sign, half + 1, half), lambda u, v: u.bitwiseXOR(v))
    return sign


def _may_link(a: str, b: str, percent: int) -> Column:
    """What sizes and signatures allow: the difference is at most (n + m)(100 - percent) / (100 + percent)."""

    def even(x: str, y: str) -> Column:  # the longer signature folds down to the shorter
        half = (F.size(x) / 2).cast("int")
        folded = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(x) > F.size(y), folded).otherwise(F.col(x))

    x, y = even(f"{a}.sign", f"{b}.sign"), even(f"{b}.sign", f"{a}.sign")
    apart = F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda acc, v: acc + v)
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    # lengths that differ by more than one fold leave a null, which rules nothing out
    return _sizes_allow(n, m, percent) & (F.coalesce(apart, F.lit(0)) * (100 + percent) <= (n + m) * (100 - percent))


def _verified(pairs: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""

    def run(batch):
        a, b = (batch.column(i).to_pylist() for i in (2, 3))
        ok = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.intersect1d(x, y, assume_unique=True).size
            ok[i] = 100 * both >= percent * (x.size + y.size - both)
        yield {"a": batch.column(0).filter(pa.array(ok)), "b": batch.column(1).filter(pa.array(ok))}

    x = bodies.select(F.col("s").alias("a"), F.col("tokens").alias("x"))
    y = bodies.select(F.col("s").alias("b"), F.col("tokens").alias("y"))
    return by_batch(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), "a long, b long", run)


class _Links:
    """Verified links so far and their components; reads the sets that pairs need, each once."""

    def __init__(self, read, percent: int):
        self.read, self.percent = read, percent
        self.bodies: DataFrame | None = None
        self.labels: DataFrame | None = None

    def sets(self, names: DataFrame) -> DataFrame:
        """Bodies of the sets named (s), and of others read before."""
        names = names.distinct()
        if self.bodies is not None:
            names = names.join(self.bodies.select("s"), "s", "left_anti")
        names = written(names, "jaccard-wanted")
        if names.limit(1).count():
            # copies that lie in several tasks may say a set more than once; links are told apart later
            more = written(self.read(names), "jaccard-bodies")
            self.bodies = more if self.bodies is None else self.bodies.unionByName(more)
        return self.bodies

    def add(self, pairs: DataFrame) -> None:
        pairs = written(pairs, "jaccard-pairs")
        if not pairs.limit(1).count():
            return
        bodies = self.sets(pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))))
        found = written(_verified(pairs, bodies, self.percent), "jaccard-links")
        if found.limit(1).count():
            if self.labels is not None:  # a component's labels stand for its links
                found = found.unionByName(self.labels.select(F.col("v").alias("a"), F.col("c").alias("b")))
            self.labels = components(found)

    def of(self, rows: DataFrame, column: str, out: str) -> DataFrame:
        """``rows`` with the component of ``column``."""
        if self.labels is None:
            return rows.withColumn(out, F.col(column))
        labels = self.labels.select(F.col("v").alias(column), F.col("c").alias("_c"))
        return rows.join(labels, column, "left").withColumn(out, F.coalesce("_c", F.col(column))).drop("_c")


def _link(lists: DataFrame, signs: DataFrame, links: _Links, percent: int, offered: int) -> DataFrame | None:
    """Components over all linked pairs of the lists (key, s); ``signs``: s, n, sign and weight."""
    sizes = lists.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    lists = written(lists.join(sizes, "key").join(signs.select("s", "n", "weight"), "s"), "jaccard-lists")
    pivots = lists.groupBy("key").agg(F.max(F.struct("weight", "s", "n")).alias("top"))
    lists = written(lists.join(pivots, "key").where("s <> top.s").select("key", "s", "n", "m", F.col("top.s").alias("pivot"), F.col("top.n").alias("pn")), "jaccard-stars")
    star = lists.where(_sizes_allow(F.col("n"), F.col("pn"), percent)).select("s", F.col("pivot").alias("p")).distinct()
    star = star.join(signs.alias("x"), "s").join(signs.select(F.col("s").alias("p"), F.struct("n", "sign", "weight").alias("y")), "p")
    star = star.select(F.col("s").alias("a"), F.col("p").alias("b"), F.struct("n", "sign").alias("x"), "y").where(_may_link("x", "y", percent))
    near = written(star.select("a", "b", F.col("y.weight").alias("pw")), "jaccard-near")
    links.add(near.groupBy("a").agg(F.max_by("b", F.struct("pw", "b")).alias("b")))
    links.add(links.of(links.of(near, "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b"))
    lists = lists.where("m > 2").select("key", "s", "n", "pivot")  # a pair is its pivot and one set: settled
    while True:
        # outsiders of a list: sets beyond the component of its pivot that were not yet offered to the others; a list in one component is settled
        placed = links.of(links.of(lists, "s", "c"), "pivot", "home").withColumn("out", F.col("c") != F.col("home"))
        waiting = placed.groupBy("key").agg(F.count_if("out").alias("waiting"), F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("m"), F.bit_or(_band_bit(F.col("n"), percent)).alias("bands"))
        waiting = waiting.where("waiting > 0 and low <> high").select("key", "waiting", "m", "bands")
        lists = written(placed.join(waiting, "key").where(_has_partner(F.col("n"), F.col("bands"), F.col("m"), percent)).drop("m", "bands"), "jaccard-outside")
        if not lists.limit(1).count():
            return links.labels
        chance = F.pmod(F.xxhash64("key", "s"), F.lit(1 << 20)) / (1 << 20)
        lists = lists.withColumn("now", F.col("out") & ((F.col("waiting") <= offered) | (chance * F.col("waiting") < offered)))
        signed = lists.join(signs.select("s", _folded(F.col("sign"), percent).alias("sign")), "s")
        x, y = signed.where("now").alias("x"), signed.alias("y")
        once = ~F.col("y.now") | (F.col("x.s") < F.col("y.s"))
        met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.c") != F.col("y.c")) & once & _may_link("x", "y", percent))
        links.add(met.select(F.least("x.s", "y.s").alias("a"), F.greatest("x.s", "y.s").alias("b")).distinct())
        lists = lists.where("not now").select("key", "s", "n", "pivot")
        offered *= 8


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, rare: int = RARE, offered: int = OFFERED, name_bits: int = 64) -> DataFrame:
    """Groups of texts whose word-shingle sets are alike.

    Words are runs without ASCII white space, A-Z lower-cased; a text's set has its distinct ``size``-word shingles, with fewer words the
    whole sequence as one. Two texts link when 100 * intersection >= ``percent`` * union. Returns a row for each row of ``docs``:
    its id, n_shingles and component_id, the smallest id reachable by links. Null and empty texts and texts without words have an
    empty set, link with nothing and are their own component; equal sets link; repeated rows share a component; ties in order fall by name and
    change no result; very long texts are sets like others, held whole by one task; null ids are passed over as the smallest; an empty
    table gives an empty one; other columns are ignored, whatever their names. Tokens go by 64-bit hashes, sets by two of them.
    ``name_bits`` shortens the first name, for tests.
    """
    source = docs.select(F.col(id_col).alias("id"), *text_names(F.col(text_col).cast("string")), F.col(text_col).cast("string").alias("text"))
    described = written(_described(source, size, name_bits), "jaccard-sets")
    rows = described.where("chunk is null").drop("chunk", "cells")
    # of 10**11 sets about 300 pairs clash by chance
    clashes = frozenset(r.s for r in rows.where("n > 0").groupBy("s").agg(F.min("s2").alias("a"), F.max("s2").alias("b")).where("a <> b").select("s").collect())
    if clashes:
        rows = rows.withColumn("s", F.when(F.col("s").isin(*clashes), F.col("s").bitwiseXOR(F.col("s2"))).otherwise(F.col("s")))
    model = docs.sparkSession.sparkContext.broadcast(_Model(size, percent, name_bits, _classes(described), clashes))
    prefixes = _prefixes(source, model)
    shared = written(prefixes.groupBy("token").agg(F.min("s").alias("low"), F.max("s").alias("high")).where("low <> high").select("token"), "jaccard-tokens")
    held = written(prefixes.join(shared, "token").distinct(), "jaccard-prefixes")
    df = held.groupBy("token").agg(F.count("*").alias("df"), F.bit_or(_band_bit(F.col("n"), percent)).alias("bands"))
    counted = written(held.join(df, "token"), "jaccard-counted")
    sets = rows.where("n > 0").groupBy("s").agg(*(F.first(c).alias(c) for c in ("t1", "t2", "n", "sign")))
    weights = counted.groupBy("s").agg(F.sum("df").alias("weight"), F.max("df").alias("most"))
    signs = written(sets.join(weights, "s"), "jaccard-signs")
    links = _Links(lambda names: _bodies(source, signs.join(names, "s"), model), percent)
    lists = counted.where((F.col("df") <= rare) & _has_partner(F.col("n"), F.col("bands"), F.col("df"), percent)).select(F.col("token").alias("key"), "s")
    heavy = signs.where(F.col("most") > rare).select("s")
    if heavy.limit(1).count():
        lists = lists.unionByName(_combinations(links.sets(heavy).join(heavy, "s", "left_semi").dropDuplicates(["s"]), percent))
    labels = _link(lists, signs.select("s", "n", "sign", "weight"), links, percent, offered)
    named = rows.where("n > 0").select("id", "n", "s")
    named = named.withColumn("c", F.col("s")) if labels is None else named.join(labels.withColumnRenamed("v", "s").withColumnRenamed("c", "label"), "s", "left").withColumn("c", F.coalesce("label", "s"))
    first = written(named.groupBy("c").agg(F.min("id").alias("component_id")), "jaccard-first")
    out = named.join(first, "c").select("id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return out.unionByName(alone).withColumnRenamed("id", id_col)
