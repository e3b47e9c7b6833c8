"""Quality rules: statistics of each text and cross-document line frequency.

Each text's lines are normalised (lower-case words joined by one space) and hashed, twice. A line
that more distinct documents of one host hold than the limit allows is taken as
boilerplate and cut; a text that loses most of its words with those lines is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .shared import by_batch, written

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
REPEAT = 8


def _again(row: np.ndarray, first: np.ndarray, second) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal items of a row together, and whether each in that order equals the one before: by both hashes, the second is made on demand."""
    order = np.lexsort((first, row))
    same = np.zeros(order.size, bool)
    same[1:] = (row[order[1:]] == row[order[:-1]]) & (first[order[1:]] == first[order[:-1]])
    if same.any():
        other = second()
        order = np.lexsort((other, first, row))
        same[1:] = (row[order[1:]] == row[order[:-1]]) & (first[order[1:]] == first[order[:-1]]) & (other[order[1:]] == other[order[:-1]])
    return order, same


def text_statistics(data: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The statistics of each row, and its lines with words: row, start and end among the words, number of the line in its text."""
    rows = off.size - 1
    starts, ends, first = k.words(data, off)
    n_words = np.diff(first)
    in_word = k.NOT_SPACE[data]
    out = {"n_words": n_words, "word_chars": k.row_sums(in_word & k.LEADS[data], off), "n_symbols": k.row_sums(SYMBOLS[data], off)}
    raw = k.prefix_hash(data)
    # lines: cut at each \n and at the end of each row
    breaks = np.flatnonzero(data == 0x0A)
    line_end = np.sort(np.concatenate([breaks, off[1:]]), kind="stable")
    per_row = k.row_sums(data == 0x0A, off) + 1
    line_of = np.concatenate([[0], np.cumsum(per_row)])
    row_of_line = np.repeat(np.arange(rows), per_row)
    # an end of row sorts after a \n at the same place only if that \n opens the next row, so ends are set by row
    line_end[line_of[1:] - 1] = off[1:]
    inner = np.ones(line_end.size, bool)
    inner[line_of[1:] - 1] = False
    line_end[inner] = breaks
    line_start = np.empty_like(line_end)
    line_start[1:] = line_end[:-1] + 1
    line_start[line_of[:-1]] = off[:-1]
    word_from = np.searchsorted(starts, line_start)
    word_to = np.searchsorted(starts, line_end)
    words_in = word_to - word_from
    full = words_in > 0
    row = row_of_line[full]
    order, same = _again(row, k.range_hash(raw, line_start[full], line_end[full]), lambda: k.range_hash(k.prefix_hash(data, True), line_start[full], line_end[full]))
    out["n_dup_lines"] = np.bincount(row[order[same]], minlength=rows)
    # 8-word windows found again in the same text
    covered = np.zeros(starts.size, bool)
    if starts.size >= REPEAT:
        at = np.arange(starts.size - REPEAT + 1)
        row_of_word = np.repeat(np.arange(rows), n_words)
        at = at[row_of_word[at] == row_of_word[at + REPEAT - 1]]
        words = k.range_hash(raw, starts, ends)
        order, same = _again(row_of_word[at], k.window_hash(words, REPEAT)[at], lambda: k.window_hash(~words, REPEAT)[at])
        twice = np.zeros(at.size, bool)
        twice[order[same]] = True
        twice[order[:-1][same[1:]]] = True
        if twice.any():
            covered = k.covered(at[twice], REPEAT, starts.size)
    out["n_repeat_words"] = k.row_sums(covered, first)
    return out, {"row": row, "from": word_from[full], "to": word_to[full], "at": np.arange(row_of_line.size)[full] - line_of[row]}


def line_hashes(data: np.ndarray, off: np.ndarray, lines: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Two independent hashes of each line's words, A-Z lower-cased."""
    starts, ends, _ = k.words(data, off)
    words = k.range_hash(k.prefix_hash(k.LOWER[data]), starts, ends)
    return [k.range_hash(k.value_prefix_hash(words, x), lines["from"], lines["to"]) for x in (False, True)]


def _run(batch):
    for a, b, data, off in k.string_slices(batch.column(3)):
        out, lines = text_statistics(data, off)
        first, second = line_hashes(data, off, lines)
        edges = np.concatenate([[0], np.cumsum(np.bincount(lines["row"], minlength=b - a))]).astype(np.int32)
        fields = {"line": first.view(np.int64), "line2": second.view(np.int64), "n": lines["to"] - lines["from"], "at": lines["at"].astype(np.int32)}
        lists = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], list(fields)))
        yield {x: batch.column(i).slice(a, b - a) for i, x in enumerate(("id", "host", "doc"))} | {x: y.astype(np.int64) for x, y in out.items()} | {"lines": lists}


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 20, max_repeat_share: int = 30, line_most: int = 10, small_share: float = 0.5, min_kept: float = 0.3) -> DataFrame:
    """Statistics and verdict for each text.

    Returns a row for each row of ``docs``: its id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (under ``min_words`` words, or over ``max_repeat_share`` percent of the words in windows of
    8 words found again), n_line_words (words in lines above their host's limit), kept and cut_lines (the numbers of those lines, from 0,
    for ``without_lines``). The limit of a host is ``line_most`` documents however large the host, and ``small_share`` of its
    documents (2 at least) where that is less; documents are told apart by id (those of null id by text), so repeated rows count once,
    copies of other ids each. A text with under ``min_kept`` of its words left is depleted and not kept; a line at the limit stays.
    Null and empty texts have no words and fail; a null host is a host of its own; repeated rows get the same verdict; very long texts are read
    whole; an empty table gives an empty one; other columns are ignored, whatever their names.
    """
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("\0")).alias("host"), F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col))).otherwise(F.xxhash64(F.lit(1), text)).alias("doc"), text.alias("text"))
    kind = source.schema[0].dataType.simpleString()
    schema = f"id {kind}, host string, doc long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:long,line2:long,n:long,at:int>>"
    stats = written(by_batch(source, schema, _run).withColumn("row", F.monotonically_increasing_id()), "quality-rules")
    same = ["host", "line", "line2"]
    lines = stats.select("row", "host", "doc", F.explode("lines").alias("x")).select("row", "host", "doc", "x.*")
    # rows are counted first, as that needs no document to travel; documents only for lines of more rows than the least limit
    often = lines.groupBy(*same).agg(F.count("*").alias("rows")).where(F.col("rows") > min(2, line_most)).select(*same)
    held = written(lines.join(often, same), "quality-lines")
    limit = F.least(F.lit(float(line_most)), F.greatest(F.lit(2.0), F.col("of") * small_share))
    hosts = stats.groupBy("host").agg(F.countDistinct("doc").alias("of"))
    over = held.groupBy(*same).agg(F.countDistinct("doc").alias("docs")).join(hosts, "host").where(F.col("docs") > limit).select(*same)
    lost = held.join(over, same).groupBy("row").agg(F.sum("n").alias("n_line_words"), F.sort_array(F.collect_list("at")).alias("cut_lines"))  # one text's own
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_share * F.col("n_words"))
    out = stats.drop("lines").join(lost, "row", "left").withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0))).withColumn("base_failed", base)
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("n_line_words") >= min_kept * F.col("n_words"))
    cut = F.coalesce("cut_lines", F.expr("cast(array() as array<int>)"))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_line_words", kept.alias("kept"), cut.alias("cut_lines"))


def without_lines(text: Column, cut_lines: Column) -> Column:
    """A text without the lines of these numbers; the others stay as they are."""
    left = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(cut_lines, i))
    return F.when(F.size(cut_lines) > 0, F.array_join(left, "\n")).otherwise(text)
