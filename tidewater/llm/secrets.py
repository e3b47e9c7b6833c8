"""Secret scans through a trigram inverted index, in DataFrame operations only.

From each rule's regular expression follows a Boolean query over the trigrams that any match must hold: a
disjunction of conjunctions. The index lists, for each trigram in any query, the rows that hold it; the postings of a
conjunction are intersected by counting, and only rows that some conjunction admits are searched with the
expression. Rules without mandatory trigrams search every row. A bitmap of fixed size over the candidates' names tells which texts have to
travel to meet them; the others are searched where they are read.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an expression that the JVM and Python read alike, and the least length of a group (0: the match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in the order in which spans with the same start are listed.
BASE = (
    Rule("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # the same as the runs of AKIA[A-Z0-9]+ without those under 20
    Rule("hex", r"[0-9a-f]{24,}"),  # the same as the runs of [0-9a-f]+ without those under 24
)
#: Rules beyond the base.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("live_key", r"sk_live_[A-Za-z0-9]{16,}"),
)

#: Matches that are gathered in one array at a time.
_CHUNK = 256
#: Bits of the filter that tells which texts may be candidates.
FILTER_BITS = 1 << 26
#: Exact strings of a part of an expression that are kept before it counts as unknown.
_MOST_STRINGS = 16


@dataclass
class _Info:
    """Of a part of an expression: its exact strings in lower case if they are few (else None), and the trigram query (a set of conjunctions) that matches imply."""

    exact: frozenset[str] | None
    query: frozenset[frozenset[str]]


_TRUE: frozenset[frozenset[str]] = frozenset([frozenset()])


def _and(a: frozenset, b: frozenset) -> frozenset:
    return _least(frozenset(x | y for x, y in itertools.product(a, b)))


def _least(query: frozenset) -> frozenset:
    return frozenset(x for x in query if not any(y < x for y in query))


def _of_strings(strings: frozenset[str]) -> frozenset:
    if any(len(s) < 3 for s in strings):
        return _TRUE
    # every third trigram and the last cover a string; more would only name the same bytes again
    return _least(frozenset(frozenset(s[i : i + 3] for i in {*range(0, len(s) - 2, 3), len(s) - 3}) for s in strings))


_UNKNOWN = _Info(None, _TRUE)
_CLASS_ESCAPES = set("dDwWsSbB")


class _Parser:
    """Reads the expressions of rules: literals, classes, groups, alternatives and repeats. What it does not know it refuses."""

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def more(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def take(self) -> str:
        if self.at >= len(self.pattern):
            raise ValueError(f"{self.pattern} ends too soon")
        self.at += 1
        return self.pattern[self.at - 1]

    def escape(self) -> str | None:
        """The character that an escape stands for; None for a class of characters."""
        c = self.take()
        if c == "x":
            self.at += 2
            return chr(int(self.pattern[self.at - 2 : self.at], 16))
        if c in _CLASS_ESCAPES:
            return None
        if c.isalnum() and c not in "nrt":
            raise ValueError(f"unknown escape \\{c} in {self.pattern}")
        return {"n": "\n", "r": "\r", "t": "\t"}.get(c, c)

    def alternatives(self) -> _Info:
        options = [self.sequence()]
        while self.more() == "|":
            self.take()
            options.append(self.sequence())
        if len(options) == 1:
            return options[0]
        strings = [x.exact for x in options]
        exact = frozenset().union(*strings) if None not in strings else None
        query = _least(frozenset().union(*((_of_strings(x.exact) if x.exact is not None else x.query) for x in options)))
        return _Info(exact if exact is not None and len(exact) <= _MOST_STRINGS else None, query)

    def sequence(self) -> _Info:
        exact: frozenset[str] = frozenset([""])  # strings of the run of known parts that is open now
        query, whole = _TRUE, True
        while self.more() not in ("", "|", ")"):
            one = self.repeated(self.atom())
            grown = frozenset(x + y for x, y in itertools.product(exact, one.exact)) if one.exact is not None else frozenset()
            if 0 < len(grown) <= _MOST_STRINGS:
                exact = grown
                continue
            whole = False
            query = _and(_and(query, _of_strings(exact)), one.query if one.exact is None else _TRUE)
            exact = one.exact if one.exact is not None else frozenset([""])
        return _Info(exact, _TRUE) if whole else _Info(None, _and(query, _of_strings(exact)))

    def atom(self) -> _Info:
        c = self.take()
        if c == "(":
            if self.pattern[self.at : self.at + 2] == "?:":
                self.at += 2
            elif self.more() == "?":
                raise ValueError(f"unknown group in {self.pattern}")
            inner = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"open group in {self.pattern}")
            return inner
        if c == "[":
            return self.characters()
        if c == ".":
            return _UNKNOWN
        if c in "^$":
            return _Info(frozenset([""]), _TRUE)
        if c == "\\":
            c = self.escape()
            return _UNKNOWN if c is None else _Info(frozenset([c.lower()]), _TRUE)
        if c in "*+?{":
            raise ValueError(f"nothing to repeat in {self.pattern}")
        return _Info(frozenset([c.lower()]), _TRUE)

    def characters(self) -> _Info:
        known, chars = self.more() != "^", set()
        start = self.at
        while self.more() != "]" or self.at == start:
            c = self.take()
            c = self.escape() if c == "\\" else c
            if c is None:
                known = False
            elif self.more() == "-" and self.pattern[self.at + 1] != "]":
                self.take()
                last = self.take()
                last = self.escape() if last == "\\" else last
                known &= ord(last) - ord(c) < _MOST_STRINGS
                chars |= {chr(x).lower() for x in range(ord(c), ord(last) + 1)} if known else set()
            else:
                chars.add(c.lower())
        self.take()
        return _Info(frozenset(chars), _TRUE) if known and len(chars) <= _MOST_STRINGS else _UNKNOWN

    def repeated(self, one: _Info) -> _Info:
        while self.more() and self.more() in "*+?{":
            c, low, high = self.take(), 0, None
            if c == "{":
                end = self.pattern.index("}", self.at)
                bounds = self.pattern[self.at : end].split(",")
                self.at = end + 1
                low, high = int(bounds[0] or 0), int(bounds[-1]) if bounds[-1] else None
            elif c == "+":
                low = 1
            elif c == "?":
                high = 1
            if self.more() in ("?", "+") and self.more():
                self.take()  # lazy or possessive: the same strings
            if (low, high) == (1, 1):
                continue
            if (low, high) == (0, 1) and one.exact is not None and len(one.exact) < _MOST_STRINGS:
                one = _Info(one.exact | {""}, _TRUE)
            elif low == 0:
                one = _UNKNOWN
            else:
                one = _Info(None, _of_strings(one.exact) if one.exact is not None else one.query)
        return one


def trigram_query(pattern: str) -> frozenset[frozenset[str]]:
    """The conjunctions of lower-case trigrams of which any match holds one whole; an empty conjunction admits every text."""
    parser = _Parser(pattern)
    info = parser.alternatives()
    if parser.more():
        raise ValueError(f"unmatched bracket in {pattern}")
    return _of_strings(info.exact) if info.exact is not None else info.query


def candidates(docs: DataFrame, rules: tuple[Rule, ...], row_col: str, text_col: str) -> DataFrame:
    """(row, rules: the kinds whose trigram query the row's text meets), for rules that have mandatory trigrams."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    wanted = sorted({t for q in queries.values() if frozenset() not in q for c in q for t in c})
    low = F.col("low")
    held = F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(i)) for i, t in enumerate(wanted)))
    # equal texts have one row name, so their postings collapse before they are dealt out
    postings = docs.select(F.col(row_col), F.lower(text_col).alias("low")).select(F.col(row_col), F.explode(F.array_compact(held)).alias("gram")).distinct()
    number = {t: i for i, t in enumerate(wanted)}
    terms = [(kind, c, len(conj), number[t]) for kind, q in queries.items() if frozenset() not in q for c, conj in enumerate(sorted(q, key=sorted)) for t in sorted(conj)]
    spark = docs.sparkSession
    plan = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{kind}', {c}, {n}, {g})" for kind, c, n, g in terms) + " AS t(kind, clause, needed, gram)")  # as many rows as the rules have trigrams
    met = postings.join(F.broadcast(plan), "gram").groupBy(row_col, "kind", "clause").agg(F.count("*").alias("held"), F.first("needed").alias("needed")).where("held = needed")
    return met.groupBy(row_col).agg(F.collect_set("kind").alias("rules"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end): the matches left to right, those too short left out after they were passed over."""
    pieces = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tail = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    rows = F.arrays_zip(pieces.alias("piece"), found.alias("found"), tail.alias("tail"))
    start = lambda acc, x: acc["at"] + F.length(x["piece"])

    def step(acc, x):
        end = start(acc, x) + F.length(x["found"])
        ok = x["found"].isNotNull() & (F.length(x["tail"]) >= rule.least)
        span = F.struct(start(acc, x).cast("long").alias("start"), F.lit(order).alias("order"), end.cast("long").alias("end"))
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), F.when(ok, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    none = F.expr("cast(array() as array<struct<start:bigint,order:int,end:bigint>>)")
    # appending copies an array, so matches are gathered in chunks
    chunk = lambda acc, c: F.aggregate(F.slice(rows, c * _CHUNK + 1, _CHUNK), F.struct(acc["at"].alias("at"), none.alias("out")), step)
    grow = lambda acc, c: F.struct(chunk(acc, c)["at"].alias("at"), F.concat(acc["out"], F.array(chunk(acc, c)["out"])).alias("out"))
    several = F.expr("cast(array() as array<array<struct<start:bigint,order:int,end:bigint>>>)")
    chunks = F.sequence(F.lit(0), F.ceil(F.size(rows) / _CHUNK).cast("int") - 1)
    few = F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(rows) <= _CHUNK, few).otherwise(F.flatten(F.aggregate(chunks, F.struct(F.lit(0).alias("at"), several.alias("out")), grow, lambda acc: acc["out"])))


def _filter(found: DataFrame) -> DataFrame:
    """(bucket, bits): a bitmap of ``FILTER_BITS`` bits over the names of rows, 32,768 bits a bucket."""
    at = F.pmod(F.col("row"), F.lit(FILTER_BITS))
    return found.select(at.alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))


def _in_filter() -> Column:
    byte = F.expr("conv(hex(substring(bits, cast(bitmap_bit_position(at) div 8 as int) + 1, 1)), 16, 10)").cast("int")
    bit = F.expr("cast(bitmap_bit_position(at) % 8 as int)")
    return F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), bit)) != 0, F.lit(False))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """Secrets of each text.

    Returns a row for each row of ``docs``: its id, the text and spans, an array of (kind, start, end) by start, then in the rules'
    order; places count code points, the end is exclusive. Matches of one rule are leftmost and do not overlap; one whose group is
    shorter than the rule's least length is passed over and left out. Null and empty texts have no spans; a null text stays null;
    repeated rows get equal spans (candidates are found by text, not by id); very long texts are searched whole; an empty table gives an empty one;
    other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    named = rows.withColumn("row", F.xxhash64("text"))  # two texts with one name share their postings: candidates too many, never too few
    found = written(candidates(named.where(F.col("text").isNotNull()).select("row", "text"), rules, "row", "text"), "secret-candidates")
    placed = named.withColumn("at", F.pmod(F.col("row"), F.lit(FILTER_BITS))).withColumn("bucket", F.expr("bitmap_bucket_number(at)"))
    placed = placed.join(F.broadcast(_filter(found)), "bucket", "left").withColumn("travels", _in_filter())  # 8 MiB at most
    there = placed.where("travels").select("id", "text", "row").join(found, "row", "left").select("id", "text", "rules")
    here = placed.where("not travels").select("id", "text", F.expr("cast(null as array<string>)").alias("rules"))
    names = F.array(*(F.lit(r.kind) for r in rules))

    def searched(part: DataFrame, ruled: bool) -> DataFrame:
        spans = []
        for i, r in enumerate(rules):
            everywhere = frozenset() in trigram_query(r.pattern)
            if everywhere or ruled:
                admitted = F.col("text").rlike(r.pattern) if everywhere else F.array_contains("rules", r.kind)
                spans.append(F.when(admitted, _spans(F.col("text"), r, i)).otherwise(F.expr("cast(array() as array<struct<start:bigint,order:int,end:bigint>>)")))
        out = F.concat(*spans) if spans else F.expr("cast(array() as array<struct<start:bigint,order:int,end:bigint>>)")
        out = F.transform(F.array_sort(out), lambda x: F.struct(F.get(names, x["order"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
        return part.select(F.col("id").alias(id_col), F.col("text").alias(text_col), out.alias("spans"))

    return searched(there, True).unionByName(searched(here, False))


def joined_spans(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, overlapping ones together, replaced by ``mark``."""
    step = lambda acc, x: F.when(x["start"] >= acc["at"], F.struct(F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit(mark)).alias("out"), x["end"].alias("at"))).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["end"]).alias("at")))
    return F.when(F.size(spans) > 0, F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))).otherwise(text)
