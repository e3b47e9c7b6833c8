"""The training-data operators against brute force, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import induced, jaccard_join, language_id, mixing, oracles, quality_classifier, secrets, toxicity
from tidewater.llm import toxicity_grammar as grammar
from tidewater.llm.components import components
from tidewater.llm.decontamination import PatternClass, decontaminate
from tidewater.llm.jaccard_join import jaccard_components
from tidewater.llm.quality_rules import quality_rules
from tidewater.llm.repeats import Disk
from tidewater.llm.substring_dedup import substring_dedup
from tidewater.llm.suffix_dedup import suffix_dedup

SPACE = r"[^\x20\x09-\x0D]+"
CLASHING = ["id", "row", "t1", "t2", "s", "n", "x", "spans", "score", "anchor", "key", "words", "kept"]


def table(spark, texts, ids=None, lang="en", source="src0"):
    rows = [(ids[i] if ids else i, t, lang, source, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHING)).repartition(3)


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = ["ab", "cé", "Dog", "eel", "fox", "gnu", "hen", "ibis"] + [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 120))) for _ in range(n)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    out = list(base)
    for t in base[:20]:
        words = t.split()
        if words:
            words[rng.randrange(len(words))] = "edited"
        out += [t, " ".join(words)]
    out += [f"{a}\n{passage}\t{b}" for a, b in zip(base[:8], base[8:16], strict=True)]
    out += ["To " * 150, "abcabc" * 200, "", None, "   ", "a", "x" * 300, "wörd\x00 nul " * 30, "one two three", "One  two three"]
    return out


def rows_of(df, key="doc_id"):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 150, "memory": 64}])
def test_suffix_dedup(spark, texts, sizes):
    width = 40
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + width] for b in data for i in range(len(b) - width + 1))
    got = rows_of(suffix_dedup(table(spark, texts), width=width, gram=16, **sizes))
    for i, b in enumerate(data):
        cut = [False] * len(b)
        for j in range(len(b) - width + 1):
            if seen[b[j : j + width]] > 1:
                cut[j : j + width] = [True] * width
        kept = bytes(c for c, x in zip(b, cut, strict=True) if not x)
        r = got[i][0]
        assert (r.n_bytes, r.n_removed, bytes(r.kept), r.kept_sha256) == (len(b), sum(cut), kept, hashlib.sha256(kept).hexdigest())
        assert [(s.start, s.end) for s in r.removed] == [m.span() for m in re.finditer(b"\1+", bytes(cut))]


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 150, "memory": 64}])
def test_substring_dedup(spark, texts, sizes):
    width = 9
    words = [re.findall(SPACE, t or "") for t in texts]
    seen = Counter(tuple(x[i : i + width]) for x in words for i in range(len(x) - width + 1))
    got = rows_of(substring_dedup(table(spark, texts), width=width, gram=3, **sizes))
    for i, x in enumerate(words):
        cut = [False] * len(x)
        for j in range(len(x) - width + 1):
            if seen[tuple(x[j : j + width])] > 1:
                cut[j : j + width] = [True] * width
        kept = " ".join(v for v, c in zip(x, cut, strict=True) if not c)
        assert (got[i][0].n_words, got[i][0].n_removed, got[i][0].kept) == (len(x), sum(cut), kept)


@pytest.mark.parametrize("size, percent, rare", [(3, 90, 64), (3, 90, 2), (5, 80, 2), (1, 60, 3)])
def test_jaccard_components(spark, texts, size, percent, rare):
    sets = []
    for t in texts:
        x = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(x[i : i + size]) for i in range(max(1, len(x) - size + 1))} if x else set())
    root = list(range(len(sets)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    got = rows_of(jaccard_components(table(spark, texts), size=size, percent=percent, rare=rare, offered=3))
    assert [(got[i][0].n_shingles, got[i][0].component_id) for i in range(len(sets))] == [(len(a), find(i)) for i, a in enumerate(sets)]


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.v: r.c for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100}


@pytest.mark.parametrize("block_bytes", [1 << 22, 12])
def test_decontaminate(spark, texts, block_bytes):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [" ".join((texts[3] or "x").split()[2:30]), "fox", "w1 w2", None, "", "!!", texts[50], texts[50]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("words", F.lit(1))
    windows = defaultdict(set)
    for i, t in enumerate(items):
        x = low(t)
        for j in range(max(1, len(x) - 9) if x else 0):
            windows[tuple(x[j : j + 10])].add(str(i))
    builds = spark.sparkContext.accumulator(0)
    got = rows_of(decontaminate(table(spark, texts), bench, block_bytes=block_bytes, builds=builds))
    blocks = -(-sum(len((t or "").encode()) for t in items) // block_bytes)
    assert builds.value <= blocks * 8, "a worker makes a table once"
    sizes = {len(v) for v in windows}
    for i, t in enumerate(texts):
        x, hit, found = low(t), set(), set()
        for j in range(len(x)):
            for n in sizes:
                if tuple(x[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[tuple(x[j : j + n])]
        r = got[i][0]
        assert (r.n_words, r.n_hit, r["items"], sum(s.end - s.start for s in r.hits)) == (len(x), len(hit), sorted(found), len(hit))


def test_items_of_null_id_are_searched(spark):
    duckdb = pytest.importorskip("duckdb")
    docs = [(1, "x fox y", "en", "s", 7), (2, "eel and fox", "en", "s", 11), (3, "gnu", "en", "s", 3), (4, "clean", "en", "s", 5)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    bench = spark.createDataFrame([(None, "fox"), (7, "eel"), (None, "eel and"), (8, "gnu"), (9, None)], "item_id bigint, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate(docs, bench).collect()}
    assert got == {1: (1, [None]), 2: (3, ["7", None]), 3: (1, ["8"]), 4: (0, [])}
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("benchmark", bench.toArrow())
    digest = lambda x: hashlib.sha256(",".join(i for i in x if i).encode()).hexdigest()
    found = con.execute(f"SELECT doc_id, n_hit, n_items, items_sha256 FROM ({oracles.DECONTAMINATION})").fetchall()
    assert sorted(found) == [(i, n, len(x), digest(x)) for i, (n, x) in sorted(got.items())]


def test_pattern_search_finds_every_place():
    rng = random.Random(5)
    for _ in range(50):
        text = "".join(rng.choice("ab ") for _ in range(2000)).encode()
        patterns = sorted({"".join(rng.choice("ab ") for _ in range(rng.randint(3, 9))).encode() for _ in range(12)})
        got = sorted(PatternClass(patterns).occurrences(np.frombuffer(text, np.uint8)))
        assert got == sorted((i, p) for p in patterns for i in range(len(text)) if text.startswith(p, i))


@pytest.mark.parametrize("budget, base", [(1 << 20, 1 << 20), (40, 1 << 20), (16, 4)])
def test_induced_sorting(tmp_path, budget, base):
    rng = np.random.default_rng(1)
    for k in range(12):
        t = rng.integers(1, k % 5 + 2, int(rng.integers(1, 150))).astype(np.uint8)
        t = np.concatenate([t, t[: t.size // 2], t]) if k % 3 == 0 else t
        b = t.tobytes()
        order = np.concatenate([p for p, _ in induced.InducedSorter(t, Disk(str(tmp_path), budget), base).ordered(1000)])[::-1]
        assert order.tolist() == sorted(range(len(b) + 1), key=lambda i: b[i:])
        for width in (1, 3):
            places = defaultdict(list)
            for i in range(len(b) - width + 1):
                places[b[i : i + width]].append(i)
            got = [sorted(np.concatenate(list(g)).tolist()) for g in induced.repeats(t, width, Disk(str(tmp_path), budget), base)]
            assert sorted(g for g in got if len(g) > 1) == sorted(v for v in places.values() if len(v) > 1)


def secrets_of(t):
    kinds = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    spans = [(m.start(), k, m.end(), name) for k, (name, p, g, n) in enumerate(kinds) for m in p.finditer(t or "") if len(m[g]) >= n]
    return [(name, a, b) for a, _, b, name in sorted(spans)]


def test_secrets(spark):
    cases = ["", None, "password=abc token: secret=token:abcdefgh", "API_KEY = 'Zz/9+_.-=x' apikey:12345 api_key:123456", "AKIA" + "Q" * 16 + " AKIAQ AKIAAKIA" + "7" * 12, "é😀 token=äabcdef passwd='abcdef'", "f" * 24 + "g" + "0" * 23 + "AKIA" + "0" * 30, "PassWord = \"x\" secret=abcdef", "deadbeef" * 4 + "\n" + "deadbeef" * 2, "😀 password==abcdef", "token=token=abcdef", "password : s3cr3t" * 3]
    more = ["-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "eyJhbGc.eyJzdWI.s-_g"]
    got = rows_of(secrets.scan(table(spark, cases + more + cases)))
    for i, t in enumerate(cases + more + cases):
        spans = [(s.kind, s.start, s.end) for s in got[i][0].spans]
        assert [s for s in spans if s[0] in ("assign", "access", "hex")] == secrets_of(t)
    assert [s.kind for s in got[len(cases)][0].spans] == ["private_key"] and "forge_token" in [s.kind for s in got[len(cases) + 1][0].spans] and got[len(cases) + 2][0].spans[0].kind == "web_token"


def test_many_secrets_in_one_text(spark):
    text = " ".join(f"token=abcdef{i}" for i in range(700)) + " é " + " ".join("f" * 24 + "g" for _ in range(300))
    got = secrets.scan(table(spark, [text, None, ""])).where("doc_id = 0").first()
    assert [(s.kind, s.start, s.end) for s in got.spans] == secrets_of(text)


def test_texts_without_candidates_stay(spark):
    """Only candidates' texts meet the postings: the others lie in a branch of their own without an exchange of texts."""
    plan = secrets.scan(table(spark, ["clean"] * 5)).select("doc_id", "spans")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and plan.count("LeftOuter") == 3


def test_expressions_that_are_not_known():
    for pattern in ("(?=abc)d", "a(b", "a)b", "*a", r"\1a"):
        with pytest.raises(ValueError):
            secrets.trigram_query(pattern)
    assert secrets.trigram_query(r"ab[^c]defg") == {frozenset({"def", "efg"})} and secrets.trigram_query("(?:abc)+?|xyz.") == {frozenset({"abc"}), frozenset({"xyz"})}
    assert secrets.trigram_query(r"a\dbcd{0,1}") == {frozenset()} and secrets.trigram_query("abcd{2,3}e") == {frozenset({"abc"})}


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") == {frozenset()}
    assert secrets.trigram_query("AKIA[A-Z0-9]{16,}") == {frozenset({"aki", "kia"})}
    assert frozenset({"pas", "ssw", "swd"}) not in secrets.trigram_query(secrets.BASE[0].pattern)
    for rule in secrets.BASE + secrets.MORE:
        for text in ["password='abcdef1'", "API_key:abcdef", "apikey=abcdef", "Passwd = abcdef", "AKIA" + "A" * 16, "xoxb-0123456789ab", "sk_live_" + "a" * 16, "AIza" + "b" * 35, "-----BEGIN PRIVATE KEY-----"]:
            if re.search(rule.pattern, text):
                assert any(all(g in text.lower() for g in c) for c in secrets.trigram_query(rule.pattern))


def test_redaction(spark):
    df = table(spark, ["x password=abcdef y " + "a" * 30 + " z", "clean", None])
    found = secrets.scan(df).select("doc_id", secrets.redact(F.col("text"), F.col("spans")).alias("t"))
    assert {r.doc_id: r.t for r in found.collect()} == {0: "x [SECRET] y [SECRET] z", 1: "clean", 2: None}


def test_quality_rules(spark, texts):
    got = rows_of(quality_rules(table(spark, texts)))
    for i, t in enumerate(texts):
        t = t or ""
        x = re.findall(SPACE, t)
        lines = [a for a in t.split("\n") if re.search(SPACE, a)]
        seen = Counter(tuple(x[j : j + 8]) for j in range(len(x) - 7))
        again = {k for j in range(len(x) - 7) if seen[tuple(x[j : j + 8])] > 1 for k in range(j, j + 8)}
        failed = len(x) < 20 or 100 * len(again) > 30 * len(x)
        r = got[i][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(x), sum(map(len, x)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), failed)
        assert not (failed and r.kept)


def test_boilerplate_lines_deplete(spark):
    rng = random.Random(1)
    line = " ".join(f"b{i}" for i in range(40))
    own = [" ".join(f"q{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    texts = [f"{line}\n{t}" for t in own[:20]] + own[20:] + [f"{line.upper()}\n{i}" for i in range(3)] + [own[0]] * 30
    got = rows_of(quality_rules(table(spark, texts, ids=[*range(43), *[43] * 30]), line_most=5))
    assert all(got[i][0].kept and got[i][0].n_line_words == 40 for i in range(20))
    assert not any(got[i][0].kept for i in range(40, 43)), "only boilerplate is left"
    assert len(got[43]) == 30 and all(r.kept for r in got[43]), "repeated rows are one document"


def test_documents_of_one_line_are_depleted(spark):
    line = " ".join(f"b{i}" for i in range(40))
    got = quality_rules(table(spark, [line] * 200)).collect()
    assert all(r.n_line_words == 40 and not r.kept and not r.base_failed for r in got), "copies of other ids are documents of their own"
    alone = quality_rules(table(spark, [line] * 200, ids=[None] * 200)).collect()
    assert all(r.n_line_words == 0 and r.kept for r in alone), "documents of null id are told apart by text"


def parity(n=10):
    """Two texts whose polynomial hashes modulo 2**64 agree for every odd base."""
    text = "a"
    for _ in range(n):
        text += text.translate(str.maketrans("ab", "ba"))
    return text, text.translate(str.maketrans("ab", "ba"))


def test_parity_sequences_are_told_apart(spark):
    x, y = parity()
    got = rows_of(jaccard_components(table(spark, [x, y, x])))
    assert [got[i][0].component_id for i in range(3)] == [0, 1, 0]
    got = rows_of(quality_rules(table(spark, [f"{x}\n{y}", f"{x}\n{y}\n{x}"])))
    assert [got[i][0].n_dup_lines for i in range(2)] == [0, 1]
    words = [" ".join(t) for t in parity(11)]
    got = rows_of(suffix_dedup(table(spark, words), width=3000, gram=64))
    assert [got[i][0].n_removed for i in range(2)] == [0, 0]
    got = rows_of(substring_dedup(table(spark, words), width=1500, gram=12))
    assert [got[i][0].n_removed for i in range(2)] == [0, 0]


@pytest.mark.parametrize("bits", [2, 6])
def test_clashing_names_of_sets(spark, texts, bits):
    want = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(table(spark, texts)).collect())
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(table(spark, texts), name_bits=bits).collect()) == want


def test_keys_of_linked_sets_meet():
    rng = np.random.default_rng(3)
    tried = 0
    while tried < 1500:
        percent, n = int(rng.choice([60, 80, 90])), int(rng.choice([1, 2, 3, 5, 8, 12, 20, 40, 100]))
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        y = np.concatenate([x[int(rng.integers(0, n // 3 + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, n // 3 + 1))).astype(np.uint64)])
        both = np.intersect1d(x, y).size
        if y.size and 100 * both >= percent * (x.size + y.size - both):
            keys = [{int(h) for q in jaccard_join._size_classes(s.size, percent) for h in jaccard_join.class_keys(s, q, percent)} for s in (x, y)]
            assert keys[0] & keys[1]
            tried += 1


def test_unlinked_sets_with_frequent_tokens_make_few_pairs(spark, monkeypatch):
    """400 texts of 60 passages each out of 120: every token is frequent and hardly any pair links."""
    rng = random.Random(11)
    passages = [" ".join(f"p{i}w{j}" for j in range(6)) for i in range(120)]
    texts = [" ".join(rng.sample(passages, 60)) for _ in range(400)]
    seen = []
    add = jaccard_join._Links.add
    monkeypatch.setattr(jaccard_join._Links, "add", lambda self, pairs: (seen.append(pairs.count()), add(self, pairs)))
    got = {r.doc_id: r.component_id for r in jaccard_components(table(spark, texts), size=1, percent=80, rare=16).collect()}
    sets = [set(t.split()) for t in texts]
    linked = [(i, j) for i in range(400) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    assert not linked and all(i == c for i, c in got.items())
    assert sum(seen) <= 2 * len(texts), f"{seen} of {400 * 399 // 2} pairs"


@pytest.mark.parametrize("size, holders", [(600, 12), (8, 6), (3, 3)])
def test_lines_repeated_in_hot_and_small_hosts(spark, size, holders):
    rng = random.Random(size)
    own = [" ".join(f"q{rng.randrange(10**6)}" for _ in range(40)) for _ in range(size)]
    texts = [f"{t}\nAll  rights reserved" if i < holders else f"{t}\nquoted twice" if i < holders + 2 else t for i, t in enumerate(own)]
    got = rows_of(quality_rules(table(spark, texts)))
    assert [got[i][0].n_line_words for i in range(size)] == [3 if i < holders else 0 for i in range(size)]
    assert all(got[i][0].kept for i in range(size))


def test_pipeline_cuts_lines_above_the_limit(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    own = [" ".join(f"q{rng.randrange(10**6)}" for _ in range(40)) for _ in range(30)]
    texts = [f"Top line\n{t}\n\n top LINE\nend {i}\n" if i < 15 else f"{t}\n\nend {i}\n" for i, t in enumerate(own)] + ["Top line\n" * 12 + "one two three", None]
    got = {r.doc_id: r for r in pipeline.quality(spark, table(spark, texts).drop(*CLASHING), "").collect()}
    assert sorted(got) == list(range(30)), "a depleted and an empty text go"
    assert all(got[i].text == f"{own[i]}\n\nend {i}\n" and got[i].n_chars == len(got[i].text) for i in range(30))


def test_quality_classifier(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choice("abcdefghij") * rng.randint(2, 6) for _ in range(rng.randint(30, 90))).capitalize() + "." for _ in range(150)]
    bad = [" ".join(["SPAM!!"] * rng.randint(20, 60)) for _ in range(150)]
    df = table(spark, good + bad + ["", None])
    features = quality_classifier.document_statistics(df)
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1] + [(7, None)], "doc_id long, quality int")
    forest = quality_classifier.train(features, labels)
    got = {r.doc_id: r.score for r in quality_classifier.score(features, forest).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i < 150) for i in held]) > 0.95 and len(got) == 302 and 0 <= got[300] <= 1
    empty = quality_classifier.train(features.limit(0), labels)
    assert {round(r.score, 6) for r in quality_classifier.score(features, empty).collect()} == {0.5}


def test_forest_matches_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    forest = quality_classifier.fit_forest(x, ((x[:, 0] * x[:, 1]) > 0).astype(float), trees=15, depth=3)

    def walk(row):
        total = forest.base
        for node in forest.roots:
            while forest.feature[node] >= 0:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x), [walk(r) for r in x])


def plain_tree(x, cuts, g, h, depth, least, ridge):
    """One boosted tree by trying every cut of every feature in every node."""
    best, at = 1e-6, None
    if depth:
        for f, values in enumerate(cuts):
            for t in values:
                left = x[:, f] <= t
                if min(left.sum(), (~left).sum()) >= least:
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + ridge) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + ridge)
                    if gain > best + 1e-9:
                        best, at = gain, (f, t)
    if at is None:
        value = -0.15 * g.sum() / (h.sum() + ridge)
        return lambda row: value
    left = x[:, at[0]] <= at[1]
    below = [plain_tree(x[s], cuts, g[s], h[s], depth - 1, least, ridge) for s in (left, ~left)]
    return lambda row: below[0 if row[at[0]] <= at[1] else 1](row)


def test_forest_fits_as_plain_trees_do():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 4)).astype(np.float32)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=240) / 2) > 0).astype(float)
    forest = quality_classifier.fit_forest(x, y, trees=6, depth=3, bins=12)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 13)[1:-1]).astype(np.float32)) for c in x.T]
    raw = np.full(240, np.log((y.sum() + 0.5) / (241 - y.sum() - 0.5)))
    for _ in range(6):
        p = 1 / (1 + np.exp(-raw))
        tree = plain_tree(x, cuts, p - y, p * (1 - p), 3, 10, 1.0)
        raw = raw + np.array([tree(r) for r in x])
    assert np.allclose(forest.score(x), 1 / (1 + np.exp(-raw)), atol=1e-6)


def test_held_out_is_never_null(spark, odd, tmp_path):
    from tidewater.llm import queries

    odd.drop("domain").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "other words here"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, query in queries.QUERIES.items():
        rows = query(spark, str(tmp_path)).collect()
        if "held_out" in (rows[0] if rows else ()):
            assert len(rows) == odd.count() and all(r.held_out in (True, False) and 0 <= r.score <= 1 for r in rows), name


def test_language_mixture(spark):
    rng = random.Random(2)
    speak = {"aa": "abcde", "bb": "vwxyz", "cc": "éèàüö"}
    say = lambda lang, n: " ".join("".join(rng.choice(speak[lang]) for _ in range(4)) for _ in range(n))
    train = [(i, say(lang, 60), lang) for i, lang in enumerate(list(speak) * 10)] + [(99, "none", None)]
    counts = language_id.gram_counts(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert list(counts) == ["aa", "bb", "cc"]
    cases = [say("aa", 50), say("cc", 40).upper(), say("aa", 60) + " " + say("bb", 30), "123 !!", "", None, "€…", "a"]
    got = {r.doc_id: r for r in language_id.identify(table(spark, cases), counts).collect()}
    assert [got[i].lang_pred for i in range(7)] == ["aa", "cc", "aa", "und", "und", "und", "und"]
    assert set(got[2].shares) == {"aa", "bb"} and abs(got[2].score - 2 / 3) < 0.05 and set(got[0].shares) == {"aa"}
    assert {r.lang_pred for r in language_id.identify(table(spark, cases), {}).collect()} == {"und"}


def test_mixtures_against_all_sets_of_languages():
    """Forward choice against every set of up to three languages under the same penalty, each fitted at length."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.full(40, 0.15), 5)
    counts = {f"l{i}": np.bincount(rng.choice(40, 4000, p=p[i]), minlength=language_id.BUCKETS) for i in range(5)}
    likelihoods = np.stack([(n + 0.5) / (n.sum() + 0.5 * language_id.BUCKETS) for n in counts.values()], 1)
    agreed = 0
    for trial in range(30):
        true = rng.choice(5, 1 + trial % 3, replace=False)
        share = rng.dirichlet(np.full(true.size, 8.0))
        grams = np.concatenate([rng.choice(40, int(600 * s), p=p[i]) for i, s in zip(true, share, strict=True)])
        n = np.bincount(grams, minlength=language_id.BUCKETS)
        best = (-np.inf, None, None)
        for size in (1, 2, 3):
            for chosen in itertools.combinations(range(5), size):
                pi = np.full(size, 1 / size)
                for _ in range(60):
                    pi = pi * ((n / (likelihoods[:, chosen] @ pi)) @ likelihoods[:, chosen]) / n.sum()
                value = n @ np.log(likelihoods[:, chosen] @ pi) - size * 2.0 * np.log(grams.size)
                best = max(best, (value, [f"l{i}" for i in chosen], pi.tolist()))
        got = {size: language_id.shares(grams, [lambda b=b: b for b in language_id.blocks_of(counts, size)]) for size in (128, 2, 1)}
        assert all(x.keys() == got[128].keys() and np.allclose(list(x.values()), list(got[128].values())) for x in got.values()), "blocks change nothing"
        if sorted(got[128]) == best[1]:
            agreed += 1
            assert np.allclose([got[128][x] for x in best[1]], best[2], atol=0.05)
    assert agreed >= 28


def test_more_languages_than_a_block(spark):
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    speak = {f"x{i:03d}": rng.sample(letters, 3) for i in range(300)}
    say = lambda lang, n: " ".join("".join(rng.choices(speak[lang], [6, 3, 1])[0] for _ in range(4)) for _ in range(n))
    docs = spark.createDataFrame([(i, say(x, 80), x) for i, x in enumerate([*speak, *speak])], "doc_id long, text string, lang string")
    counts = language_id.gram_counts(docs)
    assert list(counts) == sorted(speak)
    some = docs.where("doc_id % 60 = 7")
    whole = {r.doc_id: (r.lang_pred, r.lang, r.score) for r in language_id.identify(some, counts).join(some.select("doc_id", "lang"), "doc_id").collect()}
    assert len(whole) == 10 and all(x == y for x, y, _ in whole.values()), "languages beyond one block are found"


def test_toxicity(spark):
    rng = random.Random(4)
    plain = [" ".join(f"w{rng.randrange(300)}" for _ in range(40)) + "." for _ in range(200)]
    texts = [t if i % 4 else t.replace("w7", "w8") + f" you {rng.choice(['grobix', 'grobian', 'zonker'])}." for i, t in enumerate(plain)]
    df = table(spark, texts + ["", None])
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200) if fold(i) != 1], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(200) if fold(i) == 1) and got[200] < 0.7 and len(got) == 202
    unlearned = toxicity.train(df.limit(0), labels)
    assert toxicity.score(df, unlearned).count() == 202


def test_stems_of_a_language_with_few_toxic_rows(spark):
    rng = random.Random(6)
    plain = [" ".join(f"w{rng.randrange(300)}" for _ in range(12)) for _ in range(3000)]
    rows = [(f"{t} grobian" if i < 295 else f"{t} zurrado" if i < 300 else t, int(i < 300)) for i, t in enumerate(plain)]
    stems = toxicity.learn_stems(spark.createDataFrame(rows, "text string, y int"))
    assert set(stems.tolist()) == {toxicity.stem_hash(w, n) for w in ("grobian", "zurrado") for n in (0, 4, 6)}


def test_chance_of_a_stem():
    got = toxicity.chance(np.array([0, 2, 3]), np.array([2, 1, 0]), 4, 10)
    assert np.allclose(got, [1, 4 / 120 + 36 / 120, 4 / 120])


def plain_event(words):
    """The gravest event of a clause, rule by rule."""
    o, i, h, t, n, r = range(6)
    grave, last, found = list(grammar.EVENTS), None, []
    near = lambda c, a, b: any(words[x] == c for x in range(max(a, 0), min(b, len(words))))
    heap = pending = -1  # the last words that a plain insult and a threat reach
    for x, c in enumerate(words):
        denied = near(n, x - 3, x)
        reported = near(r, x - 8, x) or near(r, x + 1, x + 9)
        if c == i:
            aimed = near(t, x - 4, x) or near(t, x + 1, x + 3)
            found.append("denied" if denied else "reported" if reported else "aimed" if aimed else "heaped" if x <= heap else "insult")
            heap = x + 4 if not denied and not reported else heap
        if c == h and not denied and not reported:
            pending = x + 4
            if near(t, x - 4, x):
                found.append("menace")
        if c == t and x <= pending:
            found.append("threat")
            pending = -1
    return max((grave.index(e) + 1 for e in found), default=0)


def test_clause_grammar():
    rng = random.Random(7)
    clauses = [[rng.choices(range(6), [8, 2, 1, 2, 1, 1])[0] for _ in range(rng.choice([1, 3, 8, 20, 60]))] for _ in range(1500)]
    got = grammar.clause_events(np.array([w for c in clauses for w in c], np.int8), np.repeat(np.arange(len(clauses)), [len(c) for c in clauses]))
    assert got.tolist() == [plain_event(c) for c in clauses]
    o, i, h, t, n, r = range(6)
    name = lambda c: [None, *grammar.EVENTS][plain_event(c)]
    assert name([o, i]) == "insult" and name([t, o, i]) == "aimed" and name([n, o, i]) == "denied" and name([r, o, o, i]) == "reported" and name([t, i, o, r]) == "reported"
    assert name([h, o, t]) == "threat" and name([h, o]) is None and name([n, h, t]) is None and name([o]) is None and name([t, h]) == "menace"
    assert name([n, o, o, o, i]) == "insult", "negation does not reach further than three words"


def test_weights_follow_a_plain_descent():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (300, len(grammar.EVENTS))).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(2 - x[:, 3] - 2 * x[:, 6]))).astype(float)
    base, weights = toxicity.fit_weights(x, y)
    prior = np.array([toxicity.PRIOR_BASE, *grammar.EVENTS.values()])
    design, w = np.column_stack([np.ones(300), x]), prior.copy()
    for _ in range(20_000):
        w -= 0.004 * (design.T @ (1 / (1 + np.exp(-design @ w)) - y) + 0.5 * (w - prior))
    assert np.allclose([base, *weights], [w[0], *np.maximum(w[1:], 0)], atol=1e-3)


def test_mixing_follows_weights(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "en" if i % 3 else None, f"src{i % 5}", 0) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("key", F.lit("clash"))
    got = mixing.mix(df, ["lang", "source"], {"lang": {"en": 3}, "source": {"src0": 0}}, F.expr("total div 2")).collect()
    total = sum(1 + i % 7 for i in range(900))
    tokens = defaultdict(int)
    for r in got:
        tokens[r.lang, r.source] += r.n_tokens * r.copies
    assert not any(s == "src0" for _, s in tokens) and sum(tokens.values()) <= total // 2
    for (lang, _), n in tokens.items():
        assert 0 <= total // 2 * (3 if lang == "en" else 1) / 16 - n <= 9
    scarce = mixing.mix(df, ["lang", "source"], {"lang": {"en": 1000}}, F.expr("total * 100"), max_epochs=3).collect()
    assert {r.copies for r in scarce} == {3} and len(scarce) == 900, "all capacity is used when the target is beyond it"


def test_leaves_left_out_hold_nothing(spark):
    duckdb = pytest.importorskip("duckdb")
    leaves = [("a", "x", 20), ("a", "z", 980), ("b", "y", 1000)]
    weights = {"s": {"z": 0}}
    got = mixing.budgets(spark.createDataFrame(leaves, "d string, s string, available long"), ["d", "s"], weights, F.expr("500L"), 1)
    assert {(r.d, r.s): r.budget for r in got.collect()} == {("a", "x"): 20, ("b", "y"): 480}
    docs = spark.createDataFrame([(i, d, s, "w " * 10) for i, (d, s, n) in enumerate((d, s, n) for d, s, n in leaves for _ in range(n // 10))], "doc_id long, d string, s string, text string")
    chosen = sorted((r.doc_id, r.copies) for r in mixing.mix(docs, ["d", "s"], weights, F.expr("500L"), max_epochs=1).collect())
    assert sum(1 for i, _ in chosen if i >= 100) == 48 and sum(1 for i, _ in chosen if i < 2) == 2 and len(chosen) == 50
    con = duckdb.connect()
    con.register("docs", docs.toArrow())
    sql = mixing.mix_sql("SELECT * FROM docs", ["d", "s"], weights, "500", max_epochs=1)
    assert sorted(con.execute(f"SELECT doc_id, copies FROM ({sql})").fetchall()) == chosen


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000)]
    got = mixing.budgets(spark.createDataFrame(leaves, "d string, s string, available long"), ["d", "s"], {}, F.expr("1000L"), 1)
    assert {(r.d, r.s): r.budget for r in got.collect()} == {("a", "x"): 10, ("a", "y"): 490, ("b", "z"): 500}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, repeated rows, empty and very long texts."""
    rows = [(None, None, None, None, None), (1, "same text " * 30, "en", None, 5), (1, "same text " * 30, "en", None, 5), (None, "same text " * 30, None, "s", None), (2, "", "fr", "s", 0), (1, "other words here", "en", "s", 1), (3, "very long " * 100_000, "en", "s", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("domain", F.lit(None).cast("string"))


OPERATORS = {
    "suffix": lambda d: suffix_dedup(d),
    "substring": lambda d: substring_dedup(d),
    "jaccard": lambda d: jaccard_components(d),
    "rules": lambda d: quality_rules(d),
    "secrets": lambda d: secrets.scan(d),
    "decontaminate": lambda d: decontaminate(d, d.sparkSession.createDataFrame([(1, "other words here"), (None, "x"), (2, None)], "item_id long, text string")),
    "language": lambda d: language_id.identify(d, language_id.gram_counts(d)),
    "statistics": lambda d: quality_classifier.document_statistics(d),
    "toxicity": lambda d: toxicity.score(d, toxicity.train(d, d.select("doc_id", F.lit(None).cast("int").alias("toxic")))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd, name):
    assert OPERATORS[name](odd).count() == odd.count()
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_odd_rows_mix(spark, odd):
    got = mixing.mix(odd, ["domain", "lang", "source"], {}, F.expr("total"))
    total = odd.select(F.sum(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")))).first()[0]
    rows = got.collect()
    assert sum(r.n_tokens * r.copies for r in rows) <= total and all(1 <= r.copies <= 4 and r.n_tokens > 0 for r in rows)
    assert [r.copies for r in rows if r.lang == "\0"] == [4], "a leaf beyond its capacity gives all epochs"
    assert mixing.mix(odd.limit(0), ["lang"], {}, F.expr("total")).count() == 0


def test_repeated_rows_repeat_everything(spark, odd):
    got = [r for r in suffix_dedup(odd).collect() if r.n_bytes == 300]
    assert len(got) == 3 and all(r.n_removed == 300 for r in got)
    parts = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(odd).collect()}
    assert (None, 2, 1) in parts and (None, 0, None) in parts


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    say = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    clean = [say(60) for _ in range(40)]
    item = say(30)
    near = clean[0].split()
    near[-1] = "changed"
    texts = [*clean, clean[1], " ".join(near), "too short", f"{say(40)} {item} {say(5)}", f"{say(40)} password=abcdef123 {say(5)}"]
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(texts)] + [(1, clean[1], "en", "src1", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert sorted(docs.columns) == ["doc_id", "lang", "n_chars", "source", "text"], name
        kept.append(sorted(r.doc_id for r in docs.collect()))
    everything = sorted([*range(45), 1])
    assert kept[0] == [i for i in everything if i != 42]
    assert kept[1] == [i for i in range(45) if i not in (40, 41, 42)]
    assert kept[2] == [i for i in kept[1] if i != 43] == kept[3]
    secret = docs.where("doc_id = 44").first()
    assert "[SECRET]" in secret.text and "abcdef123" not in secret.text and secret.n_chars == len(secret.text)
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r.doc_id for r in out} <= set(kept[3]) and all(r.copies >= 1 for r in out)
