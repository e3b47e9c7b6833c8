"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Leaves are the paths of the level columns, such as domain, language, source. From the root down, a node's budget is
dealt to its children by weight; a child whose subtree holds less keeps what it holds, and its
shortage goes to its siblings by their weights. Only what a whole family cannot hold reaches the next
ancestor's children. A leaf takes its budget as whole epochs and a token-prefix of the next seeded epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Words of a text, counted as its tokens.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a leaf that one task orders, about; leaves are cut by their seeded order into at most ``MAX_BUCKETS`` buckets.
BUCKET_ROWS = 500
MAX_BUCKETS = 1 << 16


def _weight(weights: dict[str, int], column: str) -> Column:
    out = F.lit(1).cast("long")
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(w).cast("long")).otherwise(out)
    return out


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], target: Column, max_epochs: int) -> DataFrame:
    """Adds budget to each leaf (level columns, available: its tokens). ``target`` may use total, all tokens.

    At each node, level = the water level: the largest of (budget - capacity of the first i children) / (weight of the others),
    children by capacity over weight; a child gets the smaller of its capacity and weight * level.
    """
    whole = Window.partitionBy()  # over the children of the root, a row for each value of the first level
    nodes = leaves.groupBy(*levels).agg(F.sum("available").alias("available"))  # a row for each leaf, not for each text
    tree = nodes
    for c in levels:  # a leaf that a weight of 0 leaves out at any level can hold nothing
        tree = tree.where(_weight(weights.get(c, {}), c) > 0)
    for depth in range(1, len(levels) + 1):
        family = Window.partitionBy(*levels[:depth])
        tree = tree.withColumn(f"capacity{depth}", F.sum(F.col("available") * max_epochs).over(family))
    parent = nodes.agg(F.sum("available").alias("total")).select(target.cast("long").alias("budget"))
    for depth in range(1, len(levels) + 1):
        path = levels[:depth]
        children = tree.groupBy(*path).agg(F.first(f"capacity{depth}").alias("capacity")).withColumn("w", _weight(weights.get(path[-1], {}), path[-1]))
        children = children.join(parent, path[:-1]) if depth > 1 else children.crossJoin(F.broadcast(parent))  # one row
        order = (Window.partitionBy(*path[:-1]) if depth > 1 else whole).orderBy(F.col("capacity") / F.col("w"), path[-1])
        before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
        children = children.withColumn("line", (F.col("budget") - before).cast("double") / rest)
        level = F.max("line").over(Window.partitionBy(*path[:-1]) if depth > 1 else whole)
        parent = children.withColumn("level", level).select(*path, F.floor(F.least(F.col("capacity").cast("double"), F.greatest(F.lit(0.0), F.col("w") * F.col("level")))).cast("long").alias("budget"))
    return nodes.join(parent, levels)


def mix(docs: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], target: Column, id_col: str = "doc_id", text_col: str = "text", max_epochs: int = 4, seed: int = 17) -> DataFrame:
    """Choose texts so that the leaves' tokens follow the weights.

    ``weights`` gives, for each level column, whole-number weights by value; a value not named weighs 1, one of weight 0 is left out.
    ``target`` is an expression of total (all tokens). Returns a row for each chosen row of ``docs``: its id, the levels, n_tokens and
    copies (how many epochs hold it, ``max_epochs`` at most). In an epoch a leaf's rows stand by md5 of seed, epoch and id (ties: by tokens); the
    last epoch is cut at the last row with which the budget is not passed. Texts without words, null ones too, are never
    chosen; a null level value is a value of its own, ``\\0``; repeated rows count each; other columns are ignored.
    """
    tokens = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = written(docs.select(F.col(id_col).alias("id"), *(F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(c) for c in levels), tokens.alias("n_tokens")).where("n_tokens > 0"), "mixing")
    leaves = rows.groupBy(*levels).agg(F.sum("n_tokens").alias("available"), F.count("*").alias("rows"))
    given = budgets(leaves, levels, weights, target, max_epochs).select(*levels, "budget")
    plan = leaves.join(given, levels).select(*levels, F.expr("budget div available").alias("epochs"), F.expr("budget % available").alias("rest"), F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("rows") / BUCKET_ROWS)).alias("buckets"))
    plan = written(plan, "mixing-plan")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("epochs") + 1).cast("string"), F.col("id").cast("string")))
    placed = rows.join(plan, levels).withColumn("key", key)
    placed = placed.withColumn("bucket", F.expr("cast(conv(substr(key, 1, 4), 16, 10) as bigint) * buckets div 65536"))
    sums = placed.groupBy(*levels, "bucket").agg(F.sum("n_tokens").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*levels, "bucket", before.alias("before"))
    order = Window.partitionBy(*levels, "bucket").orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(offsets, [*levels, "bucket"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(order))
    copies = F.col("epochs") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)
    return ranked.select(F.col("id").alias(id_col), *levels, "n_tokens", copies.cast("long").alias("copies")).where("copies > 0")


def mix_sql(docs_sql: str, levels: list[str], weights: dict[str, dict[str, int]], target_sql: str, id_col: str = "doc_id", max_epochs: int = 4, seed: int = 17) -> str:
    """The same choice as one DuckDB query over ``docs_sql`` (id, levels, text)."""
    ctes = [f"""rows_ AS (SELECT * FROM (SELECT {id_col} AS id, {", ".join(f"coalesce({c}, chr(0)) AS {c}" for c in levels)}, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM ({docs_sql}) AS d) AS r WHERE n_tokens > 0)""", f"leaves AS (SELECT {', '.join(levels)}, sum(n_tokens)::BIGINT AS available FROM rows_ GROUP BY ALL)"]
    weight = {c: f"(CASE{''.join(f' WHEN {c} = {chr(39)}{v}{chr(39)} THEN {w}' for v, w in weights[c].items())} ELSE 1 END)::BIGINT" if weights.get(c) else "1::BIGINT" for c in levels}
    ctes.append(f"tree AS (SELECT * FROM leaves WHERE {' AND '.join(f'{w} > 0' for w in weight.values())})")
    parent = f"(SELECT ({target_sql})::BIGINT AS budget FROM (SELECT sum(available)::BIGINT AS total FROM leaves) AS t)"
    for depth in range(1, len(levels) + 1):
        path, up = levels[:depth], levels[: depth - 1]
        part = f"PARTITION BY {', '.join(up)} " if up else ""
        join = f"JOIN b{depth - 1} USING ({', '.join(up)})" if up else f"CROSS JOIN {parent} AS p"
        ctes.append(f"c{depth} AS (SELECT * FROM (SELECT {', '.join(path)}, (sum(available) * {max_epochs})::BIGINT AS capacity, {weight[path[-1]]} AS w FROM tree GROUP BY {', '.join(path)}) AS x {join})")
        ctes.append(f"l{depth} AS (SELECT *, (budget - coalesce(sum(capacity) OVER ({part}ORDER BY capacity::DOUBLE / w::DOUBLE, {path[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / (sum(w) OVER ({part}ORDER BY capacity::DOUBLE / w::DOUBLE, {path[-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS line FROM c{depth})")
        ctes.append(f"b{depth} AS (SELECT {', '.join(path)}, floor(least(capacity::DOUBLE, greatest(0.0::DOUBLE, w::DOUBLE * max(line) OVER ({part}))))::BIGINT AS budget FROM l{depth})")
    last = f"b{len(levels)}"
    ctes.append(f"plan AS (SELECT {', '.join(levels)}, budget // available AS epochs, budget % available AS rest FROM leaves JOIN {last} USING ({', '.join(levels)}))")
    ctes.append(f"ranked AS (SELECT r.*, epochs, rest, sum(n_tokens) OVER (PARTITION BY {', '.join('r.' + c for c in levels)} ORDER BY md5('{seed}:' || (epochs + 1)::VARCHAR || ':' || id::VARCHAR), n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM rows_ AS r JOIN plan AS p USING ({', '.join(levels)}))")
    return f"WITH {', '.join(ctes)} SELECT * FROM (SELECT id AS {id_col}, {', '.join(levels)}, n_tokens, (epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM ranked) AS o WHERE copies > 0"
