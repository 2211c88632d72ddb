"""Mixing sources to target weights by hierarchical budgeting.

Leaves are the paths of a tree (domain, language, source). A total budget of tokens goes down
the tree by weight. A leaf can give max_epochs times its tokens; what a child cannot take goes
to its siblings by weight first, and only what no sibling can take goes back to the parent's
siblings. In a leaf the rows of epoch 0, 1, ... come in an order seeded by (seed, epoch), and
the leaf's budget is spent on the prefix of that order.

The tree stays in tables, one step for each level; siblings share out together, by numbers alone.
Prefixes need no order of a whole leaf: the place where a leaf's budget ends is found by its
order key's bits, FAN ranges at a time, each round summing the range in which it ends, until
that range holds few rows. Only those are ordered, so a leaf that holds a third of all rows
does not meet in one task. What comes out is one cut in the order for each leaf, so that texts
are never shuffled while the leaves are few enough to go round: texts are read once to count and
once to select.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

#: Leaves that may go round to all tasks (some 100 bytes each); more are joined by shuffling.
BROADCAST_LEAVES = 100_000
#: Bits of the order key that a round looks at, and rows of a leaf that are ordered at once.
BITS, ORDERED = 8, 1_000

def share(total: int, nodes: list[tuple[float, int]]) -> list[int]:
    """Whole tokens for (weight, capacity) siblings: by weight, shortages to those with room.

    Rounds go on until the total is spent or nobody has room. Rest tokens of rounding go to the
    first nodes with room, in the order given. Nodes of weight 0 get what no other can take.
    """
    got = [0] * len(nodes)
    left = min(total, sum(c for _, c in nodes))
    for positive in (True, False):
        while left:
            free = [i for i, (w, c) in enumerate(nodes) if got[i] < c and (w > 0) == positive]
            if not free:
                break
            sum_w = sum(nodes[i][0] if positive else 1 for i in free)
            parts = [min(nodes[i][1] - got[i], int(left * (nodes[i][0] if positive else 1) / sum_w)) for i in free]
            if not any(parts):
                for i in free[:left]:
                    got[i] += 1
                left -= min(left, len(free))
                continue
            for i, p in zip(free, parts, strict=True):
                got[i] += p
            left -= sum(parts)
    return got


def _give(weights: dict[tuple, float]):
    def run(table: pa.Table) -> pa.Table:
        """The budgets of a node's children."""
        rows = list(zip(*[table.column(c).to_pylist() for c in ("node", "capacity", "budget")], strict=True))
        rows.sort(key=lambda r: (json.loads(r[0])[-1] is None, json.loads(r[0])[-1] or ""))
        got = share(rows[0][2], [(weights.get(tuple(json.loads(n)), 1.0), c) for n, c, _ in rows])
        return pa.table({"node": pa.array([r[0] for r in rows], pa.string()), "budget": pa.array(got, pa.int64())})

    return run


def budgets(leaves: DataFrame, total: int, depth: int, weights: dict[tuple, float], max_epochs: int = 1) -> DataFrame:
    """(node, budget) of the leaves (node: a JSON array of names, tokens). weights: by path
    prefix; a path that is not named weighs 1."""
    spark = leaves.sparkSession

    def prefix(k: int) -> Column:
        return F.to_json(F.slice(F.from_json("node", "array<string>"), 1, k))

    above = spark.createDataFrame([("[]", total)], "parent string, budget long")
    for k in range(1, depth + 1):
        nodes = leaves.select(prefix(k - 1).alias("parent"), prefix(k).alias("child"), (F.col("tokens") * max_epochs).alias("capacity"))
        nodes = nodes.groupBy("parent", F.col("child").alias("node")).agg(F.sum("capacity").alias("capacity")).join(above, "parent")
        below = materialise(nodes.groupBy("parent").applyInArrow(_give(weights), "node string, budget long"), "budgets")
        above = below.withColumnRenamed("node", "parent")
    return below


#: Words of `text`, the tokens that budgets are counted in.
WORDS = r"coalesce(regexp_count({0}, '[^ \\t\\n\\x0B\\f\\r]+'), 0)"


def mix(
    docs: DataFrame,
    levels: dict[str, str],
    weights: dict[tuple, float] | None = None,
    total: int | None = None,
    fraction: float = 0.8,
    max_epochs: int = 1,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows of docs that the budget pays for, once for each epoch, with all their columns and
    mix_epoch (0, 1, ...), mix_tokens (words of the text), mix_budget (of the leaf).

    levels: SQL expressions over docs by level name, from the root down; null is a value of its
    own. total: tokens to spend; None takes `fraction` of all. A row is taken if the tokens
    before it in its leaf's order are less than the budget, so the last one may overshoot by
    less than itself, however long its text. A leaf whose texts have no word gives all its rows
    once, whatever the budget. Equal rows share their place in the order and come or stay away
    together. Null texts have no words. An empty table gives none. Columns of docs named like
    ours are replaced.
    """
    if not levels:
        raise ValueError("levels: at least one is needed")
    ours = ("mix_epoch", "mix_tokens", "mix_budget")
    docs = docs.drop(*ours)
    own, words = docs.columns, F.expr(WORDS.format(f"cast(`{text_col}` as string)")).cast("long")
    leaf_of = F.to_json(F.array(*[F.expr(e).cast("string") for e in levels.values()]))
    row_of = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"))
    tagged = docs.select("*", leaf_of.alias("__node"), row_of.alias("__row"))
    rows = materialise(tagged.select(F.col("__node").alias("node"), F.col("__row").alias("row"), words.alias("tokens")), "tokens")
    leaves = materialise(rows.groupBy("node").agg(F.sum("tokens").alias("tokens")), "leaves")
    sums = leaves.agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).first()
    few = sums["n"] <= BROADCAST_LEAVES
    if total is None:
        total = int((sums["tokens"] or 0) * fraction)
    plan = leaves.join(budgets(leaves, total, len(levels), weights or {}, max_epochs), "node")
    full = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(1).alias("full")
    need = F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0).alias("need")
    plan = materialise(plan.select("node", "budget", full, need), "plan")
    cuts = _cuts(rows, plan.where("need > 0").select("node", "full", "need"), seed, few)
    plan = plan.join(cuts, "node", "left").select(F.col("node").alias("__leaf"), F.col("budget").alias("__budget"), F.col("full").alias("__full"), "__cut", "__last")

    out = tagged.join(F.broadcast(plan) if few else plan, F.col("__node") == F.col("__leaf"))
    key = _key(seed, F.col("__full"), F.col("__row"))
    part_of = (key < F.col("__cut")) | ((key == F.col("__cut")) & (F.col("__row") <= F.col("__last")))
    out = out.withColumn("__times", F.col("__full") + F.coalesce(part_of.cast("long"), F.lit(0))).where("__times > 0")
    if max_epochs > 1:
        out = out.withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1)))
    else:
        out = out.withColumn("__epoch", F.lit(0).cast("long"))
    more = zip((F.col("__epoch"), words, F.col("__budget")), ours, strict=True)
    return out.select(*[F.col(f"`{c}`") for c in own], *[e.alias(k) for e, k in more])


def _key(seed: int, epoch: Column, row: Column) -> Column:
    """A row's place in an epoch's order."""
    return F.xxhash64(F.lit(seed), epoch, row)


def _cuts(rows: DataFrame, leaves: DataFrame, seed: int, few: bool) -> DataFrame:
    """(node, __cut, __last): the order key and row of the last row that the partly paid epoch of
    each leaf (node, full, need) takes. A leaf that takes none is left out."""
    state = materialise(leaves.withColumns({"before": F.lit(0).cast("long"), "range": F.lit(0).cast("long")}), "range")
    bits = 0
    while True:
        # Unsigned, the flipped key sorts like the signed one; its upper bits name the range.
        part = rows.join(F.broadcast(state) if few else state, "node").withColumn("key", _key(seed, F.col("full"), F.col("row")))
        flipped = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
        if bits:
            part = part.where(F.shiftrightunsigned(flipped, 64 - bits) == F.col("range"))
        if bits and (bits + BITS > 64 or (state.agg(F.max("rows")).first()[0] or 0) <= ORDERED):
            break
        bits += BITS
        sums = part.groupBy("node", "full", "need", "before", F.shiftrightunsigned(flipped, 64 - bits).alias("range")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
        up_to = Window.partitionBy("node").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # 2^BITS rows at most
        sums = sums.withColumn("before", F.col("before") + F.coalesce(F.sum("tokens").over(up_to), F.lit(0)))
        ends = sums.where("before < need and before + tokens >= need")  # one for each leaf
        state = materialise(ends.select("node", "full", "need", "before", "range", "rows"), "range")
    edge = part.groupBy("node", "before", "need", "key", "row").agg(F.sum("tokens").alias("tokens"))
    order = Window.partitionBy("node").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, -1)  # ORDERED rows, or those of one key
    edge = edge.withColumn("sum", F.col("before") + F.coalesce(F.sum("tokens").over(order), F.lit(0))).where("sum < need")
    last = edge.groupBy("node").agg(F.max(F.struct("key", "row")).alias("x"))
    return last.select("node", F.col("x.key").alias("__cut"), F.col("x.row").alias("__last"))
