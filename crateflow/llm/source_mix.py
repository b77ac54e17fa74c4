"""Mixing sources to target weights by hierarchical budgeting over a tree of columns such as domain, language, source.

A node's capacity is the tokens below it times the epochs allowed. From the root down, a node's token budget is dealt to
its children by weight; a child never gets more than its capacity, and what it can't take goes to its siblings by their
weights (water-filling in closed form: children in order of capacity per weight, those below the water level are full).
As capacities count whole subtrees, a shortage leaves a node only if all below it is full; so siblings come before the
ancestors' siblings. A leaf whose budget is e times its tokens plus a rest takes every text e times, and from epoch
e + 1, in the seeded order of that epoch, the prefix whose tokens fit into the rest.

The prefix's end is found by radix: tokens per (leaf, leading bits of the order key) tell the slice in which the rest
runs out, twice with RADIX_BITS bits, then a window sorts that slice alone. So no task sees a whole leaf.
All is integer arithmetic; each node loses less than one token per child to rounding down.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateflow.llm.runtime import durable

KEY_BITS, RADIX_BITS = 48, 12
#: Separates words: the six ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Level:
    """One level of the tree: its column, integer weights by value, and the weight of values not listed (and of null)."""

    column: str
    weights: Mapping[str, int] = field(default_factory=dict)
    default: int = 1

    def weight(self) -> Column:
        found = F.lit(self.default)
        for value, weight in self.weights.items():
            found = F.when(F.col(self.column) == F.lit(value), F.lit(weight)).otherwise(found)
        return found.cast("long")


def count_words(text: Column) -> Column:
    """Words between ASCII blanks; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, BLANKS), lambda w: w != "")), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column, text_mark: Column) -> Column:
    """48 bits of md5 over seed, epoch, id and the first 8 hexadecimal digits of the text's md5."""
    joined = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")), text_mark.cast("string"))
    return F.conv(F.substring(F.md5(joined), 1, KEY_BITS // 4), 16, 10).cast("long")


def _node(levels: Sequence[Level], depth: int) -> list[str]:
    return [f"__n{k}" for k in range(depth)]


def _times(a: str, b: str) -> str:
    return f"(cast({a} as decimal(19,0)) * cast({b} as decimal(19,0)))"


def budgets(sized: DataFrame, levels: Sequence[Level], total: int | float, max_epochs: int) -> DataFrame:
    """A row per leaf: keys __n0.., tokens, budget. sized has the keys, the weights __w0.. and tokens.

    total: tokens to draw, or a share of all tokens if a float.
    """
    depth = len(levels)
    keys, weights = _node(levels, depth), [f"__w{k}" for k in range(depth)]
    leaves = durable(sized.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), *[F.max(w).alias(w) for w in weights]))
    capacity = F.col("tokens") * F.lit(max_epochs)
    whole = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    dealt: DataFrame | None = None
    for k in range(depth):
        parents, here = keys[:k], keys[: k + 1]
        children = leaves.groupBy(*here).agg(F.sum(capacity).alias("c"), F.max(weights[k]).alias("w")).where("w > 0 and c > 0")
        root = F.lit(math.floor(whole * total) if isinstance(total, float) else total).cast("long")
        children = children.join(dealt, parents) if parents else children.withColumn("__b", root)
        order = Window.partitionBy(*parents).orderBy(F.expr("double(c) / double(w)"), keys[k])
        among = Window.partitionBy(*parents)
        before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
        children = children.withColumn("c0", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("w1", F.sum("w").over(after))
        children = children.withColumn("full", F.expr(f"__b >= c0 and {_times('c', 'w1')} <= {_times('(__b - c0)', 'w')}"))
        rest = F.col("__b") - F.coalesce(F.sum(F.when(F.col("full"), F.col("c"))).over(among), F.lit(0))
        open_ = F.sum(F.when(~F.col("full"), F.col("w"))).over(among)
        children = children.withColumn("rest", rest).withColumn("open", open_)
        dealt = children.select(*here, F.expr(f"if(full, c, {_times('rest', 'w')} div open)").cast("long").alias("__b"))
    return leaves.join(dealt, keys, "left").select(*keys, "tokens", F.coalesce("__b", F.lit(0)).alias("budget"))


def _cut(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row per leaf that has a rest: the order key __cut up to which its texts are taken (null: none). rows: keys, tokens, key, rest."""
    state = rows.withColumn("__low", F.lit(0).cast("long"))
    done = 0
    for _ in range(2):
        shift = KEY_BITS - done - RADIX_BITS
        sums = state.groupBy(*keys, "rest", "__low", F.shiftright("key", shift).alias("slice")).agg(F.sum("tokens").alias("t"))
        running = F.sum("t").over(Window.partitionBy(*keys).orderBy("slice"))
        spill = sums.withColumn("upto", running).where("upto > rest").groupBy(*keys).agg(F.min_by("slice", "slice").alias("slice"), F.min_by(F.col("upto") - F.col("t"), "slice").alias("before"))
        state = state.withColumn("slice", F.shiftright("key", shift)).join(spill.withColumnRenamed("slice", "at"), keys).where("slice = at")
        state = state.select(*keys, "tokens", "key", (F.col("rest") - F.col("before")).alias("rest"), "__low")
        done += RADIX_BITS
    upto = F.sum("tokens").over(Window.partitionBy(*keys).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return state.withColumn("upto", upto).where("upto > rest").groupBy(*keys).agg(F.min("key").alias("__cut"))


def mix(docs: DataFrame, levels: Sequence[Level], total: int | float, max_epochs: int = 1, seed: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Adds n_tokens, leaf_tokens, leaf_budget and n_copies (how often the text is drawn; 0: not at all) to every row.

    total: an int is a number of tokens, a float a share of all tokens. A value of a level that is null is a node of its
    own with the level's default weight. Null and empty texts have no tokens and are never drawn; an empty table gives
    an empty table. Rows with the same id and text share one place in the order: they are drawn together or not at all,
    and so are two texts of a leaf whose 48-bit keys agree. Columns named as the four new ones are replaced.
    """
    depth = len(levels)
    keys = _node(levels, depth)
    with_keys = {f"__n{k}": F.concat(F.when(F.col(v.column).isNull(), "n").otherwise("v"), F.coalesce(F.col(v.column).cast("string"), F.lit(""))) for k, v in enumerate(levels)}
    mark = F.substring(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")), 1, 8).alias("__mark")
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("__id"), count_words(F.col(text)).alias("__tokens"), mark]
    marked = docs.select(*whole, *[c.alias(k) for k, c in with_keys.items()], *[v.weight().alias(f"__w{k}") for k, v in enumerate(levels)])  # rows are carried whole, so no name clashes
    sized = durable(marked.select("__id", *keys, F.col("__tokens").alias("tokens"), "__mark", *[f"__w{k}" for k in range(depth)]))
    leaves = budgets(sized, levels, total, max_epochs)
    leaves = durable(leaves.select(*keys, F.col("tokens").alias("leaf_tokens"), F.col("budget").alias("leaf_budget"), F.expr("if(tokens > 0, budget div tokens, 0)").alias("__e"), F.expr("if(tokens > 0, budget % tokens, 0)").alias("__rest")))
    keyed = sized.join(leaves.where("__rest > 0"), keys).select(*keys, "tokens", order_key(seed, F.col("__e") + 1, F.col("__id"), F.col("__mark")).alias("key"), F.col("__rest").alias("rest"))
    cuts = leaves.join(_cut(keyed.where("tokens > 0"), keys), keys, "left")
    found = marked.join(durable(cuts), keys, "left")
    drawn = (F.col("__rest") > 0) & (order_key(seed, F.col("__e") + 1, F.col("__id"), F.col("__mark")) < F.col("__cut"))
    copies = F.when(F.col("__tokens") > 0, F.col("__e") + F.when(drawn, 1).otherwise(0)).otherwise(0).cast("long")
    kept = [c for c in docs.columns if c not in ("n_tokens", "leaf_tokens", "leaf_budget", "n_copies")]
    return found.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("__tokens").alias("n_tokens"), F.coalesce("leaf_tokens", F.lit(0)).alias("leaf_tokens"), F.coalesce("leaf_budget", F.lit(0)).alias("leaf_budget"), copies.alias("n_copies"))
