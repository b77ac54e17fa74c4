"""Shards by a weighted hash tree: region, rack and shard are drawn level by level, and only changed subtrees trade rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateflow.llm.numbering import numbered
from crateflow.llm.runtime import durable

LAW = "key"
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Hexadecimal digits of a draw; as many as a double holds exactly.
DIGITS = 13


class Shard(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


class Tree(NamedTuple):
    """Shards with their place. A node's weight is the sum of those below it; nodes without weight take no rows."""

    shards: tuple[Shard, ...]

    def grown(self, weight: float = 1.0) -> Tree:
        """With one more shard, in a region of its own: no other subtree changes its weight, so rows move into it alone."""
        n = max((s.shard for s in self.shards), default=-1) + 1
        return Tree((*self.shards, Shard(f"r+{n}", f"k+{n}", n, weight)))

    def levels(self) -> list[list[list[tuple[str, float, int]]]]:
        """Per level the children (name, weight, place) of each node; the place is the child's in the next level, at last the shard."""
        paths = [(s.region, f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.shard}") for s in self.shards]
        out, above = [], {"": 0}
        for depth in range(3):
            weights: dict[str, float] = {}
            parent: dict[str, str] = {}
            for path, s in zip(paths, self.shards, strict=True):
                weights[path[depth]] = weights.get(path[depth], 0.0) + s.weight
                parent[path[depth]] = path[depth - 1] if depth else ""
            alive = [n for n, w in weights.items() if w > 0]
            place = {n: k for k, n in enumerate(alive)} if depth < 2 else {p[2]: s.shard for p, s in zip(paths, self.shards, strict=True)}
            level: list[list[tuple[str, float, int]]] = [[] for _ in above]
            for n in alive:
                level[above[parent[n]]].append((n, weights[n], place[n]))
            out.append(level)
            above = place
        return out


def regular(n: int, per_rack: int = 4, racks: int = 2) -> Tree:
    """n shards of weight 1 in racks and regions that are filled in turn."""
    return Tree(tuple(Shard(f"r{k // (per_rack * racks)}", f"k{k // per_rack}", k) for k in range(n)))


def drawn(key: Column, tree: Tree) -> Column:
    """The shard of a key: at each level every child draws -ln(u) / weight with u from the hash of its name and the key; the least wins.

    A child's draw depends on its name, weight and the key alone. So a heavier node only wins keys and a lighter one only
    loses some, and keys that stay in a node whose own children are unchanged keep their shard. Equal draws go to the earlier child.
    """
    if not any(s.weight > 0 for s in tree.shards):
        raise ValueError("a tree needs a shard with a weight")
    node = F.lit(0)
    for level in tree.levels():
        kinds = "array<array<struct<name:string,weight:double,place:int>>>"
        table = F.array(*[F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(p).alias("place")) for n, w, p in children]) for children in level]).cast(kinds)

        def draw(child: Column) -> Column:
            h = F.conv(F.substring(F.md5(F.concat(child["name"], F.lit(":"), key)), 1, DIGITS), 16, 10).cast("double")
            return F.struct((-F.ln((h + 0.5) / float(16**DIGITS)) / child["weight"]).alias("draw"), child["place"].alias("place"))

        node = F.array_min(F.transform(F.element_at(table, node + 1), draw))["place"]
    return node


def assign(docs: DataFrame, tree: Tree, id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard and grown_shard of every row; carried: a struct of other columns, if asked.

    size: UTF-8 bytes of the text plus ROW_BYTES. The id and the tree alone decide, so equal texts under different ids may
    part and rows of one id stay together; a null id counts as the empty text, a null text as none. grown_shard: the shard in tree.grown().
    """
    key = F.coalesce(F.col(f"`{id}`").cast("string"), F.lit(""))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rest = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body.cast("binary")).cast("long").alias("text_crc32"), key.alias("key"), *rest)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), drawn(F.col("key"), tree).cast("int").alias("shard"), drawn(F.col("key"), tree.grown()).cast("int").alias("grown_shard"), *(["carried"] if carry else []),
    )


def placed(docs: DataFrame, tree: Tree, id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """assign() with slot: 0, 1, 2, ... within each shard by id (nulls last), rows of one id as they lie.

    Texts are read once and not moved; the narrow rows are written, dealt by range of (shard, id) and numbered in pieces, so a
    shard is never one task's. An empty table gives no rows. Columns other than id and text are read only if carried.
    """
    rows = durable(assign(docs, tree, id, text, carry))
    return numbered(rows, [F.asc_nulls_last("doc_id")], "slot", by="shard")


def write_shards(rows: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Writes rows of placed() as a folder per shard, each in files of about rows_per_file rows in order of slot."""
    file = F.floor(F.col("slot") / rows_per_file)
    rows.repartition("shard", file).sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)
