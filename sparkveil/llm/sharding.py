"""Assignment to shards by a hierarchical weighted hash tree.

A document descends from region to rack to shard. At each node every child draws -ln(u) / weight,
u being uniform by hash of the document's key and the child's full name; the least draw wins, so that
a child gets its share of the node's documents. When a leaf's weight changes, weights above change
only if declared; the draws of other children stay, so that documents move only between the
changed child and its siblings, inside the subtree of the node whose children's weights changed.
Everything is an expression over doc_id: no shuffle, no text.

Defined cases: a null doc_id hashes as the text "null"; repeated rows go to the same shard; children
of weight 0 get nothing; a node without any weight, or a tree without regions, is an error; ties
(equal draws) go to the first name; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Region -> (weight, rack -> (weight, shard -> weight)).
Tree = dict[str, tuple[float, dict[str, tuple[float, dict[str, float]]]]]
TREE: Tree = {
    "east": (3.0, {"e1": (2.0, {"s0": 1.0, "s1": 1.0, "s2": 2.0}), "e2": (1.0, {"s0": 1.0, "s1": 1.0})}),
    "north": (2.0, {"n1": (1.0, {"s0": 1.0, "s1": 3.0}), "n2": (1.0, {"s0": 1.0, "s1": 1.0}), "n3": (2.0, {"s0": 1.0, "s1": 1.0, "s2": 1.0})}),
    "west": (1.0, {"w1": (1.0, {"s0": 1.0, "s1": 1.0})}),
}


def levels(tree: Tree) -> list[dict[str, dict[str, float]]]:
    """For each level, the children's weights by their parent's full name."""
    out: list[dict] = [{"": {r: w for r, (w, _) in sorted(tree.items())}}, {}, {}]
    for r, (_, racks) in sorted(tree.items()):
        out[1][r] = {k: w for k, (w, _) in sorted(racks.items())}
        for k, (_, shards) in sorted(racks.items()):
            out[2][f"{r}/{k}"] = dict(sorted(shards.items()))
    for level in out:
        for node, children in level.items():
            if not any(w > 0 for w in children.values()) or any(w < 0 for w in children.values()):
                raise ValueError(f"the weights under {node or 'the root'} must be positive or 0, and not all 0")
    return out


def _draw(key: Column, name: str, weight: float) -> Column:
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + name))), 1, 8), 16, 10).cast("double")
    return F.when(F.lit(weight > 0), -F.ln((h + 0.5) / 4294967296.0) / float(weight or 1))


def _choose(key: Column, parent: str, children: dict[str, float]) -> Column:
    named = {c: _draw(key, f"{parent}/{c}" if parent else c, w) for c, w in children.items() if w > 0}
    if len(named) == 1:
        return F.lit(next(iter(named)))
    return F.least(*(F.struct(d.alias("d"), F.lit(c).alias("c")) for c, d in named.items()))["c"]


def assign(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """doc_id, region, rack and shard for each row."""
    first, second, third = levels(TREE if tree is None else tree)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    out = docs.select("doc_id").withColumn("region", _choose(key, "", first[""]))

    def branch(of: Column, nodes: dict[str, dict[str, float]]) -> Column:
        picked = F.lit(None).cast("string")
        for name, children in nodes.items():
            picked = F.when(of == name, _choose(key, name, children)).otherwise(picked)
        return picked

    out = out.withColumn("rack", branch(F.col("region"), second))
    return out.withColumn("shard", branch(F.concat_ws("/", "region", "rack"), third))


def assign_sql(tree: Tree | None = None) -> str:
    """The same as DuckDB SQL over documents."""
    first, second, third = levels(TREE if tree is None else tree)
    rows = [(depth, parent, c, w) for depth, level in enumerate((first, second, third)) for parent, children in level.items() for c, w in children.items() if w > 0]
    values = ", ".join(f"({d}, '{p}', '{c}', {float(w)!r}::DOUBLE)" for d, p, c, w in rows)

    joined = lambda depth, source, parent: f"SELECT n, doc_id, {''.join(f'c{i}, ' for i in range(depth))}arg_min(child, {{'d': {_sql_draw(depth)}, 'c': child}}) AS c{depth} FROM {source} JOIN tree ON depth = {depth} AND parent = {parent} GROUP BY ALL"
    return (
        f"WITH tree(depth, parent, child, weight) AS (VALUES {values}), d AS (SELECT row_number() OVER () AS n, doc_id FROM documents), "
        f"a AS ({joined(0, 'd', chr(39) * 2)}), b AS ({joined(1, 'a', 'c0')}), c AS ({joined(2, 'b', chr(39).join(['c0 || ', '/', ' || c1']))}) "
        "SELECT doc_id, c0 AS region, c1 AS rack, c2 AS shard FROM c"
    )


def _sql_draw(depth: int) -> str:
    full = "child" if depth == 0 else "parent || '/' || child"
    return f"-ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || {full}), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0) / weight"
