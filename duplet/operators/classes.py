"""Clone classes: connected components of clone pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duplet.operators.storage import stored


def classes(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, class_id) for the ends of edges (a, b): the least id reachable. Labels spread by joins, pointers are halved each round."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "classes")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("class_id")), "classes")
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("class_id").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.least("class_id", "near").alias("class_id"), F.col("class_id").alias("was"))
        jump = labels.select(F.col("id").alias("class_id"), F.col("class_id").alias("further"))
        after = stored(step.join(jump, "class_id", "left").select("id", F.least("class_id", "further").alias("class_id"), (F.least("class_id", "further") < F.col("was")).alias("moved")), "classes")
        labels = after.drop("moved")
        if after.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"classes did not settle in {rounds} rounds")


class UnionFind:
    """Disjoint sets of 0 to n - 1 on the driver, for few elements: union by size, path halving."""

    def __init__(self, n: int):
        self._parent, self._size = list(range(n)), [1] * n

    def __len__(self) -> int:
        return len(self._parent)

    def find(self, x: int) -> int:
        while self._parent[x] != x:
            self._parent[x] = self._parent[self._parent[x]]
            x = self._parent[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if self._size[x] < self._size[y]:
            x, y = y, x
        self._parent[y] = x
        self._size[x] += self._size[y]
        return True

    def set_size(self, x: int) -> int:
        return self._size[self.find(x)]

    def groups(self, least: int = 1) -> list[list[int]]:
        """The sets of at least that size, each in order, by their first member."""
        found: dict[int, list[int]] = {}
        for x in range(len(self)):
            found.setdefault(self.find(x), []).append(x)
        return sorted((g for g in found.values() if len(g) >= least), key=lambda g: g[0])
