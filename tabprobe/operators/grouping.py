"""All grouped tables of a page from one scan.

``GroupedTables`` states each table by its keys and aggregates; one GROUPING SETS aggregation over the prepared frame
computes them all (partial sums are combined on the map side, per set), its small result is checkpointed, and each
table is the part with its set's grouping id. A set's NULL keys are told from keys it does not have by that id.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.operators._util import persist
from tabprobe.sources.io import col

FUNCTIONS = {"avg": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
Spec = tuple[Sequence[str], Mapping[str, tuple[str, str]]]


class GroupedTables:
    """Tables by name: ``tables[name] = (keys, {column: (function, source column)})``; ``("count", "*")`` counts rows. Nothing runs
    before the first table is asked for."""

    def __init__(self, df: DataFrame, tables: Mapping[str, Spec]):
        self._df, self._tables, self._result = df, dict(tables), None
        self._keys = list(dict.fromkeys(k for keys, _ in self._tables.values() for k in keys))
        self._aggregates = list(dict.fromkeys(a for _, aggs in self._tables.values() for a in aggs.values()))

    def _all(self) -> DataFrame:
        if self._result is None:
            sets = list(dict.fromkeys(tuple(k for k in self._keys if k in keys) for keys, _ in self._tables.values()))
            aggs = [(F.count(F.lit(1)) if source == "*" else FUNCTIONS[function](col(source))).alias(f"a{i}")
                    for i, (function, source) in enumerate(self._aggregates)]
            # keys under names of our own: an aggregate may read a column that is also a key
            named = self._df.select("*", *[col(k).alias(f"_key{i}") for i, k in enumerate(self._keys)])
            own = {k: f"_key{i}" for i, k in enumerate(self._keys)}
            if not self._keys:
                result = named.groupBy().agg(F.lit(0).alias("set"), F.count(F.lit(1)).alias("n"), *aggs).filter("n > 0")
            else:
                result = (named.groupingSets([[own[k] for k in s] for s in sets], *own.values())
                          .agg(F.grouping_id().alias("set"), *aggs))
            self._result = persist(result)
        return self._result

    def rows(self, name: str) -> DataFrame:
        """A table with all its groups, those with NULL keys too; without keys, no row for an empty frame."""
        keys, aggs = self._tables[name]
        without = sum(1 << (len(self._keys) - 1 - i) for i, k in enumerate(self._keys) if k not in keys)
        return self._all().filter(F.col("set") == without).select(
            *[F.col(f"_key{self._keys.index(k)}").alias(k) for k in keys],
            *[F.col(f"a{self._aggregates.index(a)}").alias(c) for c, a in aggs.items()])

    def __getitem__(self, name: str) -> DataFrame:
        """A table without NULL keys, as pandas groups; without keys, one row always."""
        keys, aggs = self._tables[name]
        found = self.rows(name)
        if not keys:
            found = found.agg(*[F.max(col(c)).alias(c) for c in aggs])
            return found.fillna(0, [c for c, (function, _) in aggs.items() if function == "count"])
        return found.dropna(subset=list(keys))
