"""Where the fields of a document are: columns for values, lists, confidences and pages by path."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import values as V
from paperloom.settings import DEFAULT, Settings


@dataclass(frozen=True)
class Fields:
    """values: path to a value-union column. lists: path to an array of value unions, or of structs of them."""

    values: dict[str, Column] = field(default_factory=dict)
    lists: dict[str, Column] = field(default_factory=dict)
    composite: frozenset[str] = frozenset()
    confidences: dict[str, Column] = field(default_factory=dict)
    pages: dict[str, Column] = field(default_factory=dict)
    settings: Settings = DEFAULT

    def value(self, path: str) -> Column:
        """The value at a path; null where there is no such scalar field."""
        return self.values.get(path, F.lit(None).cast(V.VALUE))

    def items(self, path: str) -> Column | None:
        return self.lists.get(path)

    def numbers(self, path: str, sub: str | None) -> Column | None:
        """The numbers of a list, in its order."""
        items = self.items(path)
        if items is None or (path in self.composite and sub is None):
            return None if items is None else F.array().cast("array<double>")
        cells = F.transform(items, lambda x: V.as_number(x[sub] if path in self.composite else x))
        return F.filter(cells, lambda n: n.isNotNull())

    def aggregate(self, path: str, how: str, sub: str | None = None) -> Column:
        """sum, count, min, max or avg of a list; sums of nothing are 0, the others NULL; no list is NULL."""
        items = self.items(path)
        if items is None:
            return F.lit(None).cast("double")
        if how == "count":
            return F.when(items.isNotNull(), F.size(items).cast("double"))
        n = self.numbers(path, sub)
        total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return {"sum": total, "min": F.array_min(n), "max": F.array_max(n), "avg": F.try_divide(total, F.size(n))}[how]
