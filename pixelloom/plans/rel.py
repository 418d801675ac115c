"""Relations that run on Spark or print as ANSI SQL.

An operator that is written against Rel is one declarative plan. SparkRel turns
each step into DataFrame operations, so Catalyst merges the projections of a
chain and picks the joins. TextRel prints the same steps as a chain of common
table expressions, which another SQL engine can run on the same tables.

Expressions are SQL text that both understand: doubles are written with an
exponent (0.5e0), divisions are guarded, and integers go through floor().
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Rel:
    """Columns of a relation and the steps on it. let() evaluates all its expressions on the columns before it."""

    cols: list[str]

    def let(self, **exprs: str) -> Rel:
        raise NotImplementedError

    def where(self, condition: str) -> Rel:
        raise NotImplementedError

    def pick(self, *names: str, **exprs: str) -> Rel:
        raise NotImplementedError

    def agg(self, keys: Sequence[str], **aggregates: str) -> Rel:
        raise NotImplementedError

    def join(self, other: Rel, keys: Sequence[str], how: str = "inner") -> Rel:
        raise NotImplementedError

    def union(self, other: Rel) -> Rel:
        raise NotImplementedError

    def values(self, names: Sequence[str], rows: Sequence[Sequence[float]]) -> Rel:
        """A small constant relation of doubles and integers."""
        raise NotImplementedError

    def series(self, name: str, first: str, last: str) -> Rel:
        """Each row once for each integer from first to last."""
        raise NotImplementedError

    def steps(self, *stages: dict[str, str]) -> Rel:
        out = self
        for stage in stages:
            out = out.let(**stage)
        return out

    def drop(self, *names: str) -> Rel:
        return self.pick(*(c for c in self.cols if c not in names))

    def rename(self, **names: str) -> Rel:
        """rename(new="old")"""
        old = {v: k for k, v in names.items()}
        return self.pick(**{old.get(c, c): c for c in self.cols})

    def settled(self) -> Rel:
        """The same relation, computed before what follows where an engine would else put its expressions into later ones over and over."""
        return self


class SparkRel(Rel):
    def __init__(self, df: DataFrame):
        self.df, self.cols = df, df.columns

    def let(self, **exprs):
        return SparkRel(self.df.withColumns({k: F.expr(v) for k, v in exprs.items()}))

    def where(self, condition):
        return SparkRel(self.df.where(condition))

    def pick(self, *names, **exprs):
        return SparkRel(self.df.select(*names, *(F.expr(v).alias(k) for k, v in exprs.items())))

    def agg(self, keys, **aggregates):
        return SparkRel(self.df.groupBy(*keys).agg(*(F.expr(v).alias(k) for k, v in aggregates.items())))

    def join(self, other, keys, how="inner"):
        if not keys:
            return SparkRel(self.df.crossJoin(F.broadcast(other.df)))  # values() only: a constant relation
        return SparkRel(self.df.join(other.df, list(keys), how))

    def union(self, other):
        return SparkRel(self.df.unionByName(other.df))

    def values(self, names, rows):
        kinds = ["double" if any(isinstance(r[i], float) for r in rows) else "bigint" for i in range(len(names))]
        schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
        data = [tuple(float(v) if k == "double" else int(v) for v, k in zip(r, kinds, strict=True)) for r in rows]
        return SparkRel(self.df.sparkSession.createDataFrame(data, schema))

    def series(self, name, first, last):
        return SparkRel(self.df.withColumn(name, F.explode(F.expr(f"sequence(cast({first} as bigint), cast({last} as bigint))"))))


class TextRel(Rel):
    def __init__(self, name: str, cols: Sequence[str], parts: tuple[tuple[str, str], ...] = ()):
        self.name, self.cols, self.parts = name, list(cols), parts

    def _next(self, body: str, cols: Sequence[str], *more: tuple[tuple[str, str], ...]) -> TextRel:
        parts = dict(self.parts)
        for m in more:
            parts |= dict(m)
        # named by content: equal steps are one expression, whichever side of a join they come from
        name = "t" + hashlib.blake2b(body.encode(), digest_size=5).hexdigest()
        return TextRel(name, cols, (*parts.items(), (name, body)))

    def let(self, **exprs):
        cols = [*self.cols, *(k for k in exprs if k not in self.cols)]
        return self._next(f"SELECT {', '.join(f'{exprs[c]} AS {c}' if c in exprs else c for c in cols)} FROM {self.name}", cols)

    def where(self, condition):
        return self._next(f"SELECT * FROM {self.name} WHERE {condition}", self.cols)

    def pick(self, *names, **exprs):
        return self._next(f"SELECT {', '.join([*names, *(f'{v} AS {k}' for k, v in exprs.items())])} FROM {self.name}", [*names, *exprs])

    def agg(self, keys, **aggregates):
        cols = [*keys, *aggregates]
        return self._next(f"SELECT {', '.join([*keys, *(f'{v} AS {k}' for k, v in aggregates.items())])} FROM {self.name} GROUP BY {', '.join(keys)}", cols)

    def join(self, other, keys, how="inner"):
        new = [c for c in other.cols if c not in keys]
        if not keys:
            return self._next(f"SELECT l.*, {', '.join(f'o.{c}' for c in new)} FROM {self.name} l CROSS JOIN {other.name} o", [*self.cols, *new], other.parts)
        on = " AND ".join(f"l.{k} = o.{k}" for k in keys)
        return self._next(f"SELECT {', '.join([*(f'l.{c}' for c in self.cols), *(f'o.{c}' for c in new)])} FROM {self.name} l {how.upper()} JOIN {other.name} o ON {on}", [*self.cols, *new], other.parts)

    def union(self, other):
        return self._next(f"SELECT {', '.join(self.cols)} FROM {self.name} UNION ALL SELECT {', '.join(self.cols)} FROM {other.name}", self.cols, other.parts)

    def values(self, names, rows):
        kinds = ["double" if any(isinstance(r[i], float) for r in rows) else "bigint" for i in range(len(names))]
        lines = ", ".join("(" + ", ".join(repr(float(v)) if k == "double" else str(int(v)) for v, k in zip(r, kinds, strict=True)) + ")" for r in rows)
        casts = ", ".join(f"CAST(c{i} AS {k.upper()}) AS {n}" for i, (n, k) in enumerate(zip(names, kinds, strict=True)))
        return self._next(f"SELECT {casts} FROM (VALUES {lines}) v({', '.join(f'c{i}' for i in range(len(names)))})", names)

    def series(self, name, first, last):
        return self._next(f"SELECT *, unnest(generate_series(CAST({first} AS BIGINT), CAST({last} AS BIGINT))) AS {name} FROM {self.name}", [*self.cols, name])

    def settled(self):
        out = self._next(f"SELECT * FROM {self.name}", self.cols)
        return TextRel("m" + out.name[1:], out.cols, (*out.parts[:-1], ("m" + out.name[1:], out.parts[-1][1])))

    def sql(self) -> str:
        if not self.parts:
            return f"SELECT * FROM {self.name}"
        return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n[0] == 'm' else ''}({b})" for n, b in self.parts) + f"\nSELECT * FROM {self.name}"


class Tables:
    """Named tables, on Spark or as text."""

    def __init__(self, spark: SparkSession | None = None, folder: str = ""):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str, *cols: str) -> Rel:
        if self.spark is None:
            return TextRel(name, cols).pick(*cols)
        return SparkRel(self.spark.read.parquet(f"{self.folder}/{name}.parquet")).pick(*cols)

    def count(self, name: str) -> str:
        """The number of a table's rows as an expression: on Spark counted now, from the files' footers."""
        if self.spark is None:
            return f"(SELECT count(*) FROM {name})"
        return str(self.spark.read.parquet(f"{self.folder}/{name}.parquet").count())
