"""Symbolic layers: a sparse base relation, parameters by row and by column, and an expression.

A layer never stores what its expression gives. Zeros of the base are implied; where the expression
of zero is not zero the layer is dense in meaning and still sparse in storage, and aggregates add
the part of the implied zeros in closed form or by the few distinct parameters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Expression = Callable[[Column], Column]


class Step(NamedTuple):
    """A step's name and expression; ``params`` are what its maker in ``STEPS`` needs to make it again, or None."""

    name: str
    expression: Expression
    params: dict | None = None


#: Makers of the steps that a store can keep: a step is its name and these parameters.
STEPS: dict[str, Callable[..., Expression]] = {}


def make(name: str, **params) -> Step:
    """The registered step of that name."""
    return Step(name, STEPS[name](**params), params)


def maker(name: str) -> Callable:
    """Registers the maker of a step under a name."""

    def add(function: Callable[..., Expression]) -> Callable[..., Expression]:
        STEPS[name] = function
        return function

    return add


@dataclass(frozen=True)
class Layer:
    """``base`` (obs_id, var_id, value without zeros), parameters, and how a value is made of them."""

    base: DataFrame
    rows: DataFrame | None = None
    columns: DataFrame | None = None
    steps: tuple[Step, ...] = ()
    dense: bool = False
    #: Names of steps whose results the base holds.
    history: tuple[str, ...] = ()

    def expression(self, value: Column) -> Column:
        for x in self.steps:
            value = x.expression(value)
        return value

    def at_zero(self) -> Column:
        """What an implied zero becomes: steps before a dense one leave it as it is."""
        return self.steps[-1].expression(F.lit(0.0)) if self.dense else F.lit(0.0)

    @property
    def logged(self) -> bool:
        return "log1p" in self.chain

    @property
    def chain(self) -> tuple[str, ...]:
        return (*self.history, *(x.name for x in self.steps))

    @property
    def has_clip(self) -> bool:
        """Whether the last step bounds its values, so that products with the layer are not those of its parameters."""
        last = self.steps[-1].params if self.steps else None
        return any((last or {}).get(k) is not None for k in ("low", "high", "bound"))

    def then(self, name: str | Step, step: Expression | None = None, rows: DataFrame | None = None, columns: DataFrame | None = None, dense: bool = False) -> Layer:
        """The layer with a further step, one of ``STEPS`` or a name and an expression, and the parameters that it needs, by obs_id or var_id."""
        new = name if isinstance(name, Step) else Step(name, step)
        if self.dense:
            raise ValueError(f"{new.name} can't follow {self.steps[-1].name}: its result is dense")
        merge = lambda old, new, key: new if old is None else old if new is None else old.join(new, key, "left")
        return replace(self, rows=merge(self.rows, rows, "obs_id"), columns=merge(self.columns, columns, "var_id"), steps=(*self.steps, new), dense=dense)

    def joined(self, cells: DataFrame) -> DataFrame:
        """Cells (obs_id, var_id, ...) with the parameters; plain equi-joins whose strategy Catalyst picks."""
        if self.rows is not None:
            cells = cells.join(self.rows, "obs_id")
        if self.columns is not None:
            cells = cells.join(self.columns, "var_id")
        return cells

    def values(self) -> DataFrame:
        """obs_id, var_id, value of the stored cells."""
        return self.joined(self.base).select("obs_id", "var_id", self.expression(F.col("value")).alias("value"))

    def at(self, cells: DataFrame) -> DataFrame:
        """Values of any cells (obs_id, var_id, further columns), implied zeros included."""
        found = self.joined(cells.join(self.base, ["obs_id", "var_id"], "left"))
        return found.select(*cells.columns, self.expression(F.coalesce("value", F.lit(0.0))).alias("value"))

    def kept(self, obs: DataFrame | None, var: DataFrame | None) -> Layer:
        """The layer over some rows and columns: (obs_id) and (var_id)."""
        base = self.base
        if obs is not None:
            base = base.join(obs.select("obs_id"), "obs_id", "left_semi")
        if var is not None:
            base = base.join(var.select("var_id"), "var_id", "left_semi")
        return replace(self, base=base)

    def before(self) -> Layer:
        """A dense layer without its last step, so sparse; any other as it is."""
        return replace(self, steps=self.steps[:-1], dense=False) if self.dense else self

    def transposed(self) -> Layer:
        """Rows for columns. Parameters change sides with them, for a step names them, not their axis."""
        swap = lambda f: f.select(*[F.col(c).alias({"obs_id": "var_id", "var_id": "obs_id"}.get(c, c)) for c in f.columns])
        return replace(self, base=swap(self.base).select("obs_id", "var_id", "value"), rows=self.columns and swap(self.columns), columns=self.rows and swap(self.rows))


def clip(value: Column, low: float | None, high: float | Column | None) -> Column:
    if high is not None:
        value = F.least(value, high if isinstance(high, Column) else F.lit(float(high)))
    if low is not None:
        value = F.greatest(value, low if isinstance(low, Column) else F.lit(float(low)))
    return value
