"""Columns that carry their derivatives by named parameters (forward mode)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dual:
    """A column and, by parameter, the column of its derivative. Parameters without an entry don't act on it."""

    value: Column
    slopes: dict[str, Column] = field(default_factory=dict)

    @classmethod
    def constant(cls, value: Column | float) -> Dual:
        return cls(value if isinstance(value, Column) else F.lit(float(value)))

    @classmethod
    def parameter(cls, name: str, value: float) -> Dual:
        return cls(F.lit(float(value)), {name: F.lit(1.0)})

    def _through(self, value: Column, slope: Column) -> Dual:
        return Dual(value, {name: slope * s for name, s in self.slopes.items()})

    def _with(self, other: Dual | float, value: Column, mine: Column, theirs: Column) -> Dual:
        other = _dual(other)
        slopes = {name: mine * s for name, s in self.slopes.items()}
        for name, s in other.slopes.items():
            slopes[name] = slopes[name] + theirs * s if name in slopes else theirs * s
        return Dual(value, slopes)

    def __add__(self, other: Dual | float) -> Dual:
        return self._with(other, self.value + _dual(other).value, F.lit(1.0), F.lit(1.0))

    __radd__ = __add__

    def __mul__(self, other: Dual | float) -> Dual:
        b = _dual(other).value
        return self._with(other, self.value * b, b, self.value)

    __rmul__ = __mul__

    def __truediv__(self, other: Dual | float) -> Dual:
        b = _dual(other).value
        return self._with(other, self.value / b, 1 / b, -self.value / (b * b))

    def exp(self) -> Dual:
        return self._through(F.exp(self.value), F.exp(self.value))

    def tanh(self) -> Dual:
        return self._through(F.tanh(self.value), 1 - F.tanh(self.value) * F.tanh(self.value))

    def of_base(self, base: Column) -> Dual:
        """``base`` to this power; a base of 0 stays 0 whatever the power, for powers above 0."""
        raised = F.pow(base, self.value)
        return self._through(raised, F.when(base > 0, raised * F.ln(base)).otherwise(0.0))


def _dual(x: Dual | float) -> Dual:
    return x if isinstance(x, Dual) else Dual.constant(x)
