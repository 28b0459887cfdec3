"""The scalar functions by name: call('string::slice', text, start, count) is a column.

Every function is an expression that Spark evaluates itself, but for the
geometry kernel, which runs in Arrow batches. An absent argument makes an
absent answer unless the function says otherwise; a refusal is an error of the
query, raised by the row that is refused.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class NoSuchFunction(ValueError):
    pass


class WrongArguments(ValueError):
    pass


@dataclass(frozen=True)
class Function:
    name: str
    least: int
    most: int
    build: Callable[..., Column]
    typed: bool  # whether the arguments' types are asked for, as `types`


REGISTRY: dict[str, Function] = {}


def function(name: str, least: int, most: int | None = None, typed: bool = False):
    def add(build):
        REGISTRY[name] = Function(name, least, least if most is None else most, build, typed)
        return build

    return add


def refuse(when: Column, message: str, value: Column) -> Column:
    """The value, or an error where the condition holds."""
    return F.when(F.coalesce(when, F.lit(False)), F.raise_error(F.lit(message))).otherwise(value)


def types_of(df: DataFrame | None, args: list[Column]) -> list[T.DataType | None]:
    """The arguments' types over df; of nothing, where there is no frame to ask."""
    if df is None:
        return [None] * len(args)
    return [f.dataType for f in df.select(*(a.alias(f"_{i}") for i, a in enumerate(args))).schema]


def call(name: str, *args: Column | str, of: DataFrame | None = None) -> Column:
    """A function of columns. `of` is the frame that they belong to; functions whose form depends on types look it up there."""
    f = REGISTRY.get(name)
    if f is None:
        raise NoSuchFunction(f"there is no function {name}")
    if not f.least <= len(args) <= f.most:
        raise WrongArguments(f"{name} takes {f.least} to {f.most} arguments, not {len(args)}")
    cols = [F.col(a) if isinstance(a, str) else a for a in args]
    return f.build(*cols, types=types_of(of, cols)) if f.typed else f.build(*cols)


from . import collections, scalars, shapes, text  # noqa: E402, F401 - they fill the registry
