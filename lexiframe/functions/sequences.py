"""Column expressions on arrays: framing, masks, one-hot, small linear algebra."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiframe.config import EOS, GO, PAD


def cut(ids: Column, max_len: int) -> Column:
    return F.slice(ids, 1, max_len)


def pad_right(ids: Column, width: int, filler: int = PAD) -> Column:
    filled = F.concat(ids, F.array_repeat(F.lit(filler), width))
    return F.slice(filled, 1, width)


def encoder_input(ids: Column, max_len: int) -> Column:
    """Cut to max_len, padded to max_len + 1: the last cell is always padding."""
    return pad_right(cut(ids, max_len), max_len + 1)


def decoder_input(ids: Column, max_len: int) -> Column:
    return pad_right(F.concat(F.array(F.lit(GO)), cut(ids, max_len)), max_len + 1)


def decoder_target(ids: Column, max_len: int) -> Column:
    return pad_right(F.concat(cut(ids, max_len), F.array(F.lit(EOS))), max_len + 1)


def decoder_length(ids: Column, max_len: int) -> Column:
    return F.size(cut(ids, max_len)) + 1


def length_mask(length: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                       lambda i: (i < length).cast("int"))


def last_step(values: Column) -> Column:
    """Last element, NULL for an empty array."""
    return F.try_element_at(values, F.lit(-1))


def one_hot(index: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)),
                       lambda i: (i == index).cast("int"))


def argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once per row, not once per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def softmax(values: Column) -> Column:
    """exp(x - max) over its sum."""
    doubles = F.transform(values, lambda x: x.cast("double"))
    raised = bind(F.array_max(values).cast("double"),
                  lambda top: F.transform(doubles, lambda x: F.exp(x - top)))
    return bind(raised, lambda es: bind(total(es), lambda t: scale(es, 1 / t)))


def squared_norm(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0),
                       lambda acc, x: acc + x.cast("double") * x.cast("double"))


def scale(values: Column, factor: Column) -> Column:
    return F.transform(values, lambda x: x.cast("double") * factor)


def unit_length(values: Column) -> Column:
    """Divide by the Euclidean norm; a zero vector stays as it is."""
    return bind(F.sqrt(squared_norm(values)),
                lambda n: scale(values, F.when(n > 0, 1 / n).otherwise(F.lit(1.0))))


def dot(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")))


def double_array(values: Sequence[float]) -> Column:
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def linear_scores(values: Column, weights: Sequence[Sequence[float]],
                  bias: Sequence[float]) -> Column:
    """x.W + b as an array with one score per class.

    Weights are model parameters (classes x dimensions), so they ride in the plan.
    """
    rows = [dot(values, double_array(row)) + F.lit(float(b))
            for row, b in zip(weights, bias, strict=True)]
    return F.array(*rows)


def to_grid(values: Column, rows: int, cols: int) -> Column:
    """A flat array as `rows` arrays of `cols` cells; another size is an error."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)),
                       lambda r: F.slice(values, r * cols + 1, cols))
    return F.when(F.size(values) == rows * cols, grid).when(
        F.size(values) != rows * cols, F.raise_error(F.lit(f"not {rows} x {cols} cells")))


def transpose(grid: Column, cols: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(cols)),
                       lambda c: F.transform(grid, lambda row: F.element_at(row, c)))
