"""Experiment names: build, read back, strip."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiframe.config import EXPERIMENT_FIELDS, EXPERIMENT_FORMAT, EXPERIMENT_PATTERN

SEPARATOR = "\u0001"


def model_name(mode: Column, cell: Column, direction: Column, batch_size: Column,
               max_len: Column, units: Column, layers: Column) -> Column:
    return F.format_string(EXPERIMENT_FORMAT, mode, cell, direction, batch_size,
                           max_len, units, layers)


def experiment_name(model: Column, epoch: Column, run_time: Column) -> Column:
    return F.format_string("%s_epoch_%d_%d", model, epoch, run_time)


def is_experiment(texts: Column) -> Column:
    """Whether the `field_texts` of a name are those of the layout, with numbers that fit their types."""
    return reduce(Column.__and__, [texts[i].try_cast(kind).isNotNull()
                                   for i, (_, kind) in enumerate(EXPERIMENT_FIELDS) if kind != "string"])


def field_texts(name: Column) -> Column:
    """All fields of a name as one array, from a single match; empty texts for another layout."""
    groups = SEPARATOR.join(f"${i}" for i in range(1, len(EXPERIMENT_FIELDS) + 1))
    layout = EXPERIMENT_PATTERN.removeprefix("^")
    return F.split(F.regexp_replace(name, rf"^(?:{layout}(?s:.*)|(?s:.*))\z", groups), SEPARATOR)


def typed_fields(texts: Column) -> list[Column]:
    return [texts[i].try_cast(kind).alias(field)
            for i, (field, kind) in enumerate(EXPERIMENT_FIELDS)]


def strip_suffix(file_name: Column, suffix: str = "_train.msgpack") -> Column:
    quoted = suffix.replace(".", r"\.")
    return F.regexp_replace(file_name, quoted + r"\z", "")


def run_id(given: int | None = None) -> Column:
    """The caller's run id, or the epoch seconds of the query's start."""
    return F.lit(given).cast("long") if given is not None else F.unix_timestamp()
