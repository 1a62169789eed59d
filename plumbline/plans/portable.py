"""Operators as declarative SQL over named relations, so that Catalyst plans them and a second engine can check them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_RINT = re.compile(r"RINT\[([^\[\]]*)\]")
_ROUND = re.compile(r"ROUND\[([^\[\]|]*)\|(\d+)\]")


def apply(text: str, rounded: bool = False, **relations: DataFrame) -> DataFrame:
    """Run an operator over DataFrames that take the places of the {names} in its text. ROUND[x|n] rounds only where
    `rounded` asks for it, to compare engines."""
    spark: SparkSession = next(iter(relations.values())).sparkSession
    text = _ROUND.sub(r"round(\1, \2)" if rounded else r"(\1)", text)
    return spark.sql(_RINT.sub(r"rint(\1)", text), **relations)


def second_engine(text: str, **relations: str) -> str:
    """The same operator as one SQL string: each relation is given by its own query. RINT[x] rounds half to even."""
    body = _ROUND.sub(r"round(\1, \2)", _RINT.sub(r"round_even(\1, 0)", text)).format(**{k: k for k in relations}).strip()
    head = ", ".join(f"{k} AS ({v})" for k, v in relations.items())
    return f"WITH {head}, {body[5:]}" if body.startswith("WITH ") else f"WITH {head} {body}"
