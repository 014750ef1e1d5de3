"""A Python module as programs use it; see forms.py."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_seen: set = set()


def vowels(text: str) -> int:
    return sum(c in "aeiou" for c in text.lower())


def shaky(n: int) -> int:
    """Fails the first time it sees a number."""
    if n not in _seen:
        _seen.add(n)
        raise ValueError("try again")
    return n + 1


def big_orders(orders: DataFrame, least: float) -> DataFrame:
    return orders.filter(F.col("o_totalprice") >= least)
