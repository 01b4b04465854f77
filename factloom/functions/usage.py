"""Prices and token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: US dollars for a million input and output tokens, by part of the model's name, in this order.
PRICES = (("embedding", 0.15, 0.0), ("gemma", 0.0952, 0.16), ("flash-lite", 0.10, 0.40), ("flash", 0.30, 2.50), ("pro", 1.25, 10.00))


#: The lower prices that two clients log, by model name.
CLIENT_PRICES = {"gemini-2.5-flash": (0.075, 0.30), "gemini-2.5-flash-lite": (0.05, 0.20), "gemini-2.5-pro": (1.25, 10.0), "google/gemma-3-27b-it": (0.0952, 0.16)}


def client_cost_usd(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """Cost by the clients' own prices; unknown models cost nothing."""
    price = None
    for name, (into, out) in CLIENT_PRICES.items():
        value = (input_tokens * into + output_tokens * out) / 1_000_000
        price = F.when(model == name, value) if price is None else price.when(model == name, value)
    return price.otherwise(0.0)


def cost_usd(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    low, price = F.lower(model), None
    for part, into, out in PRICES:
        value = (input_tokens * into + output_tokens * out) / 1_000_000
        test = F.contains(low, F.lit(part))
        price = F.when(test, value) if price is None else price.when(test, value)
    return price.otherwise(0.0)


def tokens_of_chars(chars: Column) -> Column:
    return F.floor(chars / 4).cast("long")
