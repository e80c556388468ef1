"""Cost arithmetic and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed prices: USD for a million prompt, cached and output tokens of each model.
MODEL_PRICES = {
    "gemini-3.1-flash-lite-preview": (0.25, 0.025, 1.50),
    "gemini-3-flash-preview": (0.50, 0.10, 3.00),
    "gemini-3.1-pro-preview": (2.00, 0.20, 12.00),
}
#: USD for a million repair hits, misses and output tokens; for an hour of speech.
REPAIR_PRICES = (0.0028, 0.14, 0.28)
SPEECH_HOUR = 0.22


def priced(calls: DataFrame, model: str) -> DataFrame:
    """The calls with p_in, p_hit and p_out of their model; null for unknown ones. Three models: a broadcast."""
    prices = calls.sparkSession.createDataFrame([(m, *p) for m, p in MODEL_PRICES.items()], f"`{model}` string, p_in double, p_hit double, p_out double")
    return calls.join(F.broadcast(prices), model, "left")


def token_cost(prompt: Column, cached: Column, output: Column, thinking: Column, prices: tuple[Column, Column, Column]) -> Column:
    """USD; thinking costs as output does; a missing counter is 0 and an unknown model's prices, which are null, cost nothing."""
    prompt, cached, output, thinking = (F.coalesce(c, F.lit(0)) for c in (prompt, cached, output, thinking))
    cost = ((prompt - cached) * prices[0] + cached * prices[1] + (output + thinking) * prices[2]) / 1000000
    return F.coalesce(cost, F.lit(0.0))


def repair_cost(hit: Column, miss: Column, output: Column) -> Column:
    parts = [F.coalesce(c, F.lit(0)) * p for c, p in zip((hit, miss, output), REPAIR_PRICES, strict=True)]
    return (parts[0] + parts[1] + parts[2]) / 1000000


def speech_seconds(stated: Column, words: Column) -> Column:
    """The stated duration, else the latest end of the words (0 at least), else 0; never negative."""
    latest = F.array_max(F.transform(words, lambda w: w["end"]))
    return F.greatest(F.coalesce(stated, latest, F.lit(0.0)), F.lit(0.0))


def speech_cost(seconds: Column) -> Column:
    return F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(0.0)) / 3600 * SPEECH_HOUR


def ledger(events: DataFrame, project: str, service: str, amount: str) -> DataFrame:
    """(project, service, total) with each project's total (service null) and the whole's (both null).

    Zero amounts are left out; a negative amount and one without a service raise.
    """
    wrong = F.when(F.col(amount) < 0, "a negative cost").when(F.coalesce(F.trim(service), F.lit("")) == "", "a cost without a service")
    checked = events.where(F.col(amount) != 0).withColumn(amount, F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(F.col(amount)))
    return checked.rollup(project, service).agg(F.sum(amount).alias("total"))
