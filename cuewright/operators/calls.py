"""What comes back from command-line and model calls: envelopes, request counts, kinds of errors, tails of logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import json_object

#: Fixed value: what the messages of used-up quotas hold.
QUOTA = "quota|exhaust|rate limit|resource_exhausted"
MODELS = "struct<stats:struct<models:map<string,struct<api:struct<totalRequests:string>>>>>"
WHOLE = r"^-?\d+$"


def envelope(said: Column) -> Column:
    """The JSON text of an envelope: what was said if it is JSON, else its outermost object; raises if neither is."""
    inner = json_object(said)
    error = F.concat(F.lit("Could not parse the JSON envelope: "), F.left(F.coalesce(said, F.lit("")), F.lit(500)))
    return F.when(F.try_parse_json(said).isNotNull(), said).when(F.try_parse_json(inner).isNotNull(), inner).otherwise(F.raise_error(error))


def request_count(envelope_: Column) -> Column:
    """Requests of all models on the documented path; where that has none, of every totalRequests anywhere; 1 at least."""
    none = F.array().cast("array<string>")
    stated = F.coalesce(F.map_values(F.from_json(envelope_, MODELS)["stats"]["models"]), F.array().cast("array<struct<api:struct<totalRequests:string>>>"))
    listed = F.filter(F.transform(stated, lambda m: m["api"]["totalRequests"]), lambda n: n.rlike(WHOLE))
    anywhere = F.coalesce(F.regexp_extract_all(envelope_, F.lit(r'"totalRequests"\s*:\s*(-?\d+)(?![\d.eE])'), F.lit(1)), none)
    chosen = F.when(F.size(listed) > 0, listed).otherwise(anywhere)
    return F.greatest(F.aggregate(chosen, F.lit(0).cast("bigint"), lambda s, n: s + n.cast("bigint")), F.lit(1).cast("bigint"))


def is_quota_error(code: Column, message: Column) -> Column:
    """Whether an error says that a quota is used up: code 429, or a message with one of the marks."""
    text = F.lower(F.concat_ws(" ", code.cast("string"), message))
    return F.coalesce(code.cast("string").contains("429"), F.lit(False)) | text.rlike(QUOTA)


def tail_lines(log: Column, n: int) -> Column:
    lines = F.split(log, "\n")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), F.lit(n)), "\n")
