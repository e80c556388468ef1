"""Utterances from a stream of timed words: state per project, closed by silence."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

SCHEMA = "project_id bigint, start double, end double, text string"
STATE = "start double, end double, text string"


def stream_utterances(words: DataFrame, silence: float = 0.7, idle_seconds: float = 60) -> DataFrame:
    """Words (project_id, text, start, end) that come in time order, as utterances parted by silence.

    An utterance is emitted when a word comes over ``silence`` seconds behind its end, or when no word of its project
    has come for ``idle_seconds``, so that the last one comes out too; the state holds just the open one.
    """
    import pandas as pd

    names = ["project_id", "start", "end", "text"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], *held)], columns=names)
            return
        done = []
        for frame in frames:
            for row in frame.sort_values(["start", "end"]).itertuples():
                if held is not None and row.start - held[1] > silence:
                    done.append((key[0], *held))
                    held = None
                held = (row.start, row.end, row.text) if held is None else (held[0], max(held[1], row.end), f"{held[2]} {row.text}")
        if held is not None:
            state.update((float(held[0]), float(held[1]), held[2]))
            state.setTimeoutDuration(int(idle_seconds * 1000))
        yield pd.DataFrame(done, columns=names)

    return words.groupBy("project_id").applyInPandasWithState(step, SCHEMA, STATE, "append", "ProcessingTimeTimeout")
