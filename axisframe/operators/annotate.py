"""Caller-supplied hooks that run inside executors: annotator, encoder and judge."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.functions import columns as C
from axisframe.functions.arrow import list_column

Annotator = Callable[[pd.DataFrame, int, int], Sequence[tuple[str, bool]]]
Validator = Callable[[str], str | None]


def annotate(items: DataFrame, annotator: Annotator, validator: Validator, *, retries: int = 3,
             budget: int = 192, retry_budget: int = 300, partitions: int | None = None
             ) -> DataFrame:
    """``(image_id, status, content, attempts, errors)`` for ``(image_id, prompt)``.

    ``annotator(batch, attempt, budget)`` returns (text, truncated) per row; ``validator`` returns
    a reason to reject or None. Rejected rows are tried again, a truncated or rejected answer with
    the larger budget; what still fails becomes an error row with all its reasons. ``partitions``
    is the number of concurrent calls.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.reset_index(drop=True)
            state = [{"status": "error", "content": None, "attempts": 0, "errors": []}
                     for _ in range(len(frame))]
            budgets = [budget] * len(frame)
            waiting = list(range(len(frame)))
            for attempt in range(1, retries + 1):
                left = []
                for size in sorted({budgets[i] for i in waiting}):
                    rows = [i for i in waiting if budgets[i] == size]
                    try:
                        answers = list(annotator(frame.iloc[rows], attempt, size))
                    except Exception as error:
                        answers = [error] * len(rows)
                    for i, answer in zip(rows, answers):
                        state[i]["attempts"] = attempt
                        if isinstance(answer, Exception):
                            reason = f"{type(answer).__name__}: {answer}"
                        elif answer[1]:
                            reason, budgets[i] = "truncated", retry_budget
                        else:
                            reason = validator(answer[0])
                            if reason is None:
                                state[i].update(status="ok", content=answer[0])
                                continue
                            budgets[i] = retry_budget
                        state[i]["errors"].append(f"attempt {attempt}: {reason}")
                        left.append(i)
                waiting = left
                if not waiting:
                    break
            out = pd.DataFrame(state)
            out.insert(0, "image_id", frame["image_id"])
            yield out

    work = items.repartition(partitions, "image_id") if partitions else items
    kind = items.schema["image_id"].dataType.simpleString()
    return work.select("image_id", "prompt").mapInPandas(
        run, f"image_id {kind}, status string, content string, attempts int, errors array<string>")


def encode_column(rows: DataFrame, make_encoder: Callable[[], Callable[[Sequence], np.ndarray]],
                  column: str, out: str = "embedding", batch: int = 256) -> DataFrame:
    """Add normalized vectors of a text or binary column; the encoder is made once per task."""
    @F.arrow_udf("array<double>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = make_encoder()
        for part in parts:
            vectors = [encode(part.slice(i, batch).to_pylist()) for i in range(0, len(part), batch)]
            yield list_column(np.concatenate(vectors).astype(np.float64) if vectors else np.zeros((0, 1)))

    encoded = rows.withColumn(out, run(column))
    return encoded.withColumn(out, C.l2_normalize(out, guard="strict"))


def adjudicate_edges(edges: DataFrame, judge: Callable[[pd.DataFrame], dict[str, bool]], *,
                     batch: int = 64, retries: int = 3, partitions: int | None = None
                     ) -> DataFrame:
    """``(edge_id, equivalent)`` from batches sent to a judge inside the tasks.

    A batch whose answer is not exactly one boolean per edge is tried again, then halved; a
    single edge that keeps failing fails the job.
    """
    def complaint(rows: pd.DataFrame, answer: dict[str, bool]) -> str | None:
        if len(answer) != len(rows) or not rows["edge_id"].isin(list(answer)).all():
            return "the answer names other edges than the batch"
        return None if all(isinstance(v, bool) for v in answer.values()) else "an answer is not a boolean"

    def settle(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        # Open batches as (first row, last row, failures so far).
        open_batches = deque((i, min(i + batch, len(frame)), 0) for i in range(0, len(frame), batch))
        while open_batches:
            low, high, failures = open_batches.popleft()
            rows, cause = frame.iloc[low:high], None
            try:
                answer = judge(rows)
                problem = complaint(rows, answer)
            except Exception as error:
                problem, cause = f"the judge raised {type(error).__name__}", error
            if problem is None:
                yield pd.DataFrame({"edge_id": list(answer), "equivalent": list(answer.values())})
            elif failures + 1 < retries:
                open_batches.append((low, high, failures + 1))
            elif high - low > 1:
                middle = (low + high) // 2
                open_batches.extend([(low, middle, 0), (middle, high, 0)])
            else:
                raise RuntimeError(f"no valid decision on edge {rows['edge_id'].iloc[0]}: {problem}") from cause

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield from settle(frame)

    work = edges.repartition(partitions) if partitions else edges
    return work.select("edge_id", "left", "right").mapInPandas(
        run, "edge_id string, equivalent boolean")
