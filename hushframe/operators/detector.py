"""Detectors of the user's: Python code over Arrow batches whose findings join those of the rules."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.functions.catalog import MAX_LABEL_CHARS
from hushframe.functions.spans import FINDINGS_TYPE

# Workers get the code of this module with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# For each text its findings: (start, end, label), in code points, the end exclusive.
Detector = Callable[[Sequence[str]], Iterable[Iterable[tuple[int, int, str]]]]
# They come before the built-in rules and after custom ones.
PRIORITY = 500
_LABEL = re.compile(r"[^\[\] \t\r\n]{1,%d}" % MAX_LABEL_CHARS)


def _finding(text: str, hit: tuple[int, int, str], rule_id: str, priority: int) -> dict:
    start, end, label = hit
    if not 0 <= start < end <= len(text) or not _LABEL.fullmatch(label):
        raise ValueError(f"not a finding in a text of {len(text)} characters: {hit}")
    return {"start": start, "end": end, "priority": priority, "entity_type": label, "rule_id": rule_id, "value": text[start:end]}


def with_detector(
    df: DataFrame,
    detector: Detector,
    text_col: str = "text",
    name: str = "detector_findings",
    rule_id: str = "detector",
    priority: int = PRIORITY,
    texts_at_once: int = 1_000,
) -> DataFrame:
    """Add the findings of a detector of the user's as an array column for ``extra`` parameters.

    The detector gets lists of texts (none of them null), batched by Arrow, and returns
    for each text its findings.  It runs in the Python workers, where it may keep a
    model it loads on first use.  Null texts have no findings.  Offsets outside the
    text, empty spans, a wrong number of answers and labels that no placeholder can
    carry are errors.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[list[dict]] = []
            for first in range(0, len(texts), texts_at_once):
                part = texts.iloc[first : first + texts_at_once].tolist()
                given = [text for text in part if text is not None]
                answers = [list(hits) for hits in detector(given)] if given else []
                if len(answers) != len(given):
                    raise ValueError(f"{len(answers)} answers for {len(given)} texts")
                found = iter(answers)
                out += [[] if text is None else [_finding(text, tuple(hit), rule_id, priority) for hit in next(found)] for text in part]
            yield pd.Series(out)

    # Not deterministic for the optimizer, which then never runs the detector twice.
    hook = F.pandas_udf(run, FINDINGS_TYPE).asNondeterministic()
    return df.withColumn(name, hook(F.col(text_col)))
