"""What happens to a finding: ``mask`` it, ``pass`` it through, or ``flag`` it and leave the text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.functions import spans
from hushframe.functions.catalog import Rule, chosen_rules

ACTIONS = ("mask", "pass", "flag")


def sanitize_with_policy(
    df: DataFrame,
    policy: Mapping[str, str],
    text_col: str = "text",
    rules: Sequence[Rule] | None = None,
    secrets: str = "mask",
) -> DataFrame:
    """Mask under a policy per entity type; ``secrets`` decides for values the detectors know.

    Adds ``masked_text``, ``tokens`` (masked values only) and ``flagged`` (findings
    left in the text on purpose).  Findings are dropped before numbering, so the
    text is never patched afterwards.
    """
    for action in [*policy.values(), secrets]:
        if action not in ACTIONS:
            raise ValueError(f"unknown action {action!r}; expected one of {ACTIONS}")
    rules = chosen_rules(rules)
    branches = "".join(f" WHEN _f.entity_type = {spans.quote(k)} THEN {spans.quote(v)}" for k, v in policy.items())
    default = f"CASE{branches} ELSE 'mask' END" if branches else "'mask'"
    action = default
    if secrets != "mask":
        action = f"CASE WHEN {spans.has_secret('_f.value')} THEN {spans.quote(secrets)} ELSE {default} END"
    found = spans.resolved_findings(text_col, rules)
    staged = df.withColumn(
        "_found",
        F.expr(
            f"transform({found}, _f -> named_struct('finding', _f, 'action', {action}))"
        ),
    )
    kept = "transform(filter(_found, _p -> _p.action = 'mask'), _p -> _p.finding)"
    flagged = "transform(filter(_found, _p -> _p.action = 'flag'), _p -> _p.finding)"
    return (
        staged.withColumn("_protected", F.expr(spans.protected(text_col, kept)))
        .withColumn("flagged", F.expr(flagged))
        .select(*df.columns, "_protected.*", "flagged")
    )
