"""Masking of records with structs, arrays and maps: every string leaf, with one numbering per record."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions import spans
from hushframe.functions.catalog import Rule, chosen_rules
from hushframe.functions.columns import restored



def _has_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StringType):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_text(kind.valueType)
    return isinstance(kind, T.StructType) and any(_has_text(f.dataType) for f in kind.fields)


def _leaves(value: str, kind: T.DataType, depth: int = 0) -> str:
    """``array<string>`` of all string leaves of ``value`` in the order of the schema; null ones count, null parents have none."""
    if isinstance(kind, T.StringType):
        return f"array({value})"
    empty = "cast(array() AS array<string>)"
    if isinstance(kind, T.StructType):
        parts = [_leaves(f"{value}.`{f.name}`", f.dataType, depth) for f in kind.fields if _has_text(f.dataType)]
        joined = f"concat({', '.join(parts)})"
    else:
        items, inner = (value, kind.elementType) if isinstance(kind, T.ArrayType) else (f"map_values({value})", kind.valueType)
        name = f"_v{depth}"
        joined = f"flatten(transform({items}, {name} -> {_leaves(name, inner, depth + 1)}))"
    return f"CASE WHEN {value} IS NULL THEN {empty} ELSE {joined} END"


def _rebuilt(value: str, kind: T.DataType, leaf, depth: int = 0) -> str:
    """``value`` with every string leaf replaced by ``leaf(expression)``; the type stays the same."""
    if not _has_text(kind):
        return value
    if isinstance(kind, T.StringType):
        return leaf(value)
    name = f"_w{depth}"
    if isinstance(kind, T.ArrayType):
        return f"transform({value}, {name} -> {_rebuilt(name, kind.elementType, leaf, depth + 1)})"
    if isinstance(kind, T.MapType):
        return f"transform_values({value}, (_key{depth}, {name}) -> {_rebuilt(name, kind.valueType, leaf, depth + 1)})"
    fields = ", ".join(f"{spans.quote(f.name)}, {_rebuilt(f'{value}.`{f.name}`', f.dataType, leaf, depth)}" for f in kind.fields)
    return f"CASE WHEN {value} IS NOT NULL THEN named_struct({fields}) END"


def mask_nested(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    rules: Sequence[Rule] | None = None,
    exclusions: Iterable[str] = (),
) -> DataFrame:
    """Mask every string inside ``cols`` (all columns by default), however deep; adds ``tokens``.

    Strings stand in structs, arrays and the values of maps; keys of maps stay as they
    are.  One record shares one numbering, in the order of the schema and of arrays and
    maps.  Types and nulls are kept, and nothing is shuffled.
    """
    rules = chosen_rules(rules)
    wanted = [f for f in df.schema.fields if (cols is None or f.name in cols) and _has_text(f.dataType)]
    if not wanted:
        return df.withColumn("tokens", F.expr("cast(array() AS array<struct<token:string,entity_type:string,value:string>>)"))
    found = spans.resolved_findings("_leaf", rules, exclusions)
    # All leaves count as one text: each starts one character after the end of the one before.
    staged = df.withColumn("_leaves", F.expr("concat(" + ", ".join(_leaves(f"`{f.name}`", f.dataType) for f in wanted) + ")"))
    staged = staged.withColumn("_hits", F.expr(f"transform(_leaves, _leaf -> {found})"))
    bases = spans._running("_leaves", "_c.at", "_c.at + coalesce(length(_x), 0) + 1")
    moved = (
        "flatten(zip_with(_hits, _bases, (_h, _base) -> transform(_h, _f -> named_struct("
        "'start', _f.start + _base, 'end', _f.end + _base, 'priority', _f.priority,"
        " 'entity_type', _f.entity_type, 'rule_id', _f.rule_id, 'value', _f.value))))"
    )
    reserved = f"flatten(transform(_leaves, _leaf -> coalesce({spans.reserved_tokens('_leaf')}, cast(array() AS array<string>))))"
    numbered = spans.numbered_values(spans.bind(bases, "_bases", moved), reserved)
    none = "cast(array() AS array<struct<token:string,entity_type:string,value:string,spans:array<struct<start:int,end:int>>>>)"
    staged = staged.withColumn("_numbered", F.expr(f"CASE WHEN size(flatten(_hits)) = 0 THEN {none} ELSE {numbered} END"))
    staged = staged.withColumn(
        "_lookup", F.expr(f"map_from_entries(transform(_numbered, _n -> struct({spans._key('_n')}, _n.token)))")
    )

    def leaf(value: str) -> str:
        edits = f"transform({spans.resolved_findings('_s', rules, exclusions)}, _f -> named_struct('start', _f.start, 'end', _f.end, 'token', _lookup[{spans._key('_f')}]))"
        masked = spans.bind(value, "_s", f"CASE WHEN _s IS NULL THEN _s ELSE {spans.rewrite('_s', edits)} END")
        return f"CASE WHEN size(_lookup) = 0 THEN {value} ELSE {masked} END"

    rebuilt = {f.name: F.expr(_rebuilt(f"`{f.name}`", f.dataType, leaf)).alias(f.name) for f in wanted}
    tokens = F.expr("transform(_numbered, _n -> named_struct('token', _n.token, 'entity_type', _n.entity_type, 'value', _n.value))")
    return staged.select(*[rebuilt.get(c, F.col(f"`{c}`")) for c in df.columns], tokens.alias("tokens"))


def reveal_nested(df: DataFrame, cols: Sequence[str] | None = None, tokens_col: str = "tokens") -> DataFrame:
    """Put the originals back into every string of ``cols`` from the record's own token array."""
    lookup = f"map_from_entries(transform({tokens_col}, _t -> struct(_t.token, _t.value)))"
    wanted = [f for f in df.schema.fields if f.name != tokens_col and (cols is None or f.name in cols) and _has_text(f.dataType)]

    def leaf(value: str) -> str:
        return spans.bind(value, "_s", restored("_s", "_tokens"))

    rebuilt = {f.name: F.expr(_rebuilt(f"`{f.name}`", f.dataType, leaf)).alias(f.name) for f in wanted}
    staged = df.withColumn("_tokens", F.expr(lookup))
    return staged.select(*[rebuilt.get(c, F.col(f"`{c}`")) for c in df.columns])
