"""Fold of an operation log: layered configuration with the history of every key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import shown_value

STATE = "struct<kind:string,scalar:string,items:array<string>>"


def _state(kind: str, scalar: Column | None = None, items: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(kind).alias("kind"), (none if scalar is None else scalar).cast("string").alias("scalar"),
        (F.array() if items is None else items).cast("array<string>").alias("items"),
    )


def apply_op(state: Column, op: Column, value: Column) -> Column:
    """clear forgets; set replaces; add appends (a scalar becomes the first of two);
    remove drops equal items (an array left empty is null), or an equal scalar."""
    kind, scalar, items = state["kind"], state["scalar"], state["items"]
    rest = F.filter(items, lambda x: ~x.eqNullSafe(value))
    added = (
        F.when(kind == "array", _state("array", items=F.concat(items, F.array(value))))
        .when(kind == "scalar", _state("array", items=F.array(scalar, value))).otherwise(_state("array", items=F.array(value)))
    )
    removed = (
        F.when(kind == "array", F.when(F.size(rest) == 0, _state("null")).otherwise(_state("array", items=rest)))
        .when((kind == "scalar") & scalar.eqNullSafe(value), _state("null")).otherwise(state)
    )
    return F.when(op == "clear", _state("null")).when(op == "set", _state("scalar", value)).when(op == "add", added).when(op == "remove", removed).otherwise(state)


def fold(ops: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """ops(key, order, op, value) folded per key in order: `value` shown, its `kind`,
    and `history`, the shown value after each operation.

    The log of one key is folded in one row: keys are settings, not events, and their
    logs are short; a log too long for a row has no final value worth showing.
    """
    step = F.struct(*order, F.col("op"), F.col("value"))
    logs = ops.groupBy(*key).agg(F.sort_array(F.collect_list(step)).alias("__log"))
    start = F.struct(_state("null").alias("now"), F.array().cast("array<string>").alias("history"))

    def merge(acc: Column, x: Column) -> Column:
        now = apply_op(acc["now"], x["op"], x["value"])
        shown = shown_value(now["kind"], now["scalar"], now["items"])
        return F.struct(now.alias("now"), F.concat(acc["history"], F.array(shown)).alias("history"))

    done = logs.withColumn("__end", F.aggregate("__log", start, merge))
    now = F.col("__end.now")
    return done.select(*key, shown_value(now["kind"], now["scalar"], now["items"]).alias("value"), now["kind"].alias("kind"), F.col("__end.history").alias("history"))


def apply_ops(ops: list[tuple[str, str | None]]) -> list[str]:
    """The shown value after each (op, value): the fold in plain Python, for tests."""
    now: str | list[str] | None = None
    out = []
    for op, value in ops:
        if op == "clear":
            now = None
        elif op == "set":
            now = value
        elif op == "add":
            now = [*now, value] if isinstance(now, list) else [value] if now is None else [now, value]
        elif op == "remove":
            if isinstance(now, list):
                now = [x for x in now if x != value] or None
            elif now == value:
                now = None
        if now is None:
            out.append("nil")
        elif isinstance(now, list):
            out.append(f"[Array x{len(now)}] {now[-1]}")
        else:
            out.append(now if len(now) <= 50 else now[:47] + "...")
    return out
