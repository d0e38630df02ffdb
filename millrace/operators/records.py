"""Records as text: the bar form, and the key:value form of stored entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

STATES = ("FAILURE", "OK", "EMPTY", "UNDEFINED")
STATE_KEY = "ProcessedDataInternalState"
#: How dates stand in stored entries.
DATES = "yyyy-MM-dd HH:mm:ss"


def record_to_string(record: Column, kind: StructType) -> Column:
    """A bar before every field; null is empty."""
    parts = []
    for f in kind.fields:
        v = record[f.name]
        if isinstance(f.dataType, StructType):
            v = record_to_string(v, f.dataType)
        elif isinstance(f.dataType, ArrayType):
            v = F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ", "), F.lit("]"))
        parts += [F.lit("|"), F.coalesce(v.cast("string"), F.lit(""))]
    return F.when(record.isNotNull(), F.concat(*parts) if parts else F.lit(""))


def serialize(fields: Column, state: Column, timestamp: Column | None = None, modified: Column | None = None) -> Column:
    """map<string,string>, state and two dates as `k:v|k:v|...|state|dates`, keys in
    order; null values are empty, null dates are left out. OK without fields is EMPTY."""
    entries = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(e["value"], F.lit(""))))
    state = F.when((state == "OK") & (F.size(fields) == 0), F.lit("EMPTY")).otherwise(state)
    dates = [F.when(d.isNotNull(), F.concat(F.lit(f"{k}:"), F.date_format(d, DATES))) for k, d in (("timestamp", timestamp), ("dataSourceModified", modified)) if d is not None]
    return F.array_join(F.concat(entries, F.array(F.concat(F.lit(f"{STATE_KEY}:"), state), *dates)), "|")


def unserialize(text: Column) -> Column:
    """Struct of fields (map), state, timestamp and dataSourceModified; only the first
    colon of a part splits, parts without one are passed over, of equal keys the last counts."""
    whole = F.filter(F.split(text, r"\|", -1), lambda p: p.contains(":"))
    keys = F.transform(whole, lambda p: F.substring_index(p, ":", 1))
    split = F.filter(whole, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(whole)), F.substring_index(p, ":", 1)))
    parts = F.str_to_map(F.array_join(split, "|"), F.lit(r"\|"), F.lit(":"))
    parts = F.when(F.size(split) > 0, parts)
    kept = F.map_filter(parts, lambda k, v: ~k.isin(STATE_KEY, "timestamp", "dataSourceModified"))
    date = lambda k: F.try_to_timestamp(parts[k], F.lit(DATES)).alias(k)
    return F.struct(kept.alias("fields"), F.coalesce(parts[STATE_KEY], F.lit("UNDEFINED")).alias("state"), date("timestamp"), date("dataSourceModified"))
