"""Text forms: byte sizes and URI components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_bytes(b: Column) -> Column:
    """1024-based units; what isn't a finite size from 0 up is infinite."""
    x = b.cast("double")
    out = F.when(x < 1024, F.concat(b.cast("long").cast("string"), F.lit(" B")))
    for k, unit in ((1, "KB"), (2, "MB")):
        out = out.when(x < 1024 ** (k + 1), F.concat(F.format_string("%.1f", x / 1024**k), F.lit(f" {unit}")))
    out = out.otherwise(F.concat(F.format_string("%.1f", x / 1024**3), F.lit(" GB")))
    return F.when(x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf")), "∞").otherwise(out)


def encode_component(s: Column) -> Column:
    return F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))


def decode_component(s: Column) -> Column:
    """Null for a malformed escape; a plus sign stays one."""
    return F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))
