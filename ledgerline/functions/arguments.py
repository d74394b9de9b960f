"""Endpoints and ranges as they are written on command lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def endpoint(text: Column) -> Column:
    """``host:port`` as a struct; an empty host or * is any address; null without a port or with one that can't be."""
    host, port = F.regexp_extract(text, r"^(.*):[^:]*$", 1), F.regexp_extract(text, r":(\d{1,9})$", 1)
    number = F.when(port != "", port.cast("int"))
    return F.when(number <= 65535, F.struct(F.when(host.isin("", "*"), "0.0.0.0").otherwise(host).alias("host"), number.alias("port")))


def drop_range(text: Column) -> Column:
    """``first-last[:lines]`` as a struct with a flag a line; both lines unless some are named."""
    pattern = r"^(\d+)-(\d+)(?::([ab]+))?$"
    lines = F.regexp_extract(text, pattern, 3)
    on = lambda name: (lines == "") | lines.contains(name)
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).cast("long").alias("first"), F.regexp_extract(text, pattern, 2).cast("long").alias("last"), on("a").alias("line_a"), on("b").alias("line_b")))
