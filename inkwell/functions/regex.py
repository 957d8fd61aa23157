"""Regular-expression functions over string columns: search semantics, null where nothing matches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

CASELESS, COMMENTS, DOTALL, MULTILINE, UNICODE_WORDS = "i", "x", "s", "m", "U"


def with_options(pattern: str, options: str = "") -> str:
    return f"(?{options}){pattern}" if options else pattern


def in_range(c: Column, start: int, length: int) -> Column:
    """The part of c that a function is to look at; start counts from 0."""
    return F.substring(c, start + 1, length)


def is_matched(c: Column, pattern: str, options: str = "") -> Column:
    return c.rlike(with_options(pattern, options))


def matching(c: Column, pattern: str, capture: int = 0, options: str = "") -> Column:
    """A capture of the first match; null without a match, "" for a group that took no part."""
    p = with_options(pattern, options)
    return F.when(c.rlike(p), F.regexp_extract(c, p, capture))


def range_of(c: Column, pattern: str, capture: int = 0, options: str = "") -> Column:
    """struct(location from 0, length) of the first match, or of a capture of it."""
    p = with_options(pattern, options)
    if capture == 0:
        whole = F.regexp_substr(c, F.lit(p))
        return F.when(c.rlike(p), F.struct((F.regexp_instr(c, F.lit(p)) - 1).alias("location"), F.length(whole).alias("length")))

    @F.pandas_udf("struct<location:int,length:int>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compiled = regex.compile(p)
        for texts in batches:
            found = [compiled.search(x) if x is not None else None for x in texts]
            at = [m.span(capture) if m and m.start(capture) >= 0 else (None, None) for m in found]
            yield pd.DataFrame({"location": pd.array([a for a, _ in at], "Int32"), "length": pd.array([b - a if a is not None else None for a, b in at], "Int32")})

    return spans(c)


def replaced(c: Column, pattern: str, template: str, options: str = "") -> Column:
    """Every match replaced; $n in template stands for a capture."""
    return F.regexp_replace(c, with_options(pattern, options), template)


def replaced_by(c: Column, pattern: str, make: Callable[[list[str]], str], options: str = "") -> Column:
    """Every match replaced by what make returns for its captures, [whole, first, ...]. It runs in Python, in batches."""
    p = with_options(pattern, options)

    @F.pandas_udf("string")
    def replace(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = regex.compile(p)
        for texts in batches:
            yield texts.map(lambda x: None if x is None else compiled.sub(lambda m: make([m[0], *(g or "" for g in m.groups())]), x))

    return replace(c)


def components_matched(c: Column, pattern: str, capture: int = 0, options: str = "") -> Column:
    return F.regexp_extract_all(c, F.lit(with_options(pattern, options)), F.lit(capture))


def components_separated(c: Column, pattern: str, options: str = "") -> Column:
    return F.split(c, with_options(pattern, options), -1)


def capture_components(c: Column, pattern: str, captures: int, options: str = "") -> Column:
    """Captures 0 to captures of the first match; an empty array without one."""
    p = with_options(pattern, options)
    found = F.array(*(F.regexp_extract(c, p, i) for i in range(captures + 1)))
    return F.when(c.rlike(p), found).when(c.isNotNull(), F.array().cast("array<string>"))


def array_of_captures(c: Column, pattern: str, captures: int, options: str = "") -> Column:
    """For every match an array of its captures."""
    parts = [components_matched(c, pattern, i, options).alias(f"c{i}") for i in range(captures + 1)]
    return F.transform(F.arrays_zip(*parts), lambda m: F.array(*(m[f"c{i}"] for i in range(captures + 1))))


def dictionary(c: Column, pattern: str, keys: dict[str, int], options: str = "") -> Column:
    """A map from keys to captures of the first match; null without one."""
    p = with_options(pattern, options)
    pairs = [x for key, i in keys.items() for x in (F.lit(key), F.regexp_extract(c, p, i))]
    return F.when(c.rlike(p), F.create_map(*pairs))


def array_of_dictionaries(c: Column, pattern: str, keys: dict[str, int], options: str = "") -> Column:
    parts = [components_matched(c, pattern, i, options).alias(f"c{n}") for n, i in enumerate(keys.values())]
    pairs = lambda m: [x for n, key in enumerate(keys) for x in (F.lit(key), m[f"c{n}"])]
    return F.transform(F.arrays_zip(*parts), lambda m: F.create_map(*pairs(m)))


def enumerated(c: Column, pattern: str, options: str = "") -> Column:
    """A row per match."""
    return F.explode(components_matched(c, pattern, 0, options))


def enumerated_between(c: Column, pattern: str, options: str = "") -> Column:
    """A row per part between matches."""
    return F.explode(components_separated(c, pattern, options))


def capture_count(spark: SparkSession, pattern: str) -> int:
    return spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()


def is_valid(spark: SparkSession, pattern: str) -> bool:
    try:
        capture_count(spark, pattern)
    except IllegalArgumentException:
        return False
    return True
