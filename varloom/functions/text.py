"""Text expressions: normalising, concatenating, matching, parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from varloom.roles import col


def _as_column(c: Column | str) -> Column:
    return col(c) if isinstance(c, str) else c


def chromosome(c: Column | str) -> Column:
    """Upper case without a leading CHR: chr17, CHR17 and 17 become 17."""
    return F.regexp_replace(F.upper(_as_column(c)), "^CHR", "")


def joined(columns: Sequence[Column | str], separator: str = "") -> Column:
    """Concatenate; a null counts as the empty text and keeps its separator."""
    parts = [F.coalesce(_as_column(c).cast("string"), F.lit("")) for c in columns]
    return F.concat_ws(separator, *parts)


def contains(c: Column | str, value: object) -> Column:
    """Case-insensitive LIKE '%value%' where % and _ in value stay wildcards."""
    return _as_column(c).cast("string").ilike(f"%{_literal_backslash(value)}%")


def starts_with(c: Column | str, value: object) -> Column:
    """Case-insensitive LIKE 'value%'."""
    return _as_column(c).cast("string").ilike(f"{_literal_backslash(value)}%")


def _literal_backslash(value: object) -> str:
    return str(value).replace("\\", "\\\\")


def first_non_empty(columns: Sequence[Column | str]) -> Column:
    """The first column that is neither null nor the empty text."""
    return F.coalesce(*[F.nullif(_as_column(c), F.lit("")) for c in columns])


def to_int(c: Column | str) -> Column:
    """Text to bigint; text that is no whole number becomes null."""
    return _as_column(c).cast("string").try_cast("bigint")


def to_number(c: Column | str) -> Column:
    return _as_column(c).try_cast("double")


# What counts as the text of a genomic region.
REGION_TEST = r"(?i)^chr([0-9]{1,2}|[XYM]):[0-9]+(-[0-9]+)?$"

# Region text: an optional chr, a name, a start and maybe an end.
REGION_PARTS = r"^(?:chr)?(\w+):(\d+)(?:-(\d+))?$"


def _region_part(c: Column | str, group: int) -> Column:
    """One part of a region text; digits may be grouped by commas."""
    plain = F.replace(F.trim(_as_column(c)), F.lit(","), F.lit(""))
    return F.nullif(F.regexp_extract(plain, REGION_PARTS, group), F.lit(""))


def region_chrom(c: Column | str) -> Column:
    return F.concat(F.lit("chr"), _region_part(c, 1))


def region_start(c: Column | str) -> Column:
    return _region_part(c, 2).try_cast("bigint")


def region_end(c: Column | str) -> Column:
    """The end of a region text, or its start when only one number is given."""
    return F.coalesce(_region_part(c, 3).try_cast("bigint"), region_start(c))


def region_text(chrom: Column | str, start: Column | str, end: Column | str) -> Column:
    return F.concat(
        _as_column(chrom), F.lit(":"), _as_column(start).cast("string"),
        F.lit("-"), _as_column(end).cast("string"),
    )


def region_label(chrom: Column | str, start: Column | str, end: Column | str) -> Column:
    """As :func:`region_text`, but a single position is written without an end."""
    point = F.concat(_as_column(chrom), F.lit(":"), _as_column(start).cast("string"))
    ranged = _as_column(end).isNotNull() & (_as_column(end) != _as_column(start))
    return F.when(ranged, region_text(chrom, start, end)).otherwise(point)


def is_region(c: Column | str) -> Column:
    return _as_column(c).rlike(REGION_TEST)


def clean_item(c: Column | str) -> Column:
    return F.upper(F.trim(_as_column(c)))
