"""Version texts as comparable arrays of three numbers."""

from pyspark.sql import Column, functions as F

_FORM = r"^[\^~=v]*\d{1,9}(\.\d{1,9}){0,2}(\+.*)?$"


def version_key(version: str) -> Column:
    """[major, minor, patch]; null for ranges, tags and pre-releases: nothing is guessed."""
    bare = F.substring_index(F.ltrim(F.col(version), F.lit("^~=v")), "+", 1)
    # A missing part is an empty text, which is no number and counts as zero.
    numbers = [F.coalesce(F.split_part(bare, F.lit("."), F.lit(i)).try_cast("int"), F.lit(0))
               for i in (1, 2, 3)]
    return F.when(F.col(version).rlike(_FORM), F.array(*numbers))


def major(version: str) -> str:
    """SQL: leading number of the first part, else null."""
    return (f"try_cast(regexp_extract(split_part({version}, '.', 1), "
            r"'^\\s*(\\d{1,9})', 1) AS INT)")
