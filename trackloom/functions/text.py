"""Scalar rules for labels, tags and annotators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: spellings of behaviours and the behaviour each stands for
BEHAVIORS = {
    "dwelling": "dwelling", "dwell": "dwelling", "nondwelling": "nondwelling", "non-dwelling": "nondwelling", "non_dwelling": "nondwelling",
    "crawling": "crawling", "crawl": "crawling", "run": "crawling", "turning": "turning", "turn": "turning", "arc": "nondwelling",
}
#: fixed values: the main behaviours of the closed list
MAIN_BEHAVIORS = ("dwelling", "nondwelling", "crawling", "turning", "other")


def strip(value: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def behavior(value: Column, spellings: dict[str, str] = BEHAVIORS) -> Column:
    """Trimmed, lower case, known spellings replaced; others stay."""
    key = F.lower(strip(value))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in spellings.items() for x in pair]), key), key)


def main_behavior(value: Column, spellings: dict[str, str] = BEHAVIORS, main: tuple[str, ...] = MAIN_BEHAVIORS) -> Column:
    """The closed list: what isn't a main behaviour is ``other``; null stays null."""
    known = behavior(value, spellings)
    return F.when(known.isin(*main), known).when(value.isNotNull(), "other")


def tag_tokens(tags: Column) -> Column:
    """The trimmed, non-empty tokens of a ``;`` list, as written; an empty array for null."""
    return F.coalesce(F.filter(F.transform(F.split(tags, ";"), strip), lambda t: t != ""), F.array().cast("array<string>"))


def canonical_tags(tags: Column) -> Column:
    """Lower case, trimmed, without empty and repeated ones, in order."""
    return F.array_join(F.array_distinct(F.transform(tag_tokens(tags), F.lower)), ";")


def has_tag(tags: Column, *wanted: str) -> Column:
    """Whether one of the tokens is wanted; case counts; false for null."""
    return F.arrays_overlap(tag_tokens(tags), F.array(*[F.lit(w) for w in wanted]))


def tags_contain(tags: Column, part: str) -> Column:
    """Whether the text contains a part, in any case; false for null."""
    return F.coalesce(F.contains(F.lower(tags), F.lit(part.lower())), F.lit(False))


def tags_are(tags: Column, *wanted: str) -> Column:
    """Whether the whole text is one of the wanted ones; false for null."""
    return F.coalesce(tags.isin(*wanted), F.lit(False))


def annotator(value: Column, default: str = "unknown") -> Column:
    """Trimmed; the default for null and blank."""
    return F.coalesce(F.nullif(strip(value), F.lit("")), F.lit(default))


def truth_label(behaviors: Column, tags: Column, tag: str | None = None) -> Column:
    """1 for dwelling (with a tag that contains ``tag``, if given), 0 for nondwelling, else null."""
    dwelling = behaviors == "dwelling"
    if tag is not None:
        dwelling = dwelling & tags_contain(tags, tag)
    return F.when(dwelling, 1).when(behaviors == "nondwelling", 0)


def quantised(et: Column, scale: int = 10_000) -> Column:
    """A time as a whole number of 1/scale seconds, half to even; wide enough for any recording."""
    return F.rint(et.cast("double") * scale).cast("long")
