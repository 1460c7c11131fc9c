"""Rule tables: ordered first match, all matches, include/exclude reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Value of the first pattern found, null if none. Null text: null."""
    out = F.lit(None).cast("string")
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def all_matches(text: Column, rules: list[tuple[str, str]], fallback: Column | None = None) -> Column:
    """Distinct values of all patterns found, in rule order; the fallback alone where there are none."""
    found = F.array_distinct(F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(v)) for p, v in rules))))
    return found if fallback is None else F.when(F.size(found) > 0, found).otherwise(F.array(fallback))


def contains_first(text: Column, rules: list[tuple[list[str], str]]) -> Column:
    """Value of the first rule of which a keyword is contained."""
    out = F.lit(None).cast("string")
    for words, value in reversed(rules):
        out = F.when(reduce(lambda a, b: a | b, (text.contains(w) for w in words)), F.lit(value)).otherwise(out)
    return out


def reasons(text: Column, rules: list[tuple[str, str | None, str]], existing: Column | None = None) -> Column:
    """Labels of rules (include, exclude, label) whose include pattern is found and whose exclude pattern is not, each once, joined by '; ' after the
    existing ones; null if there are none."""
    hits = F.array_compact(F.array(*(F.when(text.rlike(i) & (~text.rlike(e) if e else F.lit(True)), F.lit(label)) for i, e, label in rules)))
    old = F.filter(F.split(F.coalesce(existing, F.lit("")), "; "), lambda x: x != "") if existing is not None else F.array().cast("array<string>")
    return F.nullif(F.array_join(F.array_distinct(F.concat(old, hits)), "; "), F.lit(""))


def too_short(text: Column, least: int = 50) -> Column:
    """P2, P11."""
    return F.length(F.trim(text)) < least


def _any_case(pattern: str) -> str:
    return f"(?iuU){pattern}"


def grade(title: Column, specific_first: bool = True) -> Column:
    """grade by title. By the given order alone 'Middle/Senior' and 'Junior/Middle' are never reached; with ``specific_first`` they are tried first."""
    table = sorted(fixed.GRADES, key=lambda r: "/" not in r[1]) if specific_first else fixed.GRADES
    return first_match(title, [(_any_case(p), v) for p, v in table])


def title_grade(title: Column) -> Column:
    """Grade by title where there is no description to read. Null or empty titles have none."""
    return first_match(F.lower(title), [(_any_case(p), v) for p, v in fixed.TITLE_GRADES])


def title_class(title: Column) -> Column:
    """F11."""
    return contains_first(F.lower(title), [([w.lower() for w in words], v) for words, v in fixed.TITLE_CLASSES])


def positions(title: Column) -> Column:
    """the names of all positions found, in the order of the patterns; the first word where there are none. Null or blank titles: empty."""
    names = F.create_map(*(F.lit(x) for kv in fixed.POSITION_NAMES.items() for x in kv))
    clean = lambda c: F.regexp_replace(c, r"^[ \t\r\n/|,()]+|[ \t\r\n/|,()]+$", "")
    named = lambda c: F.coalesce(names[F.lower(clean(c))], F.nullif(clean(c), F.lit("")))
    found = F.array_distinct(F.array_compact(F.array(*(F.nullif(named(F.regexp_extract(title, f"(?iu){p}", 0)), F.lit("")) for p in fixed.POSITIONS))))
    first = named(F.regexp_replace(F.regexp_extract(title, r"\S+", 0), r"[ ,\-/|]+$", ""))
    return F.when(title.isNull(), F.array().cast("array<string>")).when(F.size(found) > 0, found).otherwise(F.array_compact(F.array(first)))


def review_reasons(title: Column, description: Column, existing: Column | None = None) -> Column:
    """Reasons to review a row, each once after the existing ones, null if there are none: a title that is not relevant, or else a description of
    under 50 characters on a row without a reason so far."""
    irrelevant = [(_any_case(i), _any_case(e) if e else None, fixed.IRRELEVANT_REASON) for i, e in fixed.IRRELEVANT]
    first = reasons(F.lower(title), irrelevant, existing)
    return F.coalesce(first, F.when(too_short(description), F.lit(fixed.SHORT_REASON)))


def wanted_message(text: Column) -> Column:
    """Whether a message has a needed tag and no excluding one, in whatever case. Null: no."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda tags: reduce(lambda a, b: a | b, (low.contains(x) for x in tags))
    return has(fixed.NEEDED_TAGS) & ~has(fixed.EXCLUDING_TAGS)
