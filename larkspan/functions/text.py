"""URL, HTML, message and section functions."""

from __future__ import annotations

import html as html_lib
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from . import fixed, selectors

#: Marks of junk lines, marks of divider lines, bullets, and block tags.
JUNK_CLASS = r"""[\s\-─━═■□▪▸►•*~=_|/\\,.;:!?@#$%^&*()\[\]{}<>«»""''`]"""
DIVIDER_CLASS = r"""[\s\-─━═▬•*~=_|/\\,.;:!?\[\]{}<>«»""''`]"""
BULLET = r"^[•\-]\s*"
BLOCK_TAGS = {"p", "div", "br", "tr", "h1", "h2", "h3", "h4", "h5", "h6"}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_url(url: Column | str, base: str | None = None) -> Column:
    """scheme, host and path; a relative url is taken from base's host (absolute path) or folder, its . and .. segments are resolved; one without a
    path is base's."""
    u = _c(url)
    if not base:
        return F.regexp_replace(u, "[?#].*$", "")
    plain = re.sub("[?#].*$", "", base)
    scheme, rest = plain.split("://", 1)
    root = f"{scheme}://{rest.split('/')[0]}"
    folder = plain.rsplit("/", 1)[0] if "/" in rest else root
    cut = F.regexp_replace(u, "[?#].*$", "")
    relative = F.when(cut.startswith("/"), cut).otherwise(F.concat(F.lit(folder[len(root) :] + "/"), cut))
    segments = F.split(F.substring(relative, 2, (1 << 31) - 1), "/")
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    # A last . or .. stands for a folder.
    path = F.concat(F.lit("/"), F.array_join(F.concat(kept, F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/"))
    joined = F.concat(F.lit(root), F.when(relative.rlike(r"(^|/)\.\.?(/|$)"), path).otherwise(relative))
    return F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), cut).when(u.startswith("//"), F.concat(F.lit(scheme + ":"), cut)).when(cut == "", F.lit(plain)).otherwise(joined)


def id_from_url(url: Column | str, pattern: str) -> Column:
    """the pattern's first group, else the last path segment."""
    u = _c(url)
    trimmed = F.regexp_replace(F.regexp_replace(u, "[?#].*$", ""), "/+$", "")
    return F.coalesce(F.nullif(F.regexp_extract(u, pattern, 1), F.lit("")), F.element_at(F.split(trimmed, "/"), -1))


def links(html: Column | str, pattern: str, fallback: str | None = None) -> Column:
    """All href values that match, in double quotes, single ones or none; the fallback pattern where there are none."""
    quoted = [r'"([^"]*)"', "'([^']*)'", r"""([^\s"'>]+)"""]
    values = F.array_distinct(F.concat(*(F.regexp_extract_all(_c(html), F.lit(rf"(?i)\shref\s*=\s*{q}"), F.lit(1)) for q in quoted)))
    matching = lambda p: F.filter(values, lambda v: v.rlike(f"^(?:{p})$"))
    found = matching(pattern)
    return found if fallback is None else F.when(F.size(found) > 0, found).otherwise(matching(fallback))


def is_junk_line(line: Column) -> Column:
    """blank is not junk; up to 2 characters, or marks only, is."""
    t = F.trim(line)
    return (t != "") & ((F.length(t) <= 2) | t.rlike(f"^{JUNK_CLASS}+$"))


def strip_bullet(line: Column) -> Column:
    """F6."""
    return F.regexp_replace(line, BULLET, "")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in ("script", "style")
        self.parts.append("\n• " if tag == "li" else "\n" if tag in BLOCK_TAGS else "")

    def handle_endtag(self, tag: str) -> None:
        self.skip -= tag in ("script", "style") and self.skip > 0
        self.parts.append("\n" if tag == "li" or tag in BLOCK_TAGS else "")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)


def _plain(raw: str | None) -> str | None:
    if raw is None:
        return None
    parser = _Text()
    parser.feed(html_lib.unescape(raw))
    parser.close()
    text = html_lib.unescape("".join(parser.parts))
    return unicodedata.normalize("NFKC", "".join(c for c in text if c in "\t\n\r" or unicodedata.category(c) != "Cc"))


@F.pandas_udf(StringType())
def html_plain(raw: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The part of F4 without a built-in: entities, tags, control characters, NFKC."""
    for s in raw:
        yield s.map(_plain, na_action="ignore")


def tidy_lines(text: Column) -> Column:
    """The rest of F4: repeated marks, junk lines, bullets; one paragraph, null if empty."""
    t = F.regexp_replace(F.regexp_replace(text, r"[!?]+([!?])", "$1"), r"\.{4,}", "...")
    lines = F.filter(F.transform(F.split(t, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: ~is_junk_line(x))
    return F.nullif(F.trim(F.array_join(F.transform(lines, strip_bullet), " ")), F.lit(""))


def html_clean(raw: Column | str) -> Column:
    """F4."""
    return tidy_lines(html_plain(_c(raw)))


def css_text(html: Column | str, tag: str | None = None, attribute: str | None = None, value: str | None = None) -> Column:
    """stripped text of the first element with this tag, and attribute (of this value); null if there is none. Several fields of one page are found in
    one pass by ``selectors.page_fields``."""
    return selectors.page_fields(_c(html), {"text": selectors.Field((tag, attribute, value))})["text"]


def message_clean(raw: Column | str, labels: str = fixed.MESSAGE_LABELS) -> Column:
    """a channel message as one paragraph, null if nothing is left. labels: words that, before a colon at a line's start, are dropped. A line that
    is a bullet only ends the paragraph."""
    lines = F.transform(F.split(_c(raw), r"\r\n|\r|\n"), lambda x: F.trim(x))
    lines = F.filter(lines, lambda x: (x != "") & ~x.rlike(f"^{DIVIDER_CLASS}{{3,}}$"))
    lines = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(x, f"^(?iu:{labels})\\s*:\\s*", "")), r"(?U)[#@]\w+\s*", "")))
    lines = F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.trim(strip_bullet(x)))
    # Empty lines stand for paragraph breaks; outer ones go.
    joined = F.regexp_replace(F.array_join(F.transform(lines, lambda x: F.when(x == "", "\x01").otherwise(x)), " "), " *\x01[\x01 ]*", "\n\n")
    return F.nullif(F.regexp_replace(joined, r"^\s+|\s+$", ""), F.lit(""))


def _groups(pattern: str) -> int:
    """Capturing groups of a pattern: open brackets that are neither escaped, nor in a character class, nor followed by a question mark (but for names)."""
    n, i, inside = 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "(":
            rest = pattern[i + 1 : i + 4]
            n += not rest.startswith("?") or (rest.startswith("?<") and rest[2:3] not in ("=", "!"))
        i += 1
    return n


def sections(text: Column | str, headers: list[tuple[str, str]] = fixed.SECTIONS) -> Column:
    """F8a-c: array of (key, content), the preamble under key ''. headers: (pattern, key), the earlier wins at one offset. Contents that belong to
    one key stay separate rows of the array, in order. The text is matched once, by all patterns together, and split at the headers, so neither a key
    nor a header is searched again: of headers within one another the outer one counts. The control characters 1 to 3 of a text become blanks."""
    t, group, marks = F.translate(_c(text), "\x01\x02\x03", "   "), 1, []
    for pattern, _ in headers:
        marks.append(f"${group}")
        group += 1 + _groups(pattern)
    if headers:
        either = "|".join(f"({pattern})" for pattern, _ in headers)
        # Which group matched tells the key; the others are empty.
        t = F.regexp_replace(t, f"(?iu)(?:{either})", "\x01" + "\x03".join(marks) + "\x02")
    parts = F.split(t, "\x01")
    keys = F.array(*(F.lit(key) for _, key in headers)) if headers else F.array().cast("array<string>")
    which = lambda p: F.get(keys, F.array_position(F.transform(F.split(F.substring_index(p, "\x02", 1), "\x03"), lambda g: g != ""), True).cast("int") - 1)
    tidy = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^[•\-*_\s]+", ""), " {3,}", "  "))
    return F.transform(parts, lambda p: F.when(p.contains("\x02"), F.struct(which(p).alias("key"), tidy(F.substring_index(p, "\x02", -1)).alias("content"))).otherwise(F.struct(F.lit("").alias("key"), F.trim(p).alias("content"))))


def nested_sections(text: Column | str, headers: list[tuple[str, str]] = fixed.SECTIONS) -> Column:
    """F8a, W7 as the hits of each pattern by itself, so a header within another one counts as well, and leaves the outer one without content. The same
    array as ``sections``. headers: (pattern, key), of hits at one offset the earlier one counts; a section reaches from a hit's end to the next hit's
    start. The texts are cut in Python, in batches."""
    patterns = [(re.compile(p, re.IGNORECASE), key) for p, key in headers]

    @F.pandas_udf(ArrayType(StructType([StructField("key", StringType()), StructField("content", StringType())])))
    def cut(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict] | None:
            if t is None:
                return None
            hits: dict[int, tuple[int, str]] = {}
            for pattern, key in patterns:
                for m in pattern.finditer(t):
                    hits.setdefault(m.start(), (m.end(), key))
            at = sorted(hits)
            ends = [*at, len(t)]
            return [{"key": "", "content": t[: ends[0]]}, *({"key": hits[a][1], "content": t[hits[a][0] : max(b, hits[a][0])]} for a, b in zip(at, ends[1:]))]

        return texts.map(one)

    tidy = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^[•\-*_\s]+", ""), " {3,}", "  "))
    return F.transform(cut(_c(text)), lambda p: F.struct(p["key"].alias("key"), F.when(p["key"] == "", F.trim(p["content"])).otherwise(tidy(p["content"])).alias("content")))


def merge_sections(parts: Column, noise: list[str] = fixed.NOISE) -> Column:
    """Contents of a key joined by newline, in order of first appearance; noise keys and the preamble left out."""
    keep = F.filter(parts, lambda p: (p["key"] != "") & ~p["key"].isin(noise))
    keys = F.array_distinct(F.transform(keep, lambda p: p["key"]))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.array_join(F.transform(F.filter(keep, lambda p: p["key"] == k), lambda p: p["content"]), "\n").alias("content")))


def format_sections(text: Column | str, headers: list[tuple[str, str]] = fixed.SECTIONS, noise: list[str] = fixed.NOISE) -> Column:
    """F8d: the text itself where it has no section, else preamble and contents by blank lines."""
    parts = sections(text, headers)
    body = F.array_join(F.filter(F.concat(F.array(parts[0]["content"]), F.transform(merge_sections(parts, noise), lambda p: p["content"])), lambda x: x != ""), "\n\n")
    return F.when(F.size(parts) <= 1, _c(text)).otherwise(body)


def extract_json(raw: Column | str) -> Column:
    """fenced object, else first brace to last brace, else null."""
    r = _c(raw)
    fenced = F.regexp_extract(r, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(F.regexp_extract(r, r"(?s)\{.*\}", 0), F.lit("")))


def salvage_json(raw: Column | str) -> Column:
    """the text if it parses, else F19's part if that does, else null; as a variant."""
    return F.coalesce(F.try_parse_json(_c(raw)), F.try_parse_json(extract_json(raw)))


def json_posting(html: Column | str) -> Column:
    """First JSON-LD object with @type JobPosting, in a script by itself or as an element of its list, '{}' if none; scripts that don't parse are
    skipped."""
    scripts = F.regexp_extract_all(_c(html), F.lit(r"""(?is)<script[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>"""), F.lit(1))
    objects = F.flatten(F.transform(scripts, lambda s: F.when(F.trim(s).startswith("["), F.coalesce(F.from_json(s, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(s))))
    good = F.filter(objects, lambda s: F.try_parse_json(s).isNotNull() & (F.get_json_object(s, "$['@type']") == "JobPosting"))
    return F.coalesce(F.get(good, F.lit(0)), F.lit("{}"))


def nested(ld: Column, *path: str) -> Column:
    """the string at a path of a JSON text, null where there is none or something else."""
    value = F.try_variant_get(F.try_parse_json(ld), "$" + "".join(f"['{p}']" for p in path), "variant")
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))


def element_name(element: Column, bare: bool = True) -> Column:
    """an object's name, a bare string itself (or '' where bare ones don't count), else ''. element: a variant."""
    kind = F.schema_of_variant(element)
    name = F.when(kind.startswith("OBJECT"), F.try_variant_get(element, "$.name", "string"))
    return F.coalesce(name, F.when((kind == "STRING") & F.lit(bare), element.cast("string")), F.lit(""))


def truncated(text: Column, n: int) -> Column:
    """the first n characters; null as ''."""
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def defaulted(extracted: Column, lists: list[str], scalars: list[str] = ()) -> Column:
    """a struct with the given fields of a JSON text; absent lists (of JSON values, as text) are empty, absent scalars null."""
    fields = [F.coalesce(F.from_json(F.get_json_object(extracted, f"$.{name}"), "array<string>"), F.array().cast("array<string>")).alias(name) for name in lists]
    return F.struct(*fields, *(F.get_json_object(extracted, f"$.{name}").alias(name) for name in scalars))


def is_remote(ld: Column | str, text: Column | str, words: str = fixed.REMOTE) -> Column:
    """F18."""
    return F.coalesce(F.get_json_object(_c(ld), "$.jobLocationType") == "TELECOMMUTE", F.lit(False)) | F.coalesce(_c(text).rlike(f"(?iu){words}"), F.lit(False))


def tolerant_number(variant: Column, path: str) -> Column:
    """a number at a path, from number or text; null if neither."""
    return F.try_variant_get(variant, path, "double")


def fill_template(template: str, **values: Column) -> Column:
    """{name} placeholders replaced; other braces stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def embedding_text(domain: Column, description: Column) -> Column:
    """F23."""
    return F.when(F.coalesce(domain, F.lit("")) != "", F.concat(F.lit("Domain: "), domain, F.lit(". "), description)).otherwise(description)
