"""Pages to records (S5, S7-S9, F1-F3, F18, F24, F25, F35, F44) and the hook for an external extractor."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, money, selectors, text


@dataclass(frozen=True)
class Site:
    """Where a site's pages hold what: for each field the selector of its first element, or (tag, attribute, value)."""

    source: str
    id_pattern: str
    title: str | tuple = (None, None, None)
    company: str | tuple = (None, None, None)
    location: str | tuple = (None, None, None)
    pay: str | tuple = (None, None, None)
    description: str | tuple = (None, None, None)


FIELDS = ["vacancy_id", "source", "title", "company_name", "location", "salary_from", "salary_to", "currency", "description", "remote", "published_at"]


def record(pages: DataFrame, site: Site, url: str = "url", html: str = "html", upto: str = "до", since: str = "от", remote_words: str = fixed.REMOTE) -> DataFrame:
    """The eleven fields of each page: from its JSON-LD posting, else from the site's elements. Pay from the elements counts only where the
    posting has neither bound. All elements are found in one pass over the page. Columns of the pages stay beside."""
    wanted = {f: selectors.Field(getattr(site, f)) for f in ("title", "company", "location", "pay", "description") if getattr(site, f) != (None, None, None)}
    ld = pages.withColumn("_ld", text.json_posting(html))
    ld = ld.withColumn("_shown", selectors.page_fields(html, wanted)) if wanted else ld.withColumn("_shown", F.lit(None))
    said = lambda *path: F.nullif(text.nested(F.col("_ld"), *path), F.lit(""))
    shown = lambda field: F.col(f"_shown.{field}") if field in wanted else F.lit(None).cast("string")
    both = ld.withColumns({"_json": money.salary_from_json(F.col("_ld")), "_text": money.parse_salary(shown("pay"), upto, since)})
    unpaid = F.col("_json.low").isNull() & F.col("_json.high").isNull()
    pay = lambda part: F.when(unpaid, F.col(f"_text.{part}")).otherwise(F.col(f"_json.{part}"))
    out = both.withColumn("description", F.coalesce(said("description"), shown("description")))
    return out.withColumns(
        {
            "vacancy_id": text.id_from_url(url, site.id_pattern),
            "source": F.lit(site.source),
            "title": F.coalesce(said("title"), shown("title")),
            "company_name": F.coalesce(said("hiringOrganization", "name"), shown("company")),
            "location": F.coalesce(said("jobLocation", "address", "addressLocality"), shown("location")),
            "salary_from": pay("low"),
            "salary_to": pay("high"),
            "currency": pay("currency"),
            "remote": text.is_remote("_ld", "description", remote_words),
            "published_at": money.parse_time(said("datePosted")),
        }
    ).drop("_ld", "_shown", "_json", "_text")


def found_links(pages: DataFrame, html: str, base: str, pattern: str, fallback: str | None = None) -> DataFrame:
    """The distinct canonical links of all pages; a page without a link of the first pattern gives those of the fallback."""
    return pages.select(F.explode(text.links(html, pattern, fallback)).alias("href")).select(text.clean_url("href", base).alias("link")).distinct()


def extract(df: DataFrame, column: str, extractor: Callable[[pd.Series], pd.Series], output: str, least: int = 0, short: Column | None = None) -> DataFrame:
    """An external extractor over whole batches, text in, text (or null) out; it is sent to the tasks, so it must be picklable. P11: texts of
    fewer than ``least`` characters don't go to it, they get ``short``. P12: null texts get null."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, `{output}` string"
    asked = F.col(column).isNotNull() & (F.length(F.trim(column)) >= least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{output: extractor(batch[column])})

    rest = F.when(F.col(column).isNotNull(), short if short is not None else F.lit(None)).cast("string")
    return df.where(asked).mapInPandas(run, schema).unionByName(df.where(~F.coalesce(asked, F.lit(False))).withColumn(output, rest))
