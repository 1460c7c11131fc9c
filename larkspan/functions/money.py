"""Pay: numbers in text, currencies, pay periods, conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Monthly pay below which a currency's amount is taken as hourly.
HOURLY_BELOW = {"RUB": 30000, "USD": 500, "EUR": 500, "KZT": 50000, "UZS": 1000000, "AED": 2000, "GBP": 500}
ANNUAL_FROM, HOURS, MONTHS = 25000, 160, 12
SYMBOLS = [("₽|руб", "RUB"), (r"\$", "USD"), ("€", "EUR")]


def salary_numbers(raw: Column) -> Column:
    """Numbers of a text: runs of digits, spaces and no-break spaces, spaces removed."""
    found = F.regexp_extract_all(raw, F.lit("([\\d\\s\\u00a0]*\\d[\\d\\s\\u00a0]*)"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, "[\\s\\u00a0]", "").try_cast("double"))


def parse_salary(raw: Column, upto: str = "до", since: str = "от", symbols: list[tuple[str, str]] = SYMBOLS) -> Column:
    """struct(low, high, currency). Only an upper word: upper bound; one number: lower bound; else the first two."""
    numbers, low = salary_numbers(raw), F.lower(raw)
    currency = F.lit(None).cast("string")
    for pattern, code in reversed(symbols):
        currency = F.when(low.rlike(pattern), F.lit(code)).otherwise(currency)
    only_upper = low.contains(upto) & ~low.contains(since)
    a, b = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    return F.struct(F.when(~only_upper, a).alias("low"), F.when(only_upper, a).otherwise(b).alias("high"), currency.alias("currency"))


def salary_from_json(ld: Column) -> Column:
    """struct(low, high, currency) of baseSalary: an object's min and max, a scalar's own value for both, else nulls. Only an object has a
    currency."""
    base = F.get_json_object(ld, "$.baseSalary")
    value, given = F.get_json_object(ld, "$.baseSalary.value"), F.coalesce(base.startswith("{"), F.lit(False))
    scalar = F.when(~F.coalesce(value.startswith("{"), F.lit(False)), value.try_cast("double"))
    bound = lambda name: F.when(given, F.coalesce(F.get_json_object(ld, f"$.baseSalary.value.{name}").try_cast("double"), scalar))
    return F.struct(bound("minValue").alias("low"), bound("maxValue").alias("high"), F.when(given, F.get_json_object(ld, "$.baseSalary.currency")).alias("currency"))


def normal_code(code: Column, aliases: dict[str, str]) -> Column:
    """upper-cased, trimmed, aliases resolved."""
    c = F.upper(F.trim(code))
    if not aliases:
        return c
    return F.coalesce(F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))[c], c)


def mentioned_currency(text: Column, pattern: str, aliases: dict[str, str], home: str = "RUB") -> Column:
    """first currency mentioned next to an amount that is not the home currency. The pattern matches both; what of it is neither digit nor blank
    is the currency, by its alias or else upper-cased."""
    table = F.create_map(*(F.lit(v) for kv in aliases.items() for v in kv))
    said = F.transform(F.regexp_extract_all(F.lower(text), F.lit(f"(?iu){pattern}"), F.lit(0)), lambda x: F.regexp_replace(x, r"[\d\s]+", ""))
    return F.get(F.filter(F.transform(said, lambda x: F.coalesce(table[x], F.upper(x))), lambda x: (x != "") & (x != home)), F.lit(0))


def monthly(low: Column, high: Column, currency: Column, text: Column, hourly: str, annual: str) -> Column:
    """F32: factor that turns an amount into a monthly one, 1 where nothing is known. A null currency is the home currency; a code that is not in the
    table has its own two defaults."""
    top = F.greatest(F.coalesce(low, F.lit(0.0)), F.coalesce(high, F.lit(0.0)))
    table = F.create_map(*(F.lit(x) for k, v in HOURLY_BELOW.items() for x in (k, float(v))))
    own = table[F.coalesce(currency, F.lit("RUB"))]
    least = F.coalesce(own, F.lit(float(HOURLY_BELOW["RUB"])))
    per_year = F.coalesce(text.rlike(annual), F.lit(False)) & (top >= F.coalesce(own, F.lit(float(ANNUAL_FROM))) * MONTHS * 1.5)
    per_hour = F.when(top < least, True).when(top > 2 * least, False).otherwise(F.coalesce(text.rlike(hourly), F.lit(False)))
    known = (top > 0) & (F.coalesce(text, F.lit("")) != "")
    return F.when(~known, 1.0).when(per_year, 1.0 / MONTHS).when(per_hour, float(HOURS)).otherwise(1.0)


def monthly_by_size(low: Column, high: Column, below: float = 10000, above: float = 2000000) -> Column:
    """factor by the first bound that is neither null nor zero."""
    x = F.coalesce(F.nullif(low, F.lit(0.0)), F.nullif(high, F.lit(0.0)))
    return F.when(x < below, float(HOURS)).when(x > above, 1.0 / MONTHS).otherwise(1.0)


def midpoint(low: Column, high: Column) -> Column:
    """Middle of both bounds, or the one there is; zero counts as missing; null unless positive."""
    a, b = F.nullif(low, F.lit(0.0)), F.nullif(high, F.lit(0.0))
    m = F.coalesce((a + b) / 2, a, b)
    return F.when(m > 0, m)


def with_rates(df: DataFrame, code: str, rates: DataFrame, fallback: DataFrame, home: str = "RUB") -> DataFrame:
    """Adds ``rate``: the table's, else the fallback's, 1 for the home currency and null codes, else null. Both tables are (code, rate); of
    several rates of a code the smallest counts."""
    first = rates.groupBy(F.col("code").alias(code)).agg(F.min("rate").alias("_r1"))
    second = fallback.groupBy(F.col("code").alias(code)).agg(F.min("rate").alias("_r2"))
    rate = F.when(F.col(code).isNull() | (F.col(code) == home), 1.0).otherwise(F.coalesce("_r1", "_r2"))
    return df.join(first, code, "left").join(second, code, "left").withColumn("rate", rate).drop("_r1", "_r2")


def to_home(amount: Column, rate: Column) -> Column:
    """rounded to cents; unconverted without a rate."""
    return F.when(rate.isNull() | (rate == 1.0), amount).otherwise(F.round(amount * rate, 2))


def parse_time(text: Column, keep_offset: bool = True) -> Column:
    """ISO time in UTC, null if it does not parse. keep_offset=False drops the offset instead of applying it."""
    return F.try_to_timestamp(text) if keep_offset else F.try_to_timestamp(F.substring(text, 1, 19))


def to_home_chain(df: DataFrame, low: str, high: str, currency: str, text: str, rates: DataFrame, fallback: DataFrame, aliases: dict[str, str], patterns: list[tuple[str, str]], hourly: str, annual: str, home: str = "RUB") -> DataFrame:
    """F27 (code), else F29 (first pattern found in the text); F32 (monthly); then the rate. Adds low_home, high_home, code_home: the home code,
    or the original one where there is no rate and nothing is converted. Without any bound all three are null."""
    from .rules import first_match

    given = F.nullif(normal_code(F.col(currency), aliases), F.lit(""))
    resolved = df.withColumn("_code", F.coalesce(given, first_match(F.col(text), patterns)))
    factor = monthly(F.col(low), F.col(high), F.col("_code"), F.col(text), hourly, annual)
    rated = with_rates(resolved.withColumn("_factor", factor), "_code", rates, fallback, home)
    some = F.col(low).isNotNull() | F.col(high).isNotNull()
    amount = lambda c: to_home(F.col(c) * F.col("_factor"), F.col("rate"))
    code = F.when(some, F.when(F.col("rate").isNotNull(), F.lit(home)).otherwise(F.col(currency)))
    return rated.withColumns({"low_home": amount(low), "high_home": amount(high), "code_home": code}).drop("_code", "_factor", "rate")


def normalize_pay(low: Column, high: Column, currency: Column, text: Column, place: Column, aliases: dict[str, str], mentioned: str, places: list[tuple[list[str], str]], home: str = "RUB") -> Column:
    """F28, F30, F31, F33 in their order: struct(low, high, currency). The code (by alias of its lower-cased text, else upper-cased), else the first
    foreign one mentioned in the text, else by the place; without any, all are null. Amounts become monthly by their size; 0 counts as missing."""
    from .rules import contains_first

    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    given = F.when(F.coalesce(currency, F.lit("")) != "", F.coalesce(table[F.lower(F.trim(currency))], F.upper(currency)))
    code = F.coalesce(given, mentioned_currency(text, mentioned, aliases, home), contains_first(F.lower(place), places))
    a, b = F.nullif(low, F.lit(0.0)), F.nullif(high, F.lit(0.0))
    factor = monthly_by_size(low, high)
    return F.struct(F.when(code.isNotNull(), a * factor).alias("low"), F.when(code.isNotNull(), b * factor).alias("high"), code.alias("currency"))
