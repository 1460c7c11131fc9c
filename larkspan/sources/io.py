"""Tables, dictionaries and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, kind: str = "parquet") -> DataFrame:
    """A table of any kind that Spark reads, under its name and kind."""
    return spark.read.format(kind).load(f"{folder}/{name}.{kind}")


def save(df: DataFrame, folder: str, name: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").format(kind).save(f"{folder}/{name}.{kind}")


def json_dictionary(spark: SparkSession, path: str, key: str = "name", value: str = "cluster_id") -> DataFrame:
    """A file with one JSON object as rows (key, value)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value))


def decoded(content: Column, encoding: str) -> Column:
    """Text of the bytes of a file (as ``binaryFile`` reads them). Spark decodes few encodings; those of one byte a character, such as windows-1251, are
    ISO-8859-1 with other characters for the upper half of the bytes."""
    if encoding.lower().replace("_", "-") in ("utf-8", "utf-16", "us-ascii", "iso-8859-1"):
        return F.decode(content, encoding)
    upper = bytes(range(128, 256))
    return F.translate(F.decode(content, "ISO-8859-1"), upper.decode("latin-1"), upper.decode(encoding, "replace"))


def read_texts(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """path and text of whole files of any encoding, one row for each: for files of a bounded size, such as rates."""
    return spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content"), encoding).alias("text"))


def xml_rates(text: Column) -> Column:
    """Array of struct(code, rate) from <Valute> elements, decimal commas, rate = Value / Nominal. Each element is read by itself, so what is
    missing in one (its rate is null then) doesn't move another's values."""
    get = lambda element, tag: F.nullif(F.trim(F.regexp_extract(element, f"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))
    number = lambda x: F.regexp_replace(x, ",", ".").try_cast("double")
    elements = F.regexp_extract_all(text, F.lit(r"(?s)<Valute\b.*?</Valute>"), F.lit(0))
    return F.transform(elements, lambda e: F.struct(get(e, "CharCode").alias("code"), F.try_divide(number(get(e, "Value")), number(get(e, "Nominal"))).alias("rate")))


def json_rates(text: Column) -> Column:
    """Array of struct(code, rate) from {"Valute": {code: {Value, Nominal}}}."""
    entries = F.map_entries(F.from_json(F.get_json_object(text, "$.Valute"), "map<string,struct<Value:double,Nominal:double>>"))
    return F.transform(entries, lambda e: F.struct(e["key"].alias("code"), F.try_divide(e["value"]["Value"], e["value"]["Nominal"]).alias("rate")))


def export_csv(df: DataFrame, path: str, order: str) -> None:
    """K9: nested columns as JSON text, nulls as empty, quotes doubled, header, ordered. Parts are range-partitioned, so order holds across them without one task."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).orderBy(order).write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """K12."""
    df.write.mode("overwrite").json(path)
