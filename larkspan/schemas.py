"""Explicit schemas (K16) and grade ordinals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRADES = ["Intern", "Junior", "Middle", "Senior", "Lead"]
SKILL = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "priority", "context_snippet")])
DUTY = T.StructType([T.StructField(c, T.StringType()) for c in ("action", "object", "context_snippet")])
LANGUAGE = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "level")])
EXPERIENCE = T.StructType([T.StructField("min_years", T.DoubleType()), T.StructField("description", T.StringType())])
EXTRACTED = T.StructType(
    [
        T.StructField("seniority", T.StringType()),
        T.StructField("experience", EXPERIENCE),
        T.StructField("hard_skills", T.ArrayType(SKILL)),
        T.StructField("soft_skills", T.ArrayType(SKILL)),
        T.StructField("responsibilities", T.ArrayType(DUTY)),
        T.StructField("languages", T.ArrayType(LANGUAGE)),
    ]
)
VACANCIES = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("vacancy_id", T.StringType(), False), T.StructField("source", T.StringType(), False)]
    + [T.StructField(c, T.StringType()) for c in ("title", "company_name", "location", "currency", "description", "description_raw", "review_reasons", "seniority_grade")]
    + [T.StructField(c, T.DoubleType()) for c in ("salary_from", "salary_to", "salary_from_rub", "salary_to_rub")]
    + [T.StructField("remote", T.BooleanType()), T.StructField("needs_review", T.BooleanType(), False)]
    + [T.StructField(c, T.TimestampType()) for c in ("published_at", "created_at", "updated_at")]
    + [T.StructField("skills_extracted", EXTRACTED), T.StructField("hard_skills_json", T.ArrayType(SKILL)), T.StructField("soft_skills_json", T.ArrayType(SKILL)), T.StructField("responsibilities_json", T.ArrayType(DUTY))]
    + [T.StructField("hard_clusters", T.ArrayType(T.StringType())), T.StructField("soft_clusters", T.ArrayType(T.IntegerType())), T.StructField("resp_clusters", T.ArrayType(T.IntegerType()))]
)
QUEUE = T.StructType([T.StructField("id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("source", T.StringType()), T.StructField("status", T.StringType()), T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()), T.StructField("error", T.StringType())])


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Additive evolution: columns of the schema that are missing are added as nulls of their type."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns})
