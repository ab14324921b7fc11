"""Patient resources from newline-delimited FHIR JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from careframe.sources.patient_csv import parse_birth_date

RESOURCE = T.StructType([
    T.StructField("resourceType", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("birthDate", T.StringType()),
    T.StructField("active", T.BooleanType()),
    T.StructField("name", T.ArrayType(T.StructType([
        T.StructField("use", T.StringType()),
        T.StructField("family", T.StringType()),
        T.StructField("given", T.ArrayType(T.StringType())),
    ]))),
    T.StructField("telecom", T.ArrayType(T.StructType([
        T.StructField("system", T.StringType()), T.StructField("value", T.StringType()),
    ]))),
    T.StructField("address", T.ArrayType(T.StructType([
        T.StructField("state", T.StringType()), T.StructField("district", T.StringType()),
    ]))),
])

# Administrative gender codes and the library's letters.
GENDERS = {"male": "M", "female": "F", "other": "O", "unknown": "U"}


def read_fhir_patients(spark: SparkSession, path: str) -> DataFrame:
    """Patient columns of every Patient resource, other resources skipped; ``rejected_lines`` has what is no JSON."""
    return fhir_patients(spark.read.schema(RESOURCE).json(path))


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): lines that are no JSON; blank ones do not count."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return lines.filter((F.trim("line") != "") & F.try_parse_json("line").isNull())


def fhir_patients(resources: DataFrame) -> DataFrame:
    first_name = F.get("name", F.lit(0))
    place = F.get("address", F.lit(0))
    letters = F.create_map(*[F.lit(v) for pair in GENDERS.items() for v in pair])

    def contact(system: str):
        hits = F.filter("telecom", lambda t: t["system"] == system)
        return F.coalesce(F.get(hits, F.lit(0))["value"], F.lit(""))

    return resources.filter(F.col("resourceType") == "Patient").select(
        F.col("id").alias("patient_id"),
        F.coalesce(F.array_join(first_name["given"], " "), F.lit("")).alias("first_name"),
        F.coalesce(first_name["family"], F.lit("")).alias("last_name"),
        parse_birth_date(F.col("birthDate")).alias("date_of_birth"),
        F.coalesce(F.try_element_at(letters, F.col("gender")), F.lit("U")).alias("gender"),
        contact("phone").alias("phone"), contact("email").alias("email"),
        F.coalesce(place["state"], F.lit("")).alias("county"),
        F.coalesce(place["district"], F.lit("")).alias("sub_county"),
        F.coalesce("active", F.lit(True)).alias("is_active"),
    )
