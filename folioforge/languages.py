"""Language codes with names and writing direction, from the Java runtime's own table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RTL_BLOCKS = ((0x0590, 0x08FF), (0xFB1D, 0xFDFF), (0xFE70, 0xFEFF))


def language_table(spark: SparkSession, extra: list[tuple[str, str, str]] = (("simple", "Simple English", "Simple English"),)) -> DataFrame:
    """``(code, english, native, rtl)``; ``extra`` adds codes the runtime does not know.

    A language runs from right to left when its own name is written so.
    """
    locale = spark.sparkContext._jvm.java.util.Locale
    rows = []
    for code in locale.getISOLanguages():
        own = locale.forLanguageTag(code)
        rows.append((code, own.getDisplayLanguage(locale.ENGLISH), own.getDisplayLanguage(own)))
    rows += [r for r in extra if r[0] not in {x[0] for x in rows}]
    rtl = lambda s: any(a <= ord(c) <= b for c in s for a, b in RTL_BLOCKS)
    return spark.createDataFrame([(c, e, n, rtl(n)) for c, e, n in rows], "code string, english string, native string, rtl boolean")


def default_row(available: DataFrame) -> DataFrame:
    """One row ``code``: English where available, else the first code in order."""
    return available.orderBy(F.col("code") != "en", "code").select("code").limit(1)


def default_language(available: DataFrame) -> str | None:
    row = default_row(available).first()
    return row and row["code"]


def named(rows: DataFrame, table: DataFrame, code_col: str) -> DataFrame:
    """Rows with ``language`` and ``rtl`` of their code: an unknown code stands for itself and runs from left to right."""
    dim = table.select(F.col("code").alias(code_col), "english", F.col("rtl").alias("_rtl"))
    joined = rows.join(F.broadcast(dim), code_col, "left")
    return joined.withColumn("language", F.coalesce("english", code_col)).withColumn("rtl", F.coalesce("_rtl", F.lit(False))).drop("english", "_rtl")


def discover(spark: SparkSession, suffix: str = "_docs_search") -> DataFrame:
    """Codes of the databases named ``<code><suffix>``; hyphens in names are written as underscores."""
    names = [(d.name,) for d in spark.catalog.listDatabases()]
    found = spark.createDataFrame(names, "name string").filter(F.col("name").rlike(f"^[a-z][a-z_-]*{suffix}$"))
    return found.select(F.replace(F.regexp_replace("name", f"{suffix}$", ""), F.lit("_"), F.lit("-")).alias("code"), "name")
