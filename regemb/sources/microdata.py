"""Microdata readers.

CSV files are read with every column as text and then cast *by name*
according to the spec's column roles.  A path may be a file, a glob or a
folder; it is expanded first, because Spark binds all files of one read by
the position of the first file's columns.  Extra missing-value tokens on the
named columns become null; a weight that is no number is an error.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regemb.operators.clean import SchemaError
from regemb.spec import MicrodataSpec

# FIXED VALUES: missing-value spellings used by the census files on the
# identifier and occupation/industry columns.
NA_TOKENS = ["N.A.", "N.A.//", "N.A.////"]
NA_COLUMNS = ["SERIALNO", "indp02", "indp07", "INDP", "OCCP", "occp02", "occp10", "OCCP10",
              "OCCP12", "socp00", "socp10", "SOCP10", "SOCP12", "SOCP", "naicsp02",
              "naicsp07", "NAICSP"]


def _texts(df: DataFrame, spec: MicrodataSpec) -> dict[str, Column]:
    """Every column as trimmed text, missing-value spellings as null."""
    na_cols = set(spec.na_columns or NA_COLUMNS)
    out = {}
    for c in df.columns:
        x = F.trim(F.col(f"`{c}`"))
        if c in na_cols:
            x = F.when(x.isin(NA_TOKENS), F.lit(None)).otherwise(x)
        out[c] = F.when(x == "", F.lit(None)).otherwise(x)
    return out


def _numeric(spec: MicrodataSpec) -> dict[str, str]:
    """Type of every column that is a number: reals, weights, adjustment factors."""
    real = set(spec.real) | {c for cols in spec.adjust.values() for c in cols}
    return {**dict.fromkeys(spec.adjust, "bigint"),
            **dict.fromkeys(real | set(spec.weights), "double")}


def typed(df: DataFrame, spec: MicrodataSpec, on_bad: str = "raise") -> DataFrame:
    """Cast text columns by role: reals and weights -> double, adjustment
    factors -> bigint, discrete/meta -> trimmed text; unknown roles stay text.

    A text that should be a number and is none raises in the plan
    (``on_bad="raise"``), or becomes null and is listed by :func:`bad_values`
    (``on_bad="null"``).
    """
    kinds = _numeric(spec)
    out = []
    for c, x in _texts(df, spec).items():
        if c in kinds:
            number = x.try_cast("double")
            if on_bad == "raise":
                bad = F.raise_error(F.concat(F.lit(f"{c} is not a number: "), x))
                number = F.when(x.isNotNull() & number.isNull(), bad).otherwise(number)
            x = number.cast(kinds[c])
        out.append(x.alias(c))
    return df.select(*out)


def bad_values(df: DataFrame, spec: MicrodataSpec) -> DataFrame:
    """``column, value, count`` of the texts of ``df`` that should be numbers and are none."""
    kinds = _numeric(spec)
    entries = [F.struct(F.lit(c).alias("column"), x.alias("value"))
               for c, x in _texts(df, spec).items() if c in kinds]
    if not entries:
        return df.sparkSession.createDataFrame([], "column string, value string, count long")
    return (df.select(F.inline(F.array(*entries)))
              .where(F.col("value").isNotNull() & F.col("value").try_cast("double").isNull())
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")))


def _reader(spark: SparkSession):
    return (spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True)
            .option("inferSchema", False).option("mode", "FAILFAST"))


def expand(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The files behind paths, globs and folders, in order of their names.

    Only names are listed; contents are not read.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    rows = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .load(paths).where("length > 0").select("path").collect())
    found = sorted({r["path"] for r in rows})
    if not found:
        raise FileNotFoundError(f"no file with contents in {paths}")
    return found


def header_groups(spark: SparkSession, files: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by their header.  Headers are read by small jobs side by side."""
    with ThreadPoolExecutor(max_workers=8) as pool:
        headers = list(pool.map(lambda f: tuple(_reader(spark).csv(f).columns), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for f, h in zip(files, headers, strict=True):
        groups.setdefault(h, []).append(f)
    return groups


def read_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """CSV files of one set of columns, bound by name, as text.

    The files may order their columns differently: those of one header are
    read together and the groups are matched by name.  Other columns than the
    first file's are an error that names the file.
    """
    groups = header_groups(spark, expand(spark, paths))
    first = next(iter(groups))
    out = None
    for header, files in groups.items():
        if sorted(header) != sorted(first):
            odd = sorted(set(header) ^ set(first)) or list(header)
            raise SchemaError(f"{files[0]} differs from the first file in the columns {odd}")
        part = _reader(spark).csv(files).select(*[f"`{c}`" for c in first])
        out = part if out is None else out.unionByName(part)
    return out


def read_csv(spark: SparkSession, paths: str | list[str], spec: MicrodataSpec,
             on_bad: str = "raise") -> DataFrame:
    """S1 + S2 + U2: files, globs or folders of CSV files, typed by name."""
    return typed(read_text(spark, paths), spec, on_bad)


def read_partitions(spark: SparkSession, paths: list[str], spec: MicrodataSpec) -> DataFrame:
    """A table that lies in several partitions, CSV or Parquet, matched by name.

    Housing files come in parts; a part that lacks a column or has another is
    an error.
    """
    out = None
    for p in paths:
        is_csv = p.rstrip("/").endswith((".csv", ".csv.gz"))
        part = read_csv(spark, p, spec) if is_csv else spark.read.parquet(p)
        if out is not None and set(part.columns) != set(out.columns):
            raise SchemaError(f"{p} differs in the columns "
                              f"{sorted(set(part.columns) ^ set(out.columns))}")
        out = part if out is None else out.unionByName(part)
    return out


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None,
                 regions: list[str] | None = None, region_col: str = "region") -> DataFrame:
    """S3: Parquet scan with a column list; a region list prunes partitions."""
    df = spark.read.parquet(path)
    if regions is not None:
        df = df.where(F.col(region_col).isin(regions))
    return df.select(*columns) if columns else df
