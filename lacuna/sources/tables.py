"""Readers, writers and derived layers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys stay text, so that leading zeros do.
TEMPLATE = T.StructType([T.StructField("GEOID", T.StringType()), T.StructField("region", T.StringType()), T.StructField("coverage_gap_score", T.DoubleType())])
TRACTS = T.StructType(
    [
        T.StructField("geoid", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("bbox", T.StructType([T.StructField(c, T.DoubleType()) for c in ("xmin", "xmax", "ymin", "ymax")])),
        T.StructField("geometry", T.BinaryType()),
    ]
)


def read(spark: SparkSession, root: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    """A table of a data folder; pruned and filtered by the scan."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


def with_row_ids(df: DataFrame) -> DataFrame:
    """Adds the key (file, row) of each scanned row: row numbers restart in each file."""
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def first_existing(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of several Parquet tables that there is: a committed one before a fresh one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        if where.getFileSystem(conf).exists(where):
            return spark.read.parquet(p)
    raise FileNotFoundError(", ".join(paths))


def read_template(spark: SparkSession, path: str, schema: T.StructType = TEMPLATE) -> DataFrame:
    """A CSV with a header and a given schema; types are never guessed."""
    return spark.read.csv(path, header=True, schema=schema)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines of a text file, column value."""
    return spark.read.text(path)


def read_variants(spark: SparkSession, pattern: str, name: str = r"([^/]+)\.parquet") -> DataFrame:
    """Many component files at once, each row tagged with its file's name."""
    df = spark.read.parquet(pattern)
    return df.select("*", F.regexp_extract(F.col("_metadata.file_path"), name, 1).alias("variant"))


def write_component(df: DataFrame, path: str, by: Iterable[str] = ("region", "variant")) -> None:
    """A component table, partitioned so that a region or variant is pruned to its files."""
    df.write.mode("overwrite").partitionBy(*(c for c in by if c in df.columns)).parquet(path)


def _plain(value: Column, digits: int) -> Column:
    """A number rounded to so many digits as text without an exponent, which a double's own text has below 0.001: 2.5E-4."""
    text = F.bround(value, digits).cast(T.DecimalType(38, digits)).cast("string")
    return F.regexp_replace(text, r"(\.\d+?)0+$", "$1")


def export_scores(df: DataFrame, path: str, components: bool = False, digits: int = 6, files: int | None = 1) -> None:
    """Scores as CSV, with or without components. One row per tract, thousands of rows, go to one file; ``files``: so many, or with None
    as many as the frame has partitions, each with a header."""
    gaps = ["transport_gap", "building_gap", "poi_gap"]
    columns = ["GEOID", "coverage_gap_score", *(["region", *(c for g in gaps for c in (g, g.replace("gap", "defined")))] if components else [])]
    rounded = [_plain(F.col(c), digits).alias(c) if c in (*gaps, "coverage_gap_score") else F.col(c) for c in columns]
    out = df.select(*rounded)
    (out.coalesce(files) if files else out).write.mode("overwrite").csv(path, header=True)


def line_profile(lines: DataFrame, digits: int = 6) -> DataFrame:
    """(line, n, zeros, places, fields) of an export's text, per kind of line: the header or a row. ``zeros``: lines that start with a zero, which
    a reader of numbers would lose; ``places``: rows of which a number has more digits after its point than it should; fields of a line."""
    v = F.col("value")
    kind = F.when(F.startswith(v, F.lit("GEOID,")), v).otherwise(F.lit("row"))
    long = v.rlike(rf"\.[0-9]{{{digits + 1},}}") | v.rlike("[0-9][eE]-?[0-9]")
    return lines.groupBy(kind.alias("line")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.startswith(v, F.lit("0"))).alias("zeros"), F.count_if(long).alias("places"), F.max(F.size(F.split(v, ","))).alias("fields"))


def schema_report(df: DataFrame) -> list[tuple[str, str, bool]]:
    """(column, type, nullable), nested fields with dotted names."""
    out: list[tuple[str, str, bool]] = []

    def walk(fields: list[T.StructField], lead: str) -> None:
        for f in fields:
            out.append((lead + f.name, f.dataType.simpleString(), f.nullable))
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType.fields, f"{lead}{f.name}.")

    walk(df.schema.fields, "")
    return out


# ---- derived layers: whole micro-degrees, arithmetic on the base tables only


def tracts(spark: SparkSession, root: str) -> DataFrame:
    """A grid of square tracts, with region, establishments and strata."""
    region = read(spark, root, "nation").join(F.broadcast(read(spark, root, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    # nation and region are fixed lists of 25 and 5 rows
    c = read(spark, root, "customer").join(F.broadcast(region), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.withColumns({"x0": F.expr("(c_custkey % 50) * 20000"), "y0": F.expr("(c_custkey - c_custkey % 50) * 400")})
    return c.select(
        F.col("c_custkey").alias("tid"), F.col("r_name").alias("region"), F.col("n_name").alias("county"), "x0", "y0", F.expr("x0 + 20000").alias("x1"), F.expr("y0 + 20000").alias("y1"),
        F.when(F.col("c_acctbal") < 0, 0).otherwise(F.floor("c_acctbal") % 8).cast("long").alias("cbp_estab"),
        (F.col("r_name") == "AFRICA").alias("tribal"), F.col("c_mktsegment").isin("MACHINERY", "FURNITURE").alias("rural"), F.col("c_acctbal").alias("svi"),
    )


def buildings(spark: SparkSession, root: str) -> DataFrame:
    """Square footprints with a centre, a half width and the layers that hold them."""
    return read(spark, root, "orders").select(
        F.col("o_orderkey").alias("bid"),
        F.expr("(o_custkey % 50) * 20000 + (o_orderkey * 7919) % 60000 - 20000").alias("cx"),
        F.expr("(o_custkey - o_custkey % 50) * 400 + (o_orderkey * 10473) % 60000 - 20000").alias("cy"),
        F.expr("10 + o_orderkey % 90").alias("half"),
        F.col("o_orderstatus").isin("O", "F").alias("in_mapped"),
        F.expr("o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderkey % 3 > 0)").alias("in_ref"),
    )


def roads(spark: SparkSession, root: str) -> DataFrame:
    """Straight segments from (ax, ay) by (dx, dy), of the mapped (A) or the reference (R) side."""
    lines = read(spark, root, "lineitem").where("l_returnflag IN ('A', 'R') AND l_linestatus = 'F'")
    return lines.select(
        F.expr("((l_orderkey - l_orderkey % 10) * 2000) % 1000000 + (l_partkey * 7919) % 20000").alias("ax"),
        F.expr("(l_orderkey - l_orderkey % 500) * 40 + (l_suppkey * 1047 + l_partkey * 13) % 20000").alias("ay"),
        F.expr("l_quantity * 900 - 20000").alias("dx"),
        F.expr("round(l_discount * 100) * 4000 - 20000").alias("dy"),
        F.expr("l_returnflag = 'A'").alias("mapped"),
        F.expr("CASE l_linenumber WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary' ELSE 'residential' END").alias("class"),
    )


def pois(spark: SparkSession, root: str) -> DataFrame:
    """Points of interest by tract, kind and layer."""
    return read(spark, root, "events").select(
        F.expr("CAST((event_id * 3 - (event_id * 3) % 20) / 20 AS BIGINT)").alias("tid"),
        F.expr("CASE event_type WHEN 'signup' THEN 'fire' WHEN 'error' THEN 'ems' WHEN 'click' THEN 'schools' WHEN 'purchase' THEN 'hospital' ELSE 'other' END").alias("kind"),
        F.expr("user_id % 2 = 0").alias("in_mapped"),
        F.expr("user_id % 3 > 0").alias("in_ref"),
    )
