"""TSF files: a header of @ lines, then series of colon-separated attributes and comma-separated values, ? where one is missing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"numeric": "bigint", "string": "string", "date": "timestamp_ntz"}
SINGLE = ("frequency", "horizon", "missing", "equallength")


@dataclass
class TsfHeader:
    attributes: list[tuple[str, str]] = field(default_factory=list)
    frequency: str | None = None
    horizon: int | None = None
    missing: bool | None = None
    equallength: bool | None = None


def parse_header(lines: list[str]) -> TsfHeader:
    """The @ lines in order; ValueError for what the format doesn't allow."""
    out, data = TsfHeader(), False
    for line in lines:
        parts = line.split(" ")
        name = parts[0].removeprefix("@")
        if name == "data":
            if not out.attributes:
                raise ValueError("attributes must come before the data")
            data = True
        elif name == "attribute":
            if len(parts) != 3:
                raise ValueError(f"not an attribute's name and type: {line}")
            if parts[2] not in TYPES:
                raise ValueError(f"unknown attribute type: {parts[2]}")
            out.attributes.append((parts[1], parts[2]))
        else:
            if len(parts) != 2:
                raise ValueError(f"not one value: {line}")
            if name in SINGLE:
                value = int(parts[1]) if name == "horizon" else parts[1] if name == "frequency" else parts[1].lower() in ("y", "yes", "t", "true", "on", "1")
                setattr(out, name, value)
    if not out.attributes:
        raise ValueError("no attributes")
    if not data:
        raise ValueError("no @data")
    return out


def _windows_1252() -> tuple[str, str]:
    """Characters that ISO 8859-1 gives for bytes 80 to 9F, and what Windows-1252 has there."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(a for a, b in pairs if b), "".join(b for a, b in pairs if b)


def read_tsf(spark: SparkSession, path: str, encoding: str = "windows-1252") -> tuple[DataFrame, TsfHeader]:
    """A row for each series: its attributes, series_value (array<double>, null where missing), and series_no in the file's order.

    Lines are read by Spark and can be split over tasks; only the header's lines come to the driver.
    """
    lines = spark.read.csv(path, sep="\x01", quote="", escape="", encoding="iso-8859-1" if encoding == "windows-1252" else encoding, schema="line string", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, maxCharsPerColumn=-1)
    if encoding == "windows-1252":
        lines = lines.withColumn("line", F.translate("line", *_windows_1252()))
    lines = lines.where("line is not null and line <> ''").select("line", F.monotonically_increasing_id().alias("_at"))
    heads = [r[0] for r in lines.where(F.col("line").startswith("@")).orderBy("_at").select("line").collect()]
    if not heads and lines.isEmpty():
        raise ValueError("empty file")
    header = parse_header(heads)
    data = ~F.col("line").startswith("@") & ~F.col("line").startswith("#")
    rows = lines.where(data)
    if rows.isEmpty():
        raise ValueError("no series under @data")
    n = len(header.attributes)
    parts = F.split("line", ":", -1)
    # Filters that the optimizer adds may meet other lines first, so the errors name the lines they are for.
    checked = F.when(data & (F.size(parts) == n + 1), parts).when(data, F.raise_error(F.lit("attributes or values are missing in a series")).cast("array<string>"))
    rows = rows.select("_at", checked.alias("p"))
    values = F.transform(F.split(F.element_at("p", n + 1), ","), lambda v: F.when(v != "?", v.cast("double")))
    whole = F.when(F.exists(values, lambda v: v.isNotNull()), values).when(F.col("p").isNotNull(), F.raise_error(F.lit("all values of a series are missing")).cast("array<double>"))

    def attribute(k: int, kind: str) -> Column:
        text = F.element_at("p", k + 1)
        return F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd HH-mm-ss")) if kind == "date" else text.cast(TYPES[kind])

    cols = [attribute(k, kind).alias(name) for k, (name, kind) in enumerate(header.attributes)]
    return rows.select(*cols, whole.alias("series_value"), F.col("_at").alias("series_no")), header


def tsf_points(df: DataFrame, series_id: str = "s", missing: float | None = 0.0) -> DataFrame:
    """Series as dimensions, in their order; missing values hold `missing`."""
    from pyspark.sql import Window

    # Only the numbers, one a dimension, are ranked together.
    order = df.select("series_no").distinct().withColumn("dim", (F.row_number().over(Window.orderBy("series_no")) - 1).cast("int"))
    out = df.join(order, "series_no").select("dim", F.posexplode("series_value").alias("t", "value"))
    return out.select(F.lit(series_id).alias("series_id"), F.col("t").cast("bigint").alias("t"), "dim", F.coalesce("value", F.lit(missing).cast("double")).alias("value"))
