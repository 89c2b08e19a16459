"""Exports (K4, K5, K6, K7, K8).

K6/K7: every table goes to its own folder under one root (never several tables into one file).
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("csv", "parquet")


def export_tables(root: str, tables: dict[str, DataFrame], fmt: str = "csv", mode: str = "overwrite") -> dict[str, str]:
    """K6 / K7: write each ``name -> DataFrame`` to ``root/name`` (CSV with a header, or Parquet)."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    out = {}
    for name, df in tables.items():
        path = f"{root.rstrip('/')}/{name}"
        w = df.write.mode(mode)
        if fmt == "csv":
            w.option("header", True).option("escape", '"').csv(path)
        else:
            w.parquet(path)
        out[name] = path
    return out


def assemble_output(
    membership: DataFrame,
    keywords: DataFrame | None = None,
    gen_keywords: bool = True,
    collated: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """K8: the tables to export: ``clusters`` (membership, or collated URLs) and, when enabled,
    ``cluster_keywords``. Asking for keywords without any is an error."""
    tables = {"clusters": collated if collated is not None else membership}
    if gen_keywords:
        if keywords is None:
            raise ValueError("keywords requested but none were computed (hashing vectors have no vocabulary)")
        tables["cluster_keywords"] = keywords
    return tables


def dense_array(vec: Column) -> Column:
    """K4: an ML vector as ``array<double>``."""
    return vector_to_array(vec)


def fixed_decimals(value: Column, decimals: int) -> Column:
    return F.round(value.cast("double"), decimals).cast(f"decimal(38,{decimals})").cast("string")


def tsv_line(values: Column, decimals: int | None = None) -> Column:
    """K5: numbers as text, tab-separated, in full precision or with fixed ``decimals``."""
    text = lambda x: x.cast("double").cast("string") if decimals is None else fixed_decimals(x, decimals)
    return F.concat_ws("\t", F.transform(values, text))


def write_tsv(lines: DataFrame, path: str, col: str = "line") -> None:
    """K5: append lines to a text folder."""
    lines.select(col).write.mode("append").text(path)
