"""SQL names for the package's scalar functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.runtime import python_workers

#: SQL functions that are expressions: name, parameters, result, body. They stay in generated code.
EXPRESSIONS = {
    "hamming": ("a BIGINT, b BIGINT", "INT", "bit_count(a ^ b)"),
    "hash_hex": ("h BIGINT", "STRING", "lower(lpad(hex(h), 16, '0'))"),
    "confidence_band": ("c INT", "STRING", "CASE WHEN c >= 90 THEN 'high' WHEN c >= 70 THEN 'medium' ELSE 'low' END"),
    "model_stem": ("name STRING", "STRING", r"trim(lower(regexp_replace(name, '(?i)(_[0-9]+|_angle[0-9]+|_view[0-9]+|_original.*|\\s*\\([0-9]+\\))$', '')))"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Make hamming, hash_hex, confidence_band, model_stem, lab and palette_distance known to SQL in this session; gives their names.

    lab(r, g, b) is a struct (l, a, b) and palette_distance(x, y) compares two arrays
    of (L, a, b, share); both work on Arrow batches.
    """
    python_workers(spark)
    for name, (parameters, result, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")

    @F.pandas_udf("l double, a double, b double")
    def lab(r: pd.Series, g: pd.Series, b: pd.Series) -> pd.DataFrame:
        import numpy as np

        from tessera.functions import images

        return pd.DataFrame(images.lab(np.stack([r, g, b], axis=-1).astype(np.uint8)), columns=["l", "a", "b"])

    @F.pandas_udf("double")
    def palette_distance(x: pd.Series, y: pd.Series) -> pd.Series:
        from tessera.functions import images

        return pd.Series([images.palette_distance(list(p), list(q)) if p is not None and q is not None and len(p) and len(q) else None for p, q in zip(x, y, strict=True)], dtype="float64")

    spark.udf.register("lab", lab)
    spark.udf.register("palette_distance", palette_distance)
    return [*EXPRESSIONS, "lab", "palette_distance"]
