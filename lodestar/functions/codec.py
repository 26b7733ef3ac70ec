"""Text encodings of a point: JSON for messages and stored values, WKT for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Message schema. Absent fields decode to null.
POINT_MESSAGE = T.StructType(
    [
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("distancesToPivot", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("UID", T.StringType()),
    ]
)


def encode_point(uid: str = "uid", x: str = "x", y: str = "y", distances: Column | None = None) -> Column:
    """JSON text of a point; null fields are left out."""
    fields = [F.col(x).alias("x"), F.col(y).alias("y")]
    if distances is not None:
        fields.append(distances.alias("distancesToPivot"))
    fields.append(F.col(uid).cast("string").alias("UID"))
    return F.to_json(F.struct(*fields))


def decode_point(value: str = "value") -> Column:
    """Point struct of a JSON text. Broken text stops the job; an absent coordinate is 0.0."""
    point = F.from_json(F.col(value), POINT_MESSAGE, {"mode": "FAILFAST"})
    return F.struct(
        F.coalesce(point["x"], F.lit(0.0)).alias("x"),
        F.coalesce(point["y"], F.lit(0.0)).alias("y"),
        point["distancesToPivot"].alias("distancesToPivot"),
        point["UID"].alias("UID"),
    )


def readable_point(value: str = "value") -> Column:
    """Whether the text decodes to a point with both coordinates: the test that quarantines bad messages."""
    point = F.from_json(F.col(value), POINT_MESSAGE, {"mode": "PERMISSIVE"})
    return point["x"].isNotNull() & point["y"].isNotNull()


def point_wkt(x: str = "x", y: str = "y", decimals: int | None = None) -> Column:
    """``"Point (x y)"`` including the double quotes."""
    if decimals is None:
        return F.concat(F.lit('"Point ('), F.col(x), F.lit(" "), F.col(y), F.lit(')"'))
    return F.format_string(f'"Point (%.{decimals}f %.{decimals}f)"', F.col(x), F.col(y))
