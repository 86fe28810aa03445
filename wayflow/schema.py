"""Relations and fixed values of the sensing domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

READING = T.StructType(
    [
        T.StructField("camera_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("t_wall", T.DoubleType()),
        T.StructField("feed_age_s", T.DoubleType()),
        T.StructField("frames", T.IntegerType()),
        T.StructField("count_mean", T.DoubleType()),
        T.StructField("count_max", T.IntegerType()),
        T.StructField("classes", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("tracks", T.IntegerType()),
        T.StructField("moving_frac", T.DoubleType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
    ]
)

# Road classes with free-flow km/h, vehicles an hour and lane, and rank.
ROAD_CLASSES = (
    ("motorway", 80.0, 1800.0, 0),
    ("motorway_link", 45.0, 1200.0, 1),
    ("trunk", 60.0, 1600.0, 1),
    ("trunk_link", 40.0, 1100.0, 2),
    ("primary", 50.0, 1400.0, 2),
    ("primary_link", 35.0, 1000.0, 3),
    ("secondary", 40.0, 1100.0, 3),
    ("secondary_link", 30.0, 900.0, 4),
    ("tertiary", 35.0, 900.0, 4),
    ("tertiary_link", 25.0, 700.0, 5),
    ("residential", 25.0, 600.0, 6),
    ("unclassified", 25.0, 600.0, 6),
    ("living_street", 15.0, 400.0, 7),
    ("service", 15.0, 400.0, 8),
)
DEFAULT_CLASS = "residential"

# Fixed values of the traffic model.
LEAST_KPH = 3.5
STALE_S = 1500.0
PRIOR_WEIGHT = 0.30
CORRIDOR_M = 1400.0
REACH_M = 4200.0
TURN_OFF_M = 550.0
DOWNSTREAM_M = 260.0
RANK_FACTOR = 0.82
OWN_ROAD_FACTOR = 1.35
LEAST_WEIGHT = 0.04
RESIDUAL_TAU_S = 1200.0
SIGMA_FLOOR = 0.06
SIGMA_GROWTH = 0.055
MEMORY = 0.86
LEAST_SUPPORT = 0.02
EARTH_M = 6371008.8


def road_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROAD_CLASSES, "hw string, class_kph double, class_cap double, rank int")
