"""Hand-made edge frames (tiny, typed like the fixture)."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import types as T

TM = T.StructType([
    T.StructField("ts", T.TimestampNTZType()), T.StructField("asset_id", T.LongType()),
    T.StructField("cpu_usage", T.DecimalType(18, 2)), T.StructField("power_w", T.DecimalType(18, 2)),
    T.StructField("inlet_temp_c", T.DecimalType(18, 2)), T.StructField("outlet_temp_c", T.DecimalType(18, 2)),
    T.StructField("emission_factor_kg_per_kwh", T.DecimalType(18, 4)), T.StructField("carbon_kg", T.DecimalType(18, 4)),
    T.StructField("status_level", T.StringType()), T.StructField("operational_state", T.StringType()),
])
AS = T.StructType([
    T.StructField("asset_id", T.LongType()), T.StructField("asset_name", T.StringType()),
    T.StructField("room_id", T.IntegerType()), T.StructField("room_name", T.StringType()),
    T.StructField("rack_id", T.IntegerType()), T.StructField("rack_name", T.StringType()),
    T.StructField("asset_type", T.StringType()), T.StructField("nominal_power_w", T.DecimalType(18, 2)),
])

T0 = dt.datetime(2024, 1, 30, 22, 0)
T1 = dt.datetime(2024, 1, 30, 23, 0)


def tm_row(ts, asset, cpu="50", power="400", inlet="22", outlet="30", ef="0.3400", carbon="0.1360",
           status="normal", state="running"):
    return (ts, asset, D(cpu), D(power), D(inlet), D(outlet), D(ef), D(carbon), status, state)


def asset_row(asset, name, room="R1", rack="K1", nominal="500", typ="compute-node"):
    return (asset, name, 1 if room == "R1" else 2, room, 10 if rack == "K1" else 20, rack, typ, D(nominal))


def frames(spark, tm_rows, asset_rows):
    return spark.createDataFrame(tm_rows, TM), spark.createDataFrame(asset_rows, AS)
