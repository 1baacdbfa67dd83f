"""Explicit schemas: the input tables and the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "str": T.StringType(),
    "dbl": T.DoubleType(),
    "bool": T.BooleanType(),
    "ts": T.TimestampNTZType(),
    "bin": T.BinaryType(),
    "floats": T.ArrayType(T.FloatType()),
    "doubles": T.ArrayType(T.DoubleType()),
}


def schema(spec: str) -> T.StructType:
    """Build a schema from ``"name:type name:type"``."""
    fields = (part.split(":") for part in spec.split())
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


INPUT_TABLES = {
    "region": schema("r_regionkey:int r_name:str"),
    "nation": schema("n_nationkey:int n_name:str n_regionkey:int"),
    "customer": schema("c_custkey:long c_name:str c_nationkey:int c_acctbal:dbl c_mktsegment:str"),
    "supplier": schema("s_suppkey:long s_name:str s_nationkey:int s_acctbal:dbl"),
    "part": schema("p_partkey:long p_name:str p_brand:str p_type:str p_size:int p_retailprice:dbl"),
    "orders": schema(
        "o_orderkey:long o_custkey:long o_orderstatus:str o_totalprice:dbl o_orderdate:ts o_orderpriority:str"
    ),
    "lineitem": schema(
        "l_orderkey:long l_partkey:long l_suppkey:long l_linenumber:int l_quantity:dbl l_extendedprice:dbl "
        "l_discount:dbl l_tax:dbl l_returnflag:str l_linestatus:str l_shipdate:ts"
    ),
    "events": schema("event_id:long ts:ts user_id:long event_type:str value:dbl props:str"),
    "documents": schema("doc_id:long text:str lang:str source:str n_chars:long"),
    "embeddings": schema("vec_id:long embedding:floats label:int"),
    "pages": schema("page_id:long url:str html:str"),
    "benchmark": schema("item_id:long text:str"),
    "labels": schema("doc_id:long quality:int toxic:int"),
    "conversations": schema("conv_id:long turn:long role:str text:str"),
}

GATE_RESULT = schema("check_name:str status:str evidence:str required_action:str")

EFFECTS = T.StructType(
    [
        T.StructField("actual_font_size", T.LongType()),
        T.StructField("background", T.StringType()),
        T.StructField("blur_radius", T.DoubleType()),
        T.StructField("contrast_style", T.StringType()),
        T.StructField("horizontal_shift_px", T.LongType()),
        T.StructField("jpeg_quality", T.LongType()),
        T.StructField("letter_spacing_px", T.LongType()),
        T.StructField("luminance_difference", T.DoubleType()),
        T.StructField("rotation_degrees", T.DoubleType()),
        T.StructField("scale_factor", T.DoubleType()),
        T.StructField("vertical_shift_px", T.LongType()),
    ]
)


class Tables:
    """Lazy access to the input tables of one folder: ``Tables(spark, dir).events``.

    ``once`` keeps what a query needs in several places, a fitted model or a folder of files, for that query alone.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._once: dict[str, object] = {}

    def once(self, name: str, make):
        if name not in self._once:
            self._once[name] = make()
        return self._once[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in INPUT_TABLES:
            raise AttributeError(name)
        return self.spark.read.schema(INPUT_TABLES[name]).parquet(f"{self.folder}/{name}.parquet")
