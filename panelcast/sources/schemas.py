"""Explicit schemas. Nothing is inferred from the data."""

from pyspark.sql import types as T


_TYPES = {
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "array<double>": T.ArrayType(T.DoubleType()),
    "array<string>": T.ArrayType(T.StringType()),
}


def columns(listing: str) -> T.StructType:
    """`name type, name type, ...` as a schema. Needs no running session."""
    fields = (item.split() for item in listing.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


# Star-schema tables the weekly panel is derived from.
STAR = {
    "region": columns("r_regionkey int, r_name string"),
    "nation": columns("n_nationkey int, n_name string, n_regionkey int"),
    "customer": columns(
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": columns("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
    "part": columns(
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
        " p_retailprice double"
    ),
    "orders": columns(
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": columns(
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
        " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
        " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
}

# Landing tables, as delivered.
RAW_TRANSACTIONS = columns(
    "week_end_date date, store_num bigint, upc bigint, units double, visits double, hhs double,"
    " spend double, price double, base_price double, feature int, display int, tpr_only int"
)
RAW_PRODUCTS = columns(
    "upc bigint, description string, manufacturer string, category string, sub_category string,"
    " product_size string"
)
RAW_STORE = columns(
    "store_id bigint, address_state_prov_code string, parking_space_qty double,"
    " sales_area_size_num double, seg_value_name string"
)

# Cleaned tables.
TRANSACTIONS = columns(
    "week date, store_id string, upc_id string, units double, visits bigint, hhs bigint,"
    " spend double, price double, base_price double, feature int, display int, tpr_only int"
)
