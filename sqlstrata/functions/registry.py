"""Names of aggregate, window and table functions by dialect, grouped into families, with the nearest Spark function.

Each family says which dialects know its names. The table is expanded from these rows, so its size is fixed.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_WAREHOUSES = "snowflake bigquery hive athena trino teradata oracle postgresql"
_STDDEV = "mysql mariadb redshift " + _WAREHOUSES
_FULL_REGRESSION = "postgresql snowflake hive teradata oracle"
_REGR = " ".join("REGR_" + s for s in "AVGX AVGY COUNT INTERCEPT R2 SLOPE SXX SXY SYY".split())

# Fixed values: (family, category, dialects, names).
FAMILIES = [
    ("F1", "aggregate", "common", "SUM COUNT AVG MAX MIN COUNT_DISTINCT"),
    ("F2", "window", "common", "ROW_NUMBER RANK DENSE_RANK NTILE CUME_DIST PERCENT_RANK"),
    ("F2", "window", "teradata oracle", "CUME_DIST PERCENT_RANK"),
    ("F2", "aggregate", "hive", "NTILE"),
    ("F3", "window", "common", "LAG LEAD FIRST_VALUE LAST_VALUE NTH_VALUE"),
    ("F3", "window", "oracle", "NTH_VALUE FIRST_VALUE LAST_VALUE"),
    ("F4", "window", "common transactsql mariadb teradata oracle", "PERCENTILE_CONT PERCENTILE_DISC"),
    ("F4", "window", "mariadb", "MEDIAN"),
    ("F4", "aggregate", "snowflake redshift teradata oracle", "MEDIAN"),
    ("F4", "aggregate", "postgresql snowflake teradata", "MODE"),
    ("F4", "aggregate", "oracle", "STATS_MODE"),
    ("F5", "aggregate", "mysql mariadb sqlite", "GROUP_CONCAT"),
    ("F5", "aggregate", "postgresql transactsql bigquery", "STRING_AGG"),
    ("F5", "aggregate", "snowflake redshift trino oracle", "LISTAGG"),
    ("F5", "aggregate", "postgresql snowflake bigquery athena trino", "ARRAY_AGG"),
    ("F5", "aggregate", "hive", "COLLECT_LIST COLLECT_SET"),
    ("F5", "aggregate", "snowflake", "ARRAY_UNION_AGG ARRAY_UNIQUE_AGG"),
    ("F5", "aggregate", "bigquery", "ARRAY_CONCAT_AGG"),
    ("F5", "aggregate", "athena trino", "SET_AGG SET_UNION"),
    ("F5", "aggregate", "oracle", "COLLECT WM_CONCAT"),
    ("F6", "aggregate", "mysql mariadb oracle", "JSON_ARRAYAGG JSON_OBJECTAGG"),
    ("F6", "aggregate", "postgresql", "JSON_AGG JSONB_AGG JSON_OBJECT_AGG JSONB_OBJECT_AGG"),
    ("F6", "aggregate", "snowflake", "OBJECT_AGG"),
    ("F6", "aggregate", "athena trino", "MAP_AGG MAP_UNION MULTIMAP_AGG"),
    ("F6", "aggregate", "trino", "MAP_UNION_SUM"),
    ("F7", "aggregate", "postgresql redshift athena trino", "BOOL_AND BOOL_OR"),
    ("F7", "aggregate", "postgresql athena trino", "EVERY"),
    ("F7", "aggregate", "bigquery", "LOGICAL_AND LOGICAL_OR COUNTIF"),
    ("F7", "aggregate", "snowflake", "BOOLAND_AGG BOOLOR_AGG"),
    ("F8", "aggregate", "mysql mariadb", "BIT_AND BIT_OR BIT_XOR"),
    ("F8", "aggregate", "snowflake", "BITAND_AGG BITOR_AGG BITXOR_AGG"),
    ("F9", "aggregate", _STDDEV, "STDDEV STDDEV_POP STDDEV_SAMP VARIANCE VAR_POP VAR_SAMP"),
    ("F9", "aggregate", "mysql mariadb", "STD"),
    ("F9", "aggregate", "transactsql", "STDEV STDEVP VAR VARP"),
    ("F9", "aggregate", "snowflake trino teradata", "KURTOSIS"),
    ("F9", "aggregate", "snowflake", "SKEW"),
    ("F9", "aggregate", "trino teradata", "SKEWNESS"),
    ("F10", "aggregate", _WAREHOUSES, "CORR COVAR_POP COVAR_SAMP"),
    ("F10", "aggregate", _FULL_REGRESSION, _REGR),
    ("F10", "aggregate", "athena trino", "REGR_INTERCEPT REGR_SLOPE"),
    ("F11", "aggregate", "transactsql snowflake bigquery teradata oracle", "APPROX_COUNT_DISTINCT"),
    ("F11", "aggregate", "snowflake athena trino teradata", "APPROX_PERCENTILE"),
    ("F11", "aggregate", "athena trino", "APPROX_DISTINCT"),
    ("F11", "aggregate", "trino", "APPROX_MOST_FREQUENT APPROX_SET"),
    ("F11", "aggregate", "snowflake", "APPROX_TOP_K HLL HLL_ACCUMULATE HLL_COMBINE HLL_ESTIMATE HLL_EXPORT HLL_IMPORT "
                                      "MINHASH MINHASH_COMBINE APPROXIMATE_JACCARD_INDEX APPROXIMATE_SIMILARITY"),
    ("F11", "aggregate", "bigquery", "APPROX_QUANTILES APPROX_TOP_COUNT APPROX_TOP_SUM HLL_COUNT.INIT HLL_COUNT.MERGE "
                                     "HLL_COUNT.MERGE_PARTIAL HLL_COUNT.EXTRACT"),
    ("F11", "aggregate", "redshift", "APPROXIMATE APPROXIMATE_COUNT APPROXIMATE_PERCENTILE_DISC"),
    ("F11", "aggregate", "hive", "PERCENTILE PERCENTILE_APPROX"),
    ("F12", "aggregate", "mysql snowflake bigquery teradata oracle", "ANY_VALUE"),
    ("F12", "aggregate", "athena trino", "ARBITRARY CHECKSUM GEOMETRIC_MEAN HISTOGRAM REDUCE_AGG"),
    ("F12", "aggregate", "snowflake", "HASH_AGG"),
    ("F12", "aggregate", "hive", "HISTOGRAM_NUMERIC"),
    ("F12", "aggregate", "sqlite", "TOTAL"),
    ("F12", "aggregate", "transactsql", "GROUPING GROUPING_ID COUNT_BIG"),
    ("F13", "aggregate", "postgresql teradata oracle", "XMLAGG"),
    ("F13", "aggregate", "transactsql", "CHECKSUM_AGG"),
    ("F13", "tvf", "postgresql teradata oracle", "XMLTABLE"),
    ("F13", "tvf", "oracle", "XMLSEQUENCE DBMS_XPLAN.DISPLAY DBMS_XPLAN.DISPLAY_CURSOR"),
    ("F13", "tvf", "bigquery", "ML.PREDICT ML.EVALUATE ML.TRAIN VECTOR_SEARCH"),
    ("F14", "window", "snowflake bigquery redshift oracle", "RATIO_TO_REPORT"),
    ("F14", "window", "snowflake", "CONDITIONAL_CHANGE_EVENT CONDITIONAL_TRUE_EVENT WIDTH_BUCKET"),
    ("F15", "tvf", "postgresql bigquery redshift athena trino", "UNNEST"),
    ("F15", "tvf", "postgresql transactsql redshift", "GENERATE_SERIES"),
    ("F15", "tvf", "athena trino", "SEQUENCE"),
    ("F15", "tvf", "snowflake athena", "FLATTEN"),
    ("F15", "tvf", "snowflake teradata", "STRTOK_SPLIT_TO_TABLE"),
    ("F15", "tvf", "teradata oracle", "TABLE"),
    ("F15", "tvf", "mysql mariadb oracle", "JSON_TABLE"),
    ("F15", "tvf", "postgresql sqlite", "JSON_EACH"),
    ("F15", "tvf", "sqlite", "JSON_TREE"),
    ("F15", "tvf", "hive", "EXPLODE POSEXPLODE INLINE STACK JSON_TUPLE PARSE_URL_TUPLE"),
    ("F15", "tvf", "transactsql", "OPENJSON OPENXML STRING_SPLIT OPENROWSET OPENQUERY"),
    ("F15", "tvf", "snowflake", "SPLIT_TO_TABLE GENERATOR RESULT_SCAN VALIDATE EXTERNAL_TABLE_FILES INFER_SCHEMA"),
    ("F15", "tvf", "bigquery", "GENERATE_ARRAY GENERATE_DATE_ARRAY GENERATE_TIMESTAMP_ARRAY JSON_EXTRACT_ARRAY JSON_EXTRACT_STRING_ARRAY "
                               "EXTERNAL_QUERY GAP_FILL RANGE_SESSIONIZE APPENDS CHANGES"),
    ("F15", "tvf", "postgresql", "GENERATE_SUBSCRIPTS REGEXP_SPLIT_TO_TABLE JSON_TO_RECORD JSONB_TO_RECORD JSON_TO_RECORDSET "
                                 "JSONB_TO_RECORDSET JSON_POPULATE_RECORD JSON_POPULATE_RECORDSET JSONB_POPULATE_RECORDSET "
                                 "JSON_ARRAY_ELEMENTS JSONB_ARRAY_ELEMENTS JSONB_EACH"),
]

# Names whose Spark function has another name. A name missing here has the same name in Spark, or none.
SPARK_NAMES = {
    "GROUP_CONCAT": "listagg", "STRING_AGG": "string_agg", "LISTAGG": "listagg", "WM_CONCAT": "listagg", "STATS_MODE": "mode",
    "JSON_AGG": "to_json(collect_list)", "OBJECT_AGG": "map_from_entries(collect_list)", "MAP_AGG": "map_from_entries(collect_list)",
    "LOGICAL_AND": "bool_and", "LOGICAL_OR": "bool_or", "COUNTIF": "count_if", "BITAND_AGG": "bit_and", "BITOR_AGG": "bit_or",
    "BITXOR_AGG": "bit_xor", "STD": "stddev", "STDEV": "stddev", "STDEVP": "stddev_pop", "VAR": "variance", "VARP": "var_pop",
    "SKEW": "skewness", "APPROX_DISTINCT": "approx_count_distinct", "APPROX_QUANTILES": "approx_percentile",
    "HLL": "approx_count_distinct", "HLL_ACCUMULATE": "hll_sketch_agg", "HLL_COMBINE": "hll_union_agg", "ARBITRARY": "any_value",
    "CHECKSUM": "sum(xxhash64)", "HASH_AGG": "sum(xxhash64)", "HISTOGRAM": "histogram_numeric", "REDUCE_AGG": "aggregate(collect_list)",
    "GEOMETRIC_MEAN": "exp(avg(ln))", "RATIO_TO_REPORT": "x / sum(x) over", "UNNEST": "explode", "FLATTEN": "variant_explode",
    "GENERATE_SERIES": "sequence", "SPLIT_TO_TABLE": "explode(split)", "JSON_EACH": "variant_explode", "JSON_TABLE": "from_json",
}

# Dialect names that mean another one.
DIALECT_ALIASES = {"sqlserver": "transactsql", "tsql": "transactsql", "mssql": "transactsql", "postgres": "postgresql", "pg": "postgresql"}

AGGREGATE_PATTERN_NAMES = sorted({n.replace(".", r"\.") for _, c, _, names in FAMILIES if c == "aggregate" for n in names.split()},
                                 key=lambda n: (-len(n), n))

_RANK = {"aggregate": 1, "window": 2, "tvf": 3}


def dialect_key(dialect: str) -> str:
    plain = "".join(ch for ch in dialect.lower() if ch.isalpha())
    return DIALECT_ALIASES.get(plain, plain)


def registry_rows(custom: dict[str, list[str]] | None = None) -> list[tuple]:
    """(family, dialect, category, name, rank, spark_equivalent); `custom` adds names by category under dialect "custom"."""
    rows = [(f, d, c, n, _RANK[c], SPARK_NAMES.get(n)) for f, c, ds, names in FAMILIES for d in dict.fromkeys(ds.split()) for n in names.split()]
    for category, names in (custom or {}).items():
        rows += [("U1", "custom", category, n.upper(), _RANK[category], None) for n in names]
    return rows


def function_registry(spark: SparkSession, custom: dict[str, list[str]] | None = None) -> DataFrame:
    names = ["family", "dialect", "category", "name", "rank", "spark_equivalent"]
    columns = dict(zip(names, map(list, zip(*registry_rows(custom)))))
    kinds = pa.schema([(n, pa.int32() if n == "rank" else pa.string()) for n in names])
    return spark.createDataFrame(pa.table(columns, schema=kinds))
