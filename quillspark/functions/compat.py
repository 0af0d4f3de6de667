"""SQL functions of the document dialect.

Where Spark's function of the same name means something else, the dialect's is
defined here under a ``q_`` name as a temporary SQL function (no Python at run
time, so calls are inlined into the plan); the front end renames calls.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_TOKENS = r"regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+', 0)"

#: name -> (parameters, result, body)
DEFINITIONS: dict[str, tuple[str, str, str]] = {
    "under": ("pre BIGINT, post BIGINT, apre BIGINT, apost BIGINT", "BOOLEAN", "apre < pre AND post < apost"),
    "tokenize": ("content STRING", "ARRAY<STRING>", _TOKENS.format("content")),
    "match": (
        "content STRING, query STRING",
        "BOOLEAN",
        f"size({_TOKENS.format('query')}) > 0 AND size(array_except({_TOKENS.format('query')}, {_TOKENS.format('content')})) = 0",
    ),
    "score": (
        "content STRING, query STRING",
        "DOUBLE",
        f"element_at(transform(array({_TOKENS.format('content')}), t -> CASE WHEN size(t) > 0 AND size({_TOKENS.format('query')}) > 0 THEN "
        f"aggregate({_TOKENS.format('query')}, 0, (n, w) -> n + size(filter(t, x -> x = w))) / size(t) ELSE 0.0D END), 1)",
    ),
    "slug": ("x STRING", "STRING", r"regexp_replace(trim(regexp_replace(lower(x), '[^\\p{L}\\p{N} ]', '-')), '\\s+', '-')"),
    # strings
    "q_trim": ("x STRING", "STRING", r"regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '')"),
    "q_trim2": ("x STRING, chars STRING", "STRING", "trim(BOTH chars FROM x)"),
    "q_ltrim": ("x STRING", "STRING", r"trim(LEADING ' \t\n\r' FROM x)"),
    "q_rtrim": ("x STRING", "STRING", r"trim(TRAILING ' \t\n\r' FROM x)"),
    "q_ltrim2": ("x STRING, chars STRING", "STRING", "trim(LEADING chars FROM x)"),
    "q_rtrim2": ("x STRING, chars STRING", "STRING", "trim(TRAILING chars FROM x)"),
    "q_lpad": ("x STRING, n INT, pad STRING", "STRING", "CASE WHEN pad = '' THEN left(x, n) ELSE lpad(x, n, pad) END"),
    "q_rpad": ("x STRING, n INT, pad STRING", "STRING", "CASE WHEN pad = '' THEN left(x, n) ELSE rpad(x, n, pad) END"),
    "q_initcap": ("x STRING", "STRING", "array_join(transform(split(x, ' '), w -> concat(upper(left(w, 1)), lower(substring(w, 2)))), ' ')"),
    "q_ascii": ("x STRING", "INT", "CASE WHEN x <> '' THEN ascii(x) END"),
    "q_chr": ("n INT", "STRING", "CASE WHEN n BETWEEN 1 AND 1114111 AND NOT n BETWEEN 55296 AND 57343 THEN decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') END"),
    "q_instr": ("hay STRING, needle STRING", "INT", "CASE WHEN needle = '' THEN 0 ELSE instr(hay, needle) END"),
    "q_split_part": ("x STRING, d STRING, n INT", "STRING", "CASE WHEN n < 1 THEN NULL WHEN d = '' THEN CASE WHEN n = 1 THEN x END WHEN n > (length(x) - length(replace(x, d, ''))) / length(d) + 1 THEN NULL ELSE split_part(x, d, n) END"),
    "q_substring": ("x STRING, start INT", "STRING", "substring(x, greatest(start, 1))"),
    "q_substring3": ("x STRING, start INT, n INT", "STRING", "CASE WHEN start >= 1 THEN substring(x, start, n) ELSE substring(x, 1, greatest(n + start - 1, 0)) END"),
    # numbers
    "q_trunc": ("x DOUBLE", "BIGINT", "CAST(sign(x) * floor(abs(x)) AS BIGINT)"),
    "q_trunc2": ("x DOUBLE, s INT", "DOUBLE", "CASE WHEN abs(x) * pow(10, s) < 1e15 THEN sign(x) * floor(abs(x) * pow(10, s)) / pow(10, s) ELSE x END"),
    "q_round": ("x DOUBLE", "BIGINT", "CAST(round(x) AS BIGINT)"),
    "q_round2": ("x DOUBLE, s INT", "DOUBLE", "CASE WHEN abs(x) * pow(10, s) < 1e15 THEN sign(x) * floor(abs(x) * pow(10, s) + 0.5) / pow(10, s) ELSE x END"),
    "q_log": ("x DOUBLE", "DOUBLE", "log10(x)"),
    "q_log2args": ("x DOUBLE, base DOUBLE", "DOUBLE", "log(base, x)"),
    "q_ln": ("x DOUBLE", "DOUBLE", "CASE WHEN x < 0 THEN double('NaN') WHEN x = 0 THEN double('-Infinity') ELSE ln(x) END"),
    # types, time, JSON
    "q_now": ("", "STRING", "date_format(to_utc_timestamp(current_timestamp(), current_timezone()), 'yyyy-MM-dd HH:mm:ss')"),
    "q_current_date": ("", "STRING", "date_format(to_utc_timestamp(current_timestamp(), current_timezone()), 'yyyy-MM-dd')"),
    "q_current_time": ("", "STRING", "date_format(to_utc_timestamp(current_timestamp(), current_timezone()), 'HH:mm:ss')"),
    "q_json_extract": ("j STRING, p STRING", "STRING", "variant_get(try_parse_json(j), CASE WHEN p LIKE '$%' THEN p ELSE concat('$.', p) END, 'string')"),
}

#: dialect name -> {number of arguments: name here}
RENAMED: dict[str, dict[int, str]] = {
    "trim": {1: "q_trim", 2: "q_trim2"},
    "ltrim": {1: "q_ltrim", 2: "q_ltrim2"},
    "rtrim": {1: "q_rtrim", 2: "q_rtrim2"},
    "lpad": {3: "q_lpad"},
    "rpad": {3: "q_rpad"},
    "initcap": {1: "q_initcap"},
    "ascii": {1: "q_ascii"},
    "chr": {1: "q_chr"},
    "instr": {2: "q_instr"},
    "split_part": {3: "q_split_part"},
    "substring": {2: "q_substring", 3: "q_substring3"},
    "substr": {2: "q_substring", 3: "q_substring3"},
    "trunc": {1: "q_trunc", 2: "q_trunc2"},
    "truncate": {1: "q_trunc", 2: "q_trunc2"},
    "round": {1: "q_round", 2: "q_round2"},
    "mod": {2: "try_mod"},
    "log": {1: "q_log", 2: "q_log2args"},
    "ln": {1: "q_ln"},
    "now": {0: "q_now"},
    "current_timestamp": {0: "q_now"},
    "current_date": {0: "q_current_date"},
    "current_time": {0: "q_current_time"},
    "json_extract": {2: "q_json_extract"},
}

#: Spark type name -> the dialect's
TYPE_NAMES = {"string": "text", "void": "null", "boolean": "boolean"} | dict.fromkeys(["tinyint", "smallint", "int", "bigint"], "integer") | dict.fromkeys(["float", "double"], "float")


def typeof_sql(argument: str) -> str:
    """The dialect's typeof as an expression over Spark's."""
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_NAMES.items())
    return f"CASE WHEN ({argument}) IS NULL THEN 'null' ELSE CASE typeof({argument}) {cases} ELSE CASE WHEN typeof({argument}) LIKE 'decimal%' THEN 'float' ELSE typeof({argument}) END END END"


def install(spark: SparkSession, names: set[str] | None = None) -> None:
    """Define the functions (of these names only, if given) as temporary functions of this session."""
    for name, (parameters, result, body) in DEFINITIONS.items():
        if names is None or name in names:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
