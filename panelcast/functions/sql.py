"""The index and the split as SQL functions of a session.

``register(spark)`` makes temporary functions whose bodies are SQL, so the optimizer inlines them like any
expression: ``pm25_index(x)`` and the like, ``aqi(so2, no2, pm10, pm2_5)``, ``number_of(text)`` (missing tokens
and text that is no number are null), ``split_label(year, last_train_year)``, and the table function
``breakpoints(pollutant)`` with a row per segment (low, high, index_low, index_high) of ``so2``, ``no2``, ``pm10`` or ``pm2_5``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from panelcast.functions.breakpoints import BREAKPOINTS, INDEX_CAP
from panelcast.functions.tokens import NULL_TOKENS


def _index_sql(x: str, segments) -> str:
    parts = [f"WHEN isnan({x}) THEN NULL"]
    parts += [f"WHEN {x} >= {float(lo)}D AND {x} <= {float(hi)}D THEN {float(i_lo)}D + ({x} - {float(lo)}D) / {float(hi) - float(lo)}D * {float(i_hi) - float(i_lo)}D"
              for lo, hi, i_lo, i_hi in segments]
    return f"CASE {' '.join(parts)} WHEN {x} > {float(segments[-1][1])}D THEN {float(INDEX_CAP)}D END"


def register(spark: SparkSession) -> list[str]:
    """Create or replace the functions; their names."""
    tokens = ", ".join(f"'{t}'" for t in NULL_TOKENS)
    made = {"number_of(x STRING)": ("DOUBLE", f"CASE WHEN upper(trim(x)) IN ({tokens}) THEN NULL WHEN isnan(try_cast(x AS DOUBLE)) OR abs(try_cast(x AS DOUBLE)) = double('Infinity') THEN NULL ELSE try_cast(x AS DOUBLE) END")}
    for name, segments in BREAKPOINTS.items():
        made[f"{name}_index(x DOUBLE)"] = ("DOUBLE", _index_sql("x", segments))
    args = sorted(BREAKPOINTS, key=["so2", "no2", "pm10", "pm2_5"].index)
    made[f"aqi({', '.join(f'{a} DOUBLE' for a in args)})"] = ("DOUBLE", "greatest(" + ", ".join(f"{a}_index({a})" for a in args) + ")")
    made["split_label(year INT, last_train_year INT)"] = ("STRING", "CASE WHEN year <= last_train_year THEN 'train' WHEN year > last_train_year THEN 'test' END")
    for head, (kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    rows = ", ".join(f"('{name}', {', '.join(f'{float(v)}D' for v in segment)})" for name, segments in BREAKPOINTS.items() for segment in segments)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION breakpoints(pollutant STRING) RETURNS TABLE (low DOUBLE, high DOUBLE, index_low DOUBLE, index_high DOUBLE) "
              f"RETURN SELECT low, high, index_low, index_high FROM VALUES {rows} AS t(name, low, high, index_low, index_high) WHERE name = pollutant")
    return [*[head.split("(")[0] for head in made], "breakpoints"]
