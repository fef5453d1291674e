"""The sequence functions by name in SQL. Their bodies are SQL too, so they are planned like built-in functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: (parameters, result, body)
FUNCTIONS = {
    "is_acgt": ("s STRING", "BOOLEAN", "coalesce(s rlike '^[ACGT]*$', false)"),
    "reverse_complement": ("s STRING", "STRING", "translate(reverse(s), 'ACGT', 'TGCA')"),
    "find_left": ("text STRING, pattern STRING", "INT", "if(length(pattern) > 0, instr(text, pattern) - 1, -1)"),
    "find_right": ("text STRING, pattern STRING", "INT", "if(length(pattern) > 0 AND instr(reverse(text), reverse(pattern)) > 0, length(text) - length(pattern) - instr(reverse(text), reverse(pattern)) + 1, -1)"),
    "primers_overlap": ("start1 INT, length1 INT, start2 INT, length2 INT", "BOOLEAN", "(start1 + length1 - 1 >= start2 AND start1 + length1 >= start2 + length2) OR (start1 <= start2 + length2 - 1 AND start1 >= start2)"),
    "phred": ("q STRING", "INT", "ascii(q) - 33"),
    "kmer_id": ("kmer STRING", "BIGINT", "cast(conv(translate(kmer, 'AGTUC', '01223'), 4, 10) AS BIGINT)"),
    "tail_p_value": ("z DOUBLE", "DOUBLE", "if(z > 0, 1 / (z * sqrt(2 * pi()) * exp(z * z / 2)), 1.0D)"),
    "triangle_index": ("i INT, j INT, n INT", "BIGINT", "cast(cast(i AS BIGINT) * (2 * n - i - 1) / 2 AS BIGINT) + j - i - 1"),
}


def register_functions(spark: SparkSession) -> None:
    """Make the functions known in a session, in place of what else has their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
