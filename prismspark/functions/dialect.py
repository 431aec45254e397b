"""One text for two engines: tokens that Spark and the checking engine spell differently."""

from __future__ import annotations

import re

#: token: (Spark, other). Arguments follow in parentheses as they stand.
SPELLINGS = {
    "@us(ts)": ("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)", "epoch_us(ts)"),
    "@rint(": ("bround(", "round_even("),
    "@percentile(": ("percentile(", "quantile_cont("),
    "@sorted(": ("sort_array(", "list_sort("),
    "@list(": ("collect_list(", "list("),
    "@join(": ("array_join(", "array_to_string("),
    "@sha256(": ("sha256_of(", "sha256("),
    "@explode64": ("LATERAL VIEW posexplode(embedding) e AS pos, raw", ", LATERAL (SELECT unnest(range(64)) AS pos, unnest(embedding) AS raw) e"),
    "@dealt_embeddings": ("(SELECT /*+ REPARTITION(vec_id) */ * FROM embeddings)", "embeddings"),
    "@length(": ("size(", "len("),
    "@split(": ("split(", "regexp_split_to_array("),
    "@btrim(": ("btrim(", "trim("),
    "@stamp(ts)": ("date_format(ts, 'yyyyMMdd_HHmmss')", "strftime(ts, '%Y%m%d_%H%M%S')"),
    "@bytes(": ("octet_length(", "strlen("),
}


def render(sql: str, engine: str) -> str:
    """sql in the spelling of `spark` or `duckdb`."""
    side = 0 if engine == "spark" else 1
    for token, pair in SPELLINGS.items():
        sql = sql.replace(token, pair[side])
    sql = re.sub(r"sha256_of\(([^()]*)\)", r"sha2(\1, 256)", sql)
    if side:
        sql = re.sub(r"(\d+\.\d+(?:E-?\d+)?)D\b", r"(\1::DOUBLE)", sql)
        sql = sql.replace(" AS STRING)", " AS VARCHAR)")
    return sql
