"""Short forms against json.dumps."""

import json

from pyspark.sql import functions as F

from prismspark.operators import reporting


def test_short_forms(spark):
    long = {"status": "success", "reason": "r" * 2000, "score": 0.5}
    protocol = {"protocol_version": "1", "screening_observations": ["o" * 3000]}
    rows = [("synthetic_ml", long), ("deepfake_protocol", protocol), ("jpeg_ghost", {}), ("unknown", long), ("noise_map", {"mean": None, "std": 2}), ("frequency", [1, 2]), ("frequency", "plain text"), ("frequency", 5), ("video_timing", {"large_gaps": [{"at": 1}], "frame_count": 3})]
    df = spark.createDataFrame([(m, json.dumps(v)) for m, v in rows] + [("frequency", None), ("frequency", "{"), (None, '{"a": 1}')], "method STRING, result STRING")
    found = [r.short for r in reporting.short_results(df).collect()]
    assert found[0] == json.dumps({"status": "success", "score": 0.5, "reason": "r" * 2000}) and found[1] == json.dumps({k: protocol.get(k) for k in reporting.SHORT["deepfake_protocol"][0].split()})[:1000]
    assert found[2] == '{"minimum_error_quality": null, "minimum_mean_abs_error": null}' and len(found[3]) == 650 and found[4] == '{"mean": null, "std": 2}'
    assert found[5:8] == ["[1,2]", "plain text", "5"] and found[8] == '{"frame_count": 3, "timestamp_count": null, "large_gaps": [{"at":1}], "i_frames": null}'
    assert found[9:] == [None, None, '{"a":1}']
    assert "Python" not in reporting.short_results(df)._jdf.queryExecution().executedPlan().toString() and reporting.short_results(df.limit(0)).collect() == []
    assert reporting.short_results(df.withColumn("short", F.lit(1))).columns == ["method", "result", "short"]


def test_rows_as_json(spark):
    df = spark.sql("""SELECT 1 AS i, CAST('NaN' AS DOUBLE) AS d, array(1.5D, CAST('Infinity' AS DOUBLE), NULL) AS a, map(2, X'00ff') AS m, TIMESTAMP_NTZ'2024-01-02 03:04:05' AS t, DATE'2024-01-02' AS y, named_struct('x', 0.25F, 'n', CAST(NULL AS STRING)) AS s, 'q"t' AS q, true AS b, INTERVAL '1' DAY AS v, CAST(NULL AS ARRAY<INT>) AS z""")
    found = json.loads(reporting.json_safe(df).first().json)
    assert found == {"i": 1, "d": "NaN", "a": [1.5, "Infinity", None], "m": {"2": "00ff"}, "t": "2024-01-02 03:04:05", "y": "2024-01-02", "s": {"x": 0.25, "n": None}, "q": 'q"t', "b": True, "v": "INTERVAL '1' DAY", "z": None}
    assert json.loads(reporting.json_safe(df, ["i", "b"], "short").first().short) == {"i": 1, "b": True} and reporting.json_safe(df.limit(0)).collect() == []
