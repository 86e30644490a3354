"""The JSON profiler: every path with its types, whatever the lines hold."""

from orrery.operators import profile

LINES = ['{"a":1,"b":"xyz","c":[1,2.5,"q",[0]],"d":{"e":null,"f":true,"g":[]}}', "{bad", "", None, '  {"a":1.5,"b":" ","c":null} ', "[1]", '"s"', '{"a":12345678901234567890123}']


def test_paths_and_types(spark):
    rows = spark.createDataFrame([(x,) for x in LINES], "text string")
    got = {(r.path, r.type): (r.n, r.share, r.blank, r.min_len, r.avg_len, r.max_len) for r in profile.json_profile(rows).collect()}
    assert got == {
        ("$", "object"): (3, 0.6, 0, 1, 2.6667, 4), ("$", "array"): (1, 0.2, 0, 1, 1.0, 1), ("$", "string"): (1, 0.2, 0, 1, 1.0, 1), ("$[]", "int"): (1, 0.2, 0, None, None, None),
        ("$.a", "int"): (1, 0.2, 0, None, None, None), ("$.a", "float"): (2, 0.4, 0, None, None, None), ("$.b", "string"): (2, 0.4, 1, 1, 2.0, 3), ("$.c", "array"): (1, 0.2, 0, 4, 4.0, 4), ("$.c", "null"): (1, 0.2, 0, None, None, None),
        ("$.c[]", "int"): (1, 0.2, 0, None, None, None), ("$.c[]", "float"): (1, 0.2, 0, None, None, None), ("$.c[]", "string"): (1, 0.2, 0, 1, 1.0, 1), ("$.c[]", "array"): (1, 0.2, 0, 1, 1.0, 1), ("$.c[][]", "int"): (1, 0.2, 0, None, None, None),
        ("$.d", "object"): (1, 0.2, 0, 3, 3.0, 3), ("$.d.e", "null"): (1, 0.2, 0, None, None, None), ("$.d.f", "bool"): (1, 0.2, 0, None, None, None), ("$.d.g", "array"): (1, 0.2, 0, 0, 0.0, 0),
    }
    assert profile.line_counts(rows).collect() == [(8, 2, 1)]
    shallow = profile.json_profile(rows, depth=1).select("path").distinct().collect()
    assert {r.path for r in shallow} == {"$", "$[]", "$.a", "$.b", "$.c", "$.d"}


def test_empty(spark):
    rows = spark.createDataFrame([], "text string")
    assert profile.json_profile(rows).count() == 0 and profile.line_counts(rows).collect() == [(0, 0, 0)]
