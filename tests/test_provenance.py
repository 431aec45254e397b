"""Validation trees against a walk by recursion."""

import json

import numpy as np

from prismspark.operators import provenance

NAMES = ["success", "Failures", "errors", "info", "Warning", "other", "root", "a.b", "code", "x y", "é"]


def plain(node, scope="root", kind=None):
    if isinstance(node, list):
        return [row for item in node for row in plain(item, scope, kind)]
    if not isinstance(node, dict):
        return []
    text = lambda v: v if isinstance(v, str) else str(v) if v is None or isinstance(v, bool) else json.dumps(v, separators=(",", ":"), ensure_ascii=False)
    if "code" in node:
        flag = node.get("success") if isinstance(node.get("success"), bool) else None
        own = kind or {True: "success", False: "failure", None: "status"}[flag]
        return [(scope, own, text(node["code"]), flag, *(None if node.get(k) is None else text(node[k]) for k in ("explanation", "url")))]
    out = []
    for name, value in node.items():
        out += plain(value, name if scope == "root" else f"{scope}.{name}", provenance.KINDS.get(name.lower(), kind))
    return out


def tree(rng, depth):
    pick = rng.integers(0, 10)
    if depth == 0 or pick < 2:
        return [None, True, False, 3, "text", '{"code":1}', [], {}][rng.integers(0, 8)]
    if pick < 4:
        return [tree(rng, depth - 1) for _ in range(rng.integers(0, 4))]
    if pick < 6:
        return {"code": [1, "c", None, True, "a.b"][rng.integers(0, 5)], "success": [True, False, None, "no"][rng.integers(0, 4)], "url": [None, "u", 5][rng.integers(0, 3)], "explanation": ["why", {"b": 1, "a": [2]}][rng.integers(0, 2)]}
    return {NAMES[i]: tree(rng, depth - 1) for i in rng.permutation([k for k in range(len(NAMES)) if k != 8])[: rng.integers(0, 5)]}


def test_trees_like_a_plain_walk(spark):
    rng = np.random.default_rng(4)
    trees = [tree(rng, d) for d in (2, 4, 6, 9) for _ in range(40)]
    deep = {"code": "bottom"}
    for i in range(20):
        deep = [deep] if i % 3 else {NAMES[i % 8]: deep}
    trees.append(deep)
    texts = [json.dumps(t, ensure_ascii=i % 2 == 0, indent=1 if i % 5 == 0 else None) for i, t in enumerate(trees)] + [None, "", "{", "[1", '"x"', " \n {\"code\": 7} ", "[" * 2000]
    found = provenance.validation_rows(spark.createDataFrame(list(enumerate(texts)), "file BIGINT, tree STRING"), "tree", "file").orderBy("file", "place").collect()
    want = [(k, i, *row) for k, t in enumerate([*trees, *[None] * 5, {"code": 7}, None]) for i, row in enumerate(plain(t))]
    assert [tuple(r) for r in found] == want and len(want) > 100


def test_no_python_workers(spark):
    rows = provenance.validation_rows(spark.createDataFrame([("f", '{"code":1}')], "file STRING, tree STRING"), "tree", "file")
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == 1


def test_odd_trees(spark):
    """Names that repeat below, texts that look like trees or words, escaped and marked names, text that is no JSON."""
    texts = [
        '{"b":{"n":{"x":1,"x":2}},"a":{"code":1,"code":2}}',
        r'{"t":"\u007b\"code\":1}","u":"[{\"code\":1}]","~k":{"c\u006fde":"~x","success":"true"},"[k":{"\u0063ode":"{c}","explanation":"true","url":"\u0066alse"},"\u007em":{"ERRORS":[{"code":true}]}}',
        r'[{"code":{"~a":["~b","{","\\",true,"\"~","\\\"~"]},"explanation":[false,null,"t"],"url":"true","success":false}]',
        '\t\n {"code":7,"n":{"code":8}}',
        '{"deep":{"no":[{"n":1}],"false":{"x":[{"code":"f"}]}}}',
    ]
    rows = [*enumerate(texts), (9, "{'code':1}"), (9, '{"code":1} {'), (9, "[1,{]")]
    found = provenance.validation_rows(spark.createDataFrame(rows, "file BIGINT, tree STRING"), "tree", "file").filter("file < 9").orderBy("file", "place").collect()
    want = [(k, i, *row) for k, t in enumerate(texts) for i, row in enumerate(plain(json.loads(t)))]
    assert [tuple(r) for r in found] == want and len(want) == 7


def test_places_are_of_a_document(spark):
    """Documents of one key are numbered each for itself, those that are walked on as well."""
    deep = "[" * 15 + '{"code":2}' + "]" * 15
    rows = spark.createDataFrame([("f", '[{"code":1},%s,{"code":3}]' % deep), ("f", '[{"code":4},{"code":5}]'), (None, '{"code":6}'), (None, '{"code":7}')], "document STRING, tree STRING")
    found = provenance.validation_rows(rows, "tree", "document").collect()
    assert sorted((r.document or "", r.place, r.code) for r in found) == [("", 0, "6"), ("", 0, "7"), ("f", 0, "1"), ("f", 0, "4"), ("f", 1, "2"), ("f", 1, "5"), ("f", 2, "3")]


def test_a_node_is_parsed_once(spark):
    """A step reads a node by one parse, and walks rows, not arrays inside an interpreted function."""
    nodes = spark.createDataFrame([(1, '{"code":1}')], "file INT, node STRING").selectExpr("file", "0 AS place", "node", "'root' AS scope", "string(null) AS kind", "CAST(null AS map<string,string>) AS status")
    plan = provenance.step(nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2 and "variant" not in plan.lower() and "transform(" not in plan
