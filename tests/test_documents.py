"""Rule trees over odd documents, and how often a document is opened."""

import json

from cuestream.operators import quality as Q

RULE = Q.obj(
    a=Q.num(0, 9, whole=True), b=Q.text(3, 1).null(), c=Q.obj(d=Q.flag(), e=Q.enum("x", "y").opt()),
    f=Q.arr(Q.obj(g=Q.num(0), h=Q.arr(Q.text(2)).opt()), 2), i=Q.obj(j=Q.num()).null().opt(),
)


def test_wrong_kinds_at_every_level(spark):
    good = {"a": 1, "b": "ok", "c": {"d": True}, "f": [{"g": 0}]}
    cases = [
        (json.dumps(good), []),
        (json.dumps({**good, "i": None, "b": None, "more": [1, {"z": {}}]}), []),
        (json.dumps({**good, "a": 10.5}), [("a", "invalid_type"), ("a", "too_big")]),
        (json.dumps({**good, "a": "1", "b": "", "c": {}}), [("a", "invalid_type"), ("b", "too_small"), ("c.d", "invalid_type")]),
        (json.dumps({**good, "c": [1], "f": {"g": 1}, "i": 3}), [("c", "invalid_type"), ("f", "invalid_type"), ("i", "invalid_type")]),
        (json.dumps({**good, "c": None, "f": None}), [("c", "invalid_type"), ("f", "invalid_type")]),
        (json.dumps({**good, "c": {"d": 1, "e": "z"}}), [("c.d", "invalid_type"), ("c.e", "invalid_enum_value")]),
        (json.dumps({**good, "f": [{"g": -1, "h": ["abc", 5, None]}, 7, None]}),
         [("f", "too_big"), ("f.0.g", "too_small"), ("f.0.h.0", "too_big"), ("f.0.h.1", "invalid_type"), ("f.0.h.2", "invalid_type"), ("f.1", "invalid_type"), ("f.2", "invalid_type")]),
        ("[1]", [("(root)", "invalid_type")]), ("{}", [(k, "invalid_type") for k in "abcf"]), ("{", [("(root)", "invalid_json")]),
    ]
    docs = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(cases)], "id int, raw_json string")
    got = {r["id"]: (r["ok"], [(x["path"], x["code"]) for x in r["issues"]]) for r in Q.validate_documents(docs, RULE).collect()}
    assert got == {i: (not want, want) for i, (_, want) in enumerate(cases)}


def test_kind_of_an_object_is_asked_only_when_it_is_none(spark):
    """The type of a whole object lists all it holds; a right document never needs it."""
    docs = spark.createDataFrame([("{}",)], "raw_json string")
    plan = Q.validate_documents(docs, RULE)._jdf.queryExecution().analyzed().toString()
    reads = plan.count("schema_of_variant(try_variant_get(_v")
    objects_and_arrays = 4
    # missing, null where it may be, and the branches of the name of a wrong kind
    assert reads <= objects_and_arrays * 12
    assert "schema_of_variant(try_variant_get(_v#" not in plan.split("_issues")[0] and plan.count("$.c.d") == 0
