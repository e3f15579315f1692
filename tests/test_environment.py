"""JSON environments, the template walk and streams on small inputs."""

import json

from pyspark.sql import functions as F

from vellum.operators import walk
from vellum.sources import environment
from vellum.streaming import windows


def ref(value):
    return {"type": "ExternalReference", "keys": [{"type": "GlobalReference", "value": value}]}


def prop(name, sid, value="v"):
    return {"modelType": "Property", "idShort": name, "semanticId": ref(sid), "valueType": "xs:string", "value": value}


def group(name, sid, *inner):
    return {"modelType": "SubmodelElementCollection", "idShort": name, "semanticId": ref(sid), "value": list(inner)}


def submodel(*inner):
    return {"modelType": "Submodel", "id": "urn:x", "semanticId": ref("top"), "submodelElements": list(inner)}


def tables(spark, docs):
    rows = spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in docs.items()], "doc_id string, text string")
    parsed = environment.parse(rows, "text")
    found = environment.submodels(parsed)
    return parsed, found, environment.elements(found)


def test_reader(spark, tmp_path):
    env = {"submodels": [submodel(group("g", "a", prop("p", "b"), prop("q", "c")), prop("r", "d"))]}
    parsed, found, elements = tables(spark, {"one": env, "bare": submodel(prop("z", "d")), "bad": "{", "none": {"x": 1}})
    assert {(r.doc_id, r.sm_ord, r.main_values[0]) for r in found.collect()} == {("one", 0, "top"), ("bare", 0, "top")}
    rows = sorted((r.doc_id, r.path, r.id_short, r.depth) for r in elements.collect())
    assert rows == [("bare", [0], "z", 1), ("one", [0], "g", 1), ("one", [0, 0], "p", 2), ("one", [0, 1], "q", 2), ("one", [1], "r", 1)]
    assert {(r.doc_id, r.stage) for r in environment.load_errors(parsed, found).collect()} == {("bad", "payload"), ("none", "chain")}
    (tmp_path / "x.json").write_text(json.dumps(env))
    assert environment.submodels(environment.read(spark, str(tmp_path))).count() == 1


def rows(spark, *given):
    """Template rows from (row_id, parent_id, kind, match, low, high) and, if given, more fields by name."""
    base = {"template": "top", "scope_id": None, "value_type": None, "list_type": None}
    made = [base | dict(zip(("row_id", "parent_id", "kind", "match", "low", "high"), r)) | {"row_ord": i, "label": f"L{r[0]}", "sid": r[3][0]} | (r[6] if len(r) > 6 else {}) for i, r in enumerate(given)]
    return spark.createDataFrame(made, "template string, row_id int, row_ord int, parent_id int, scope_id int, label string, kind string, sid string, match array<string>, low int, high int, value_type string, list_type string")


GROUP = "SubmodelElementCollection"


def test_walk(spark):
    template = rows(spark, (1, None, GROUP, ["a"], 1, None), (2, 1, "Property", ["b"], 1, 1, {"value_type": "xs:string"}), (3, None, "Property", ["d"], 0, 1))
    docs = {
        "good": submodel(group("g", "a", prop("p", "b")), prop("r", "d")),
        "short": submodel(group("g", "a"), group("h", "a", prop("p", "b"), prop("q", "b"))),
        "empty": submodel(prop("r", "d"), prop("s", "d")),
        "kind": submodel(prop("g", "a")),
        "value": submodel(group("g", "a", prop("p", "b", None) | {"valueType": "xs:int"})),
        "other": submodel(prop("g", "a")) | {"semanticId": ref("else")},
        "template": submodel(prop("g", "a")) | {"kind": "Template"},
    }
    _, found, elements = tables(spark, docs)
    got = {(r.doc_id, tuple(r.path), r.row_id, r.check, r.message) for r in walk.in_order(walk.findings(elements, found, template)).collect()}
    assert {x[:4] for x in got} == {
        ("short", (0,), 2, "count"), ("short", (1,), 2, "count"), ("empty", (), 1, "count"), ("empty", (), 3, "count"), ("kind", (0,), 1, "kind"),
        ("value", (0, 0), 2, "value"), ("value", (0, 0), 2, "value type"),
    }
    assert ("short", (1,), 2, "count", "the template expects exactly one 'L2' here; found 2") in got
    assert {(r.doc_id, r.row_id) for r in walk.not_examined(elements, found, template).collect()} == {("empty", 2), ("kind", 2)}


def test_claims(spark):
    template = rows(
        spark, (1, None, "Property", ["x", "shared"], 0, None), (2, None, "Property", ["shared"], 0, None), (3, None, "SubmodelElementList", ["list"], 0, 1, {"list_type": "Property"}),
        (4, 3, "Property", ["item"], 1, None), (5, None, GROUP, ["node"], 0, None), (6, 5, GROUP, ["node"], 0, None, {"scope_id": 5}), (7, 5, "Property", ["name"], 1, 1))
    two = lambda name, *keys: {"modelType": "Property", "idShort": name, "semanticId": {"type": "ExternalReference", "keys": [{"type": "GlobalReference", "value": k} for k in keys]}, "value": "v"}
    listed = {"modelType": "SubmodelElementList", "idShort": "l", "semanticId": ref("list"), "typeValueListElement": "Range", "value": [{"modelType": "Property", "value": "1"}, {"modelType": "Range"}]}
    deep = group("n", "node", prop("a", "name"), group("m", "node", prop("b", "name"), group("o", "node")))
    _, found, elements = tables(spark, {"d": submodel(prop("own", "shared"), two("first", "x", "y"), two("no", "q", "r"), listed, deep)})
    got = {(tuple(r.path), r.row_id) for r in walk.claims(elements, found, template).collect()}
    assert got == {((0,), 2), ((1,), 1), ((3,), 3), ((3, 0), 4), ((4,), 5), ((4, 0), 7), ((4, 1), 6), ((4, 1, 0), 7), ((4, 1, 1), 6)}
    wrong = {(tuple(r.path), r.row_id, r.check) for r in walk.findings(elements, found, template).collect()}
    assert wrong == {((3,), 3, "list type"), ((4, 1, 1), 7, "count")}


def test_stream(spark):
    folder = "/root/testdata/sf0.001"
    got = windows.run_available(windows.window_counts(windows.stream(spark, folder, "events"), "ts", "event_type", "1 day", "1 hour"))
    want = spark.read.parquet(f"{folder}/events.parquet").groupBy(F.date_trunc("day", "ts").alias("since"), "event_type").count()
    assert {(r.event_type, r.n) for r in got.collect()} == {(r["event_type"], r["count"]) for r in want.collect()}
    assert got.count() == want.count()
