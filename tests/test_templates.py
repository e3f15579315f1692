"""Template documents to rows, against a recursive builder in Python."""

import json
import random
from collections import Counter

import pytest

from vellum.operators import walk as K
from vellum.sources import environment as E
from vellum.sources import templates as T

SMC, SML, P = "SubmodelElementCollection", "SubmodelElementList", "Property"
COUNT = {"One": (1, 1), "ZeroToOne": (0, 1), "OneToMany": (1, None), "ZeroToMany": (0, None)}


def element(rng, depth=0):
    kind = rng.choice([SMC, SMC, SML, P, "Entity"])
    out = {"modelType": kind}
    if rng.random() < 0.85:
        out["idShort"] = rng.choice(["A", "B", "C", "D", "E"])
    if rng.random() < 0.9:
        out["semanticId"] = {"type": "ExternalReference", "keys": [{"type": "GlobalReference", "value": rng.choice(["urn:a", " urn:b", "0173-1#01-AHF578#003~1", T.MARKERS[0], "urn:irdi:0173-1%2302-ABC001%23001"])} for _ in range(rng.choice([1, 1, 1, 2]))]}
    if rng.random() < 0.2:
        out["supplementalSemanticIds"] = [{"keys": [{"value": rng.choice(["urn:s", T.MARKERS[0]])}]}]
    if rng.random() < 0.7:
        out["qualifiers"] = [{"type": rng.choice(["SMT/Cardinality", "Multiplicity", "Cardinality", "Other"]), "value": rng.choice([*COUNT, "None"])} for _ in range(rng.randrange(1, 3))]
    if kind == P:
        out["valueType"] = "xs:string"
    else:
        out["statements" if kind == "Entity" else "value"] = [element(rng, depth + 1) for _ in range(rng.randrange(0, 4 if depth < 3 else 1))]
    if kind in ("Entity", SMC) and rng.random() < 0.3 and "semanticId" in out:
        out["statements" if kind == "Entity" else "value"].append({"modelType": kind, "idShort": rng.choice(["A", "F"]), "semanticId": out["semanticId"], "qualifiers": [{"type": "SMT/Cardinality", "value": rng.choice(list(COUNT))}]})
    return out


def normal(v):
    v = v.strip()
    return v[len("urn:irdi:") :].replace("%23", "#") if v.startswith("urn:irdi:") else v


def by_hand(doc):
    import re

    rows, n = [], [0]

    def values(ref):
        keys = [normal(k["value"]) for k in (ref or {}).get("keys", [])]
        out = set(keys) | ({"/".join(keys)} if len(keys) > 1 else set())
        return out | {re.sub(r"~\d+", "", v) for v in out}

    def sid(e, f=lambda v: v):
        return "/".join(f(k["value"]) for k in e.get("semanticId", {}).get("keys", []))

    def visit(e, at, up, holder):
        if sid(e, normal) in T.MARKERS:
            return
        n[0] += 1
        row_id = f"TPL-E{n[0]:02d}"
        label = e.get("idShort") or (up[0] if up else "") + "Item"
        held = [c for f in ("value", "statements") for c in e.get(f, []) if "modelType" in c]
        copies = bool(holder) and sid(e) != "" and sid(e) == sid(holder[1]) and e["modelType"] == holder[1]["modelType"] and e["modelType"] in ("Entity", SMC) and not held
        quals = {q["type"]: q.get("value") for q in e.get("qualifiers", [])}
        card = next((COUNT.get(quals[q], (0, None)) for q in ("SMT/Cardinality", "Multiplicity", "Cardinality") if q in quals), (0, None))
        endless = card[0] if copies and card[0] > 0 else None
        card = (0, card[1]) if endless else card
        match = sorted((values(e.get("semanticId")) | {v for r in e.get("supplementalSemanticIds", []) for v in values(r)}) - set(T.MARKERS))
        lost = not match and not (holder and holder[1]["modelType"] == SML)
        card = (0, None) if lost else card
        rows.append({"row_id": row_id, "row_ord": at, "parent_id": holder[0] if holder else None, "scope_id": holder[0] if copies else None, "label": label, "above": up, "kind": e["modelType"], "sid": sid(e, normal) or None, "match": match, "low": card[0], "high": card[1], "value_type": e.get("valueType"), "unidentified": lost, "endless": endless})
        for i, c in enumerate(held):
            visit(c, i, [label, *up], (row_id, e))

    for i, e in enumerate(doc["submodels"][0]["submodelElements"]):
        visit(e, i, [], None)
    for label, count in Counter(r["label"] for r in rows).items():
        if count > 1:
            group = [r for r in rows if r["label"] == label]
            k, deepest = 1, max(len(r["above"]) for r in group)
            while k < deepest and len({tuple(r["above"][:k]) for r in group}) < count:
                k += 1
            for r in group:
                suffix = "/".join(reversed(r["above"][:k]))
                r["shown"] = f"{label} ({suffix})" if suffix else label
    for r in rows:
        r["label"] = r.pop("shown", r["label"])
    return rows, len({r["label"] for r in rows}) == len(rows)


def parsed(spark, docs):
    return E.parse(spark.createDataFrame([(i, json.dumps(d)) for i, d in docs], "doc_id long, text string"), "text")


def template(elements, sid="urn:t"):
    return {"submodels": [{"modelType": "Submodel", "semanticId": {"keys": [{"value": sid}]}, "submodelElements": elements}]}


def test_rows_equal_a_recursive_builder(spark):
    rng = random.Random(4)
    docs = [(i, template([element(rng) for _ in range(rng.randrange(1, 4))])) for i in range(150)]
    rows, refused = T.build(parsed(spark, docs))
    got = {}
    for r in rows.collect():
        assert r.template == "urn:t"
        got.setdefault(r.doc_id, []).append({c: r[c] for c in ("row_id", "row_ord", "parent_id", "scope_id", "label", "kind", "sid", "match", "low", "high", "value_type", "unidentified", "endless")})
    no = {r.doc_id for r in refused.collect()}
    kept = 0
    for i, d in docs:
        want, good = by_hand(d)
        for r in want:
            r.pop("above")
        assert good == (i not in no)
        if good:
            kept += 1
            assert sorted(got.get(i, []), key=lambda r: r["row_id"]) == sorted(want, key=lambda r: r["row_id"])
    assert 40 < kept < 150 and any(r["endless"] for v in got.values() for r in v) and any("/" in r["label"] for v in got.values() for r in v)


def test_refusals(spark):
    same = {"modelType": P, "idShort": "X", "semanticId": {"keys": [{"value": "urn:x"}]}}
    docs = [(0, {"a": 1}), (1, {"submodels": []}), (2, template([])), (3, {"submodels": [{"submodelElements": [same]}]}), (4, template([same, same])), (5, template([{**same, "idShort": f"n{i}"} for i in range(6)])), (6, template([same]))]
    rows, refused = T.build(parsed(spark, docs), most=5)
    assert {r.doc_id: r.message for r in refused.collect()} == {0: "no submodels, so there is no template in it", 1: "no submodels, so there is no template in it", 2: "the first submodel declares no semanticId or no elements", 3: "the first submodel declares no semanticId or no elements", 4: "two rows share a label (X)", 5: "more than 5 rows"}
    assert [r.doc_id for r in rows.collect()] == [6]


@pytest.mark.parametrize("raw, own, yes, no", [
    (r"Part[\d{2,3}]", "Part", ["Part", "Part01", "Part123"], ["Part1", "Part1234", "xPart", "Part "]), (r"Part[\d{2}]", "Other", ["Part", "Part12", "Other"], ["Part123", "Other1"]),
    ("A.b(c", None, ["A.b(c"], ["Axb(c", "A.b"]), (r"A[\d{3,2}]", "A", None, None), ("Plain", "Own", ["Plain", "Own"], ["plain", "OwnPlain"]),
])
def test_name_patterns(spark, raw, own, yes, no):
    import re

    from pyspark.sql import functions as F

    found = spark.createDataFrame([(raw, own)], "raw string, own string").select(T.name_pattern(F.col("raw"), F.col("own"))).first()[0]
    if yes is None:
        assert found is None
        return
    assert all(re.match(found, x) for x in yes) and not any(re.match(found, x) for x in no)


def test_many_repeated_labels(spark):
    """8,000 rows that share two labels: rounds, not pairs."""
    held = [{"modelType": SMC, "idShort": f"n{i}", "semanticId": {"keys": [{"value": f"urn:{i}"}]}, "value": [{"modelType": P, "idShort": s, "semanticId": {"keys": [{"value": "urn:p"}]}} for s in ("X", "Y")]} for i in range(3000)]
    rows, refused = T.build(parsed(spark, [(0, template(held))]))
    labels = [r.label for r in rows.select("label").collect()]
    assert len(labels) == 9000 == len(set(labels)) and "X (n17)" in labels and refused.count() == 0


def test_a_walk_by_a_built_template(spark):
    ref = lambda v: {"keys": [{"type": "GlobalReference", "value": v}]}
    t = template([{"modelType": SMC, "idShort": "Line", "semanticId": ref("urn:line"), "qualifiers": [{"type": "Multiplicity", "value": "OneToMany"}], "value": [{"modelType": P, "idShort": "Ship", "semanticId": ref("urn:ship"), "valueType": "xs:date", "qualifiers": [{"type": "SMT/Cardinality", "value": "One"}]}]}])
    rows, _ = T.build(parsed(spark, [(0, t)]))
    docs = parsed(spark, [(1, template([{"modelType": SMC, "semanticId": ref("urn:line"), "value": []}])), (2, template([]))])
    found = E.submodels(docs)
    got = K.findings(E.elements(found), found, rows.select(*T.COLUMNS))
    assert sorted((r.doc_id, r.row_id, r.check) for r in got.collect()) == [(1, "TPL-E02", "count"), (2, "TPL-E01", "count")]
