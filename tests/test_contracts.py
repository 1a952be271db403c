"""Odd interface descriptions and odd XML."""

from sparkloom.operators import contracts as c


def specs(spark, rows):
    return spark.createDataFrame(rows, "name string, text string")


def test_odd_specs(spark):
    rows = [
        ("null", None), ("no", "{}"), ("bad", "{openapi"), ("text", "hello"), ("empty", '{"openapi": "3"}'), ("odd", '{"paths": {"/a": 3, "/b": {"get": [], "put": {}}, "/c": null}}'),
        ("shared", '{"swagger": "2", "paths": {"/x": {"parameters": [{"name": "p", "required": true}, {"name": "q"}], "GET": {}, "get": {"deprecated": true, "parameters": [{"name": "p", "required": false}], "responses": {"404": {}, "200": {}}}}}, "definitions": {"A": {}}, "securityDefinitions": {"z": {}, "b": {}}}'),
    ]
    got = {(r["name"], r["operation"]): r for r in c.operations(specs(spark, rows)).collect()}
    assert set(got) == {("odd", "PUT /b"), ("shared", "GET /x")}
    one = got["shared", "GET /x"]
    assert one["parameters"] == {"p": False, "q": False} and one["responses"] == ["200", "404"] and one["deprecated"]
    told = {r["name"]: r for r in c.summaries(specs(spark, rows)).collect()}
    assert set(told) == {"empty", "odd", "shared"} and told["shared"]["auth_schemes"] == "b,z" and told["shared"]["schemas"] == 1 and told["empty"]["operations"] == 0 and told["odd"]["paths"] == 3


def test_breaking(spark):
    old = '{"paths": {"/a": {"get": {"responses": {"200": {}, "404": {}}}, "put": {}}, "/b": {"get": {"parameters": [{"name": "p", "required": true}]}}}}'
    new = '{"paths": {"/a": {"get": {"parameters": [{"name": "k", "required": true}, {"name": "o"}], "responses": {"200": {}}}}, "/b": {"get": {"parameters": [{"name": "p", "required": true}]}, "post": {}}}}'
    got = {(r["change"], r["operation"], r["detail"]) for r in c.breaking(specs(spark, [("x", old), ("gone", old)]), specs(spark, [("x", new), ("made", new)])).collect()}
    assert got == {("removed", "PUT /a", ""), ("required", "GET /a", "k"), ("response", "GET /a", "404"), ("added", "POST /b", "")}
    assert c.breaking(specs(spark, [("x", old)]), specs(spark, [("x", old)])).count() == 0


def test_odd_xml(spark):
    rows = {
        "ok": "<a x='1'><b/><b><c>t</c></b><!-- <d> --><![CDATA[<e>]]></a>", "entity": "<!DOCTYPE a [<!ENTITY x 'y'>]><a/>", "crossed": "<a><b></a></b>", "open": "<a><b>", "two": "<a/><b/>", "none": "text", "empty": "", "null": None, "deep": "<a>" * 50_000 + "</a>" * 50_000, "declared": "<?xml version='1.0'?><a:b xmlns:a='u'/>",
    }
    got = {r["path"]: r for r in c.xml_structures(spark.createDataFrame(list(rows.items()), "path string, text string")).collect()}
    assert {p: r["status"] for p, r in got.items()} == {"ok": "read", "entity": "refused", "crossed": "malformed", "open": "malformed", "two": "malformed", "none": "malformed", "empty": "malformed", "null": "malformed", "deep": "read", "declared": "read"}
    assert (got["ok"]["root"], got["ok"]["elements"], got["ok"]["max_depth"], got["ok"]["top_level"], got["ok"]["counts"]) == ("a", 4, 3, ["b", "b"], {"a": 1, "b": 2, "c": 1})
    assert got["deep"]["max_depth"] == 50_000 and got["declared"]["root"] == "a:b"
