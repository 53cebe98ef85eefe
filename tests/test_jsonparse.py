"""P11/P12 on hostile replies with literal expectations."""

import json

from cartograph.functions import jsonparse as J

OBJ = ('{"baseline": {"accuracy": 5, "completeness": 6, "specificity": 7, "actionability": 8, "notes": "b {x}"}, '
       '"enhanced": {"accuracy": 9, "completeness": 9.5, "specificity": 8, "actionability": 7}}')
SCORES = [5, 6, 7, 8, 9, 9.5, 8, 7]
DEEP = "[" * 40 + "1" + "]" * 40
CASES = [  # reply, expected reason
    (OBJ, "ok"), ("```json\n" + OBJ + "\n```", "ok"), ("```\n" + OBJ + "\n```", "ok"), ("Here: " + OBJ + " done", "ok"),
    (OBJ[:-1] + ', "extra": ' + DEEP + "}", "ok"), (OBJ[:-1] + ', "extra": "]}"}', "ok"),
    (OBJ + " and " + OBJ, "not_strict_json"), (OBJ[:50], "no_object"), ("nothing", "no_object"), ("[1, 2]", "no_object"),
    (OBJ.replace('"accuracy": 5', '"accuracy": "5"'), "bad_scores"), (OBJ.replace('"specificity": 7, ', ""), "bad_scores"),
    (OBJ.replace('"accuracy": 5', '"accuracy": true'), "bad_scores"),
    (OBJ.replace('"', "'"), "not_strict_json"), (OBJ.replace("}}", "},}"), "not_strict_json"), ("} {", "not_strict_json"),
    (OBJ.replace(": 5,", ": NaN,"), "not_strict_json"), (OBJ.replace(": 5,", ": 05,"), "not_strict_json"),
    (OBJ[:-1] + "]", "not_strict_json"), (OBJ[:-1] + ', "a": [1 2]}', "not_strict_json"),
    (OBJ[:-1] + ', "baseline": 1}', "not_strict_json"),      # a repeated key is rejected
]


def test_parse_scores_of_hostile_replies(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(CASES)], "i int, raw string")
    out = {r.i: r for r in J.with_parsed_scores(df, "raw").collect()}
    for i, (raw, reason) in enumerate(CASES):
        assert out[i].reason == reason, raw
        got = [out[i][f"{a[0]}_{c}"] for a in J.ARMS for c in J.CRITERIA]
        assert got == (SCORES if reason == "ok" else [None] * 8), raw


def test_strictness_agrees_with_the_standard_library(spark):
    texts = ["{}", "[]", '{"a":1}', '{"a":1} x', '{"a":1}{"b":2}', '{"a":[1,2,{"b":null}]}', "[1],[2]", '"a","b":1', '{"a":1,}',
             "{'a':1}", '{"a":.5}', '{"a":-0.5e+3}', '{"a":"\\u00e9\\n"}', '{"a":"tab\t"}', "[" * 60 + "]" * 60, "1", "", " [1] ", "[1 2]", "[01]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", J.single_value("s").alias("ok"))
    for r in df.collect():
        try:
            json.loads(texts[r.i])
            want = True
        except ValueError:
            want = False
        assert r.ok == want, texts[r.i]


def test_parse_query_items(spark):
    items = '[{"query": "q1", "category": "c", "key_facts": ["a", "b"]}, {"query": "q2", "key_facts": []}]'
    rows = [(0, items), (1, "```json\n" + items + "\n```"), (2, items[:-1] + ", ]"), (3, "none"), (4, items + " " + items)]
    df = spark.createDataFrame(rows, "i int, raw string")
    out = {r.i: r for r in J.with_parsed_query_items(df, "raw").collect()}
    assert out[0].reason == "ok" and [x.query for x in out[0]["items"]] == ["q1", "q2"]
    assert out[1].reason == "ok"
    assert out[2].reason == "not_strict_json"
    assert out[3].reason == "no_array"
    assert out[4].reason == "not_strict_json"


def test_long_string_values_do_not_overflow(spark):
    note = ("word \\\"quoted\\\" " * 20000)
    raw = OBJ.replace('"notes": "b {x}"', f'"notes": "{note}"')
    df = spark.createDataFrame([(0, raw)], "i int, raw string")
    row = J.with_parsed_scores(df, "raw").first()
    assert row.reason == "ok" and row.b_accuracy == 5.0
