"""Responses and their fields against plain JSON reading."""

import json
import random
import re

import pytest

from lodestrand.operators import interchange as I

RESPONSE = "page_id long, raw string"


def objects(text):
    """Top-level stretches, character by character."""
    out, depth, begin, quoted, skip = [], 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            skip, quoted = (False, True) if skip else (c == "\\", c != '"')
        elif c == '"':
            quoted = True
        elif c == "{":
            begin, depth = (i if depth == 0 else begin), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[begin : i + 1])
    return out


def read(raw):
    """The first object as plain JSON reading has it, or None."""
    text = re.sub(r"(?is)<think>.*?</think>", "", raw or "").strip()
    if fence := re.search(r"(?s)```(?:json)?\s*(.*?)\s*```", text):
        text = fence[1].strip()
    for t in ([text] if text.startswith("{") else []) + objects(text):
        try:
            value = json.loads(t)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, dict):
            return value
    return None


def line(value):
    if isinstance(value, list):
        return " ".join(line(x) for x in value).strip()
    return "" if value is None else str(value).strip()


def random_response(rng):
    values = ['"a"', '" b\\u3000"', "null", "true", "false", "12", "-0", "1.50", "1e5", "NaN", "-Infinity", '["x"," y "]', '["x",["y",null," "],true]', "[]", "{}", '{"q":[1,"z"]}', '"{in}"', '"\\"}"', "[1,2]", "[null]", '["p",null," q "]', "123456789012345678901234567890"]
    field = lambda: f'"{rng.choice(["title", "line2", "line3", "x"])}"{rng.choice([":", " : "])}{rng.choice(values)}'
    body = "{" + rng.choice([",", ", ", ",\n"]).join(field() for _ in range(rng.randint(0, 5))) + "}"
    if rng.random() < 0.3:
        k = rng.randrange(len(body))
        body = body[:k] + rng.choice(["", '"', "{", "}", "\\", ",", "\n", "'"]) + body[k + 1 :]
    parts = ["", " ", "prose ", "{", "}", '"', "{x} ", "[1] ", "<think>{}</think>", "　", '{"title":"first"} ', "{'a':1}"]
    text = rng.choice(parts) + body + rng.choice(parts)
    return rng.choice([text, text, f"```json\n{text}\n```", f"so:\n```\n{text}\n``` and ```{{}}```", f"<think>x{{</think>{text}"])


def test_random_responses(spark):
    rng = random.Random(12)
    raws = [random_response(rng) for _ in range(2000)] + [None, "", "  ", "{", '{"title":"a"} trailing', '{"title":"a","title":"b"}', "[{}]", '{"a":' * 3000 + "1" + "}" * 3000]
    table = spark.createDataFrame(list(enumerate(raws)), RESPONSE).repartition(4)
    parsed = I.parse_response(table).cache()
    got = {r.page_id: (r.json, r.error_code) for r in parsed.collect()}
    fields = {r.page_id: (r.title, r.line2, r.line3) for r in I.coerce_fields(parsed.where("json is not null")).collect()}
    for k, raw in enumerate(raws):
        want = read(raw)
        text, error = got[k]
        assert (text is None, error) == ((True, "llm_parse_error") if want is None else (False, None)), (raw, got[k])
        if want is not None:
            assert repr(json.loads(text)) == repr(want), raw
            assert fields[k] == tuple(line(want.get(f)) for f in I.FIELDS), (raw, fields[k])
    assert sum(error is None for _, error in got.values()) > 800


@pytest.mark.parametrize(("value", "text"), [(None, ""), (" a ", "a"), (["a", [" ", "b"], None, "c "], "a b  c"), ([], ""), ([[], [[]]], ""), (True, "True"), ([True, 1.0], "True 1.0"), ({"k": 1}, "{'k': 1}")])
def test_spelled(value, text):
    assert I.spelled(value) == text


def test_no_responses(spark):
    assert I.coerce_fields(I.parse_response(spark.createDataFrame([], RESPONSE))).collect() == []


def test_lists_in_lists_are_joined(spark):
    rows = [
        (0, '{"title": [["a", "b"], "c"], "line2": [1, [2, [" x ", null, true]]], "line3": null}', ("a b c", "1 2 x  True", "")),
        (1, '{"title": " t ", "line2": ["a", null, "b"], "line3": 5}', ("t", "a  b", "5")),
        (2, '{"title": [], "line2": [{"k": "v"}]}', ("", "{'k': 'v'}", "")),
    ]
    parsed = spark.createDataFrame([r[:2] for r in rows], "page_id long, json string")
    got = {r.page_id: (r.title, r.line2, r.line3) for r in I.coerce_fields(parsed).collect()}
    assert got == {k: want for k, _, want in rows}
