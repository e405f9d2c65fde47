import json
import random

from mistrail.functions.json_triples import Wanted, by_items, by_tokens, is_json, triples
from mistrail.operators.nested_tables import record_triples, table_of


def leaves(value, maps, path="", ordinals=()):
    """The same triples from a parsed tree."""
    if isinstance(value, dict):
        if path.endswith("{}"):
            path, ordinals = path + "[]", (*ordinals, "0")
        yield path, ordinals, None, "object"
        for k, v in value.items():
            here, place = (path + "{}", (*ordinals, k)) if path in maps else (f"{path}.{k}" if path else k, ordinals)
            yield from leaves(v, maps, here, place)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaves(v, maps, path + "[]", (*ordinals, str(i)))
    elif value is None:
        yield path, ordinals, None, "null"
    elif isinstance(value, bool):
        yield path, ordinals, str(value).lower(), "boolean"
    elif isinstance(value, str):
        yield path, ordinals, value, "string"
    else:
        yield path, ordinals, json.dumps(value), "number"


def tree(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind == 0:
        return rng.choice([1, -2.5, 1e300, 0])
    if kind == 1:
        return rng.choice(["", 'a"b\\c\n{}[],:', "ü 図", "null"])
    if kind == 2:
        return rng.choice([None, True, False])
    if kind in (3, 4):
        return [tree(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", "k.x", 'q"', "m"]) + str(i): tree(rng, depth + 1) for i in range(rng.randrange(4))}


def test_triples_equal_those_of_the_parsed_tree():
    rng = random.Random(11)
    for _ in range(300):
        value = {"m": {str(k): tree(rng, 2) for k in range(rng.randrange(3))}, "rest": tree(rng)}
        for text in (json.dumps(value), json.dumps(value, ensure_ascii=False, indent=1)):
            every = list(leaves(value, {"m"}))
            assert list(triples(text, frozenset(["m"]))) == every
            for prefixes in (["m{}[]"], ["rest.a0", "rest[]"], ["rest.k", "m{}[].b"], []):
                some = [t for t in every if any(t[0].startswith(p) for p in prefixes)]
                for read in (by_items, by_tokens, triples):
                    assert list(read(text, frozenset(["m"]), "", (), Wanted(prefixes))) == some


def test_validity():
    assert is_json('{"a": 1}') and not is_json('{"a": 1') and not is_json("") and not is_json(None) and not is_json('{"a": NaN}')


def test_validity_equals_that_of_the_strict_decoder():
    strict = json.JSONDecoder(parse_constant=lambda name: (_ for _ in ()).throw(ValueError(name)))
    rng = random.Random(12)
    for _ in range(600):
        text = list(json.dumps({"m": tree(rng), "rest": tree(rng)}))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(text))
            text[k : k + rng.randrange(2)] = rng.choice(["", ",", "{", "}", "[", "]", '"', ":", "1", "0", "-", ".", "\\", "\n", "\x01", "NaN", "x", " "])
        text = "".join(text)
        try:
            strict.decode(text)
            valid = True
        except ValueError:
            valid = False
        for read in (by_items, by_tokens):
            for prefixes in (None, ["m.a0"], []):
                try:
                    list(read(text, frozenset(["m"]), "", (), Wanted(prefixes)))
                    assert valid, text
                except ValueError:
                    assert not valid, text


def test_any_depth_and_length(spark):
    deep = '{"a":' + "[" * 5_000 + "7" + "]" * 5_000 + ',"b":' + '{"c":' * 3000 + "1" + "}" * 3000 + "}"
    long = '{"a": [%s, "\\ud800x"]}' % ("9" * 6000)
    df = spark.createDataFrame([(1, deep), (2, long), (3, deep[:-1]), (4, "{}"), (5, '{"a":[1,{"x":2}]}')], "line_id long, body string")
    got = {(r.record_id, len(r.path), r.value, r.type) for r in record_triples(df, "line_id", "body", []).collect() if r.type != "object"}
    assert got == {(1, 1 + 2 * 5_000, "7", "number"), (1, 1 + 2 * 3000, "1", "number"), (2, 3, "9" * 6000, "number"), (2, 3, "?x", "string"), (5, 3, "1", "number"), (5, 5, "2", "number")}


def test_map_as_text_single_objects_and_links(spark):
    lines = [
        (1, '{"events":[{"R":{"d":{"7":{"p":1},"8":[{"p":2},{"p":3},4,null]}}},{"R":{"d":"{\\"9\\":{\\"p\\":5}}"}}]}'),
        (1, '{"events":[{"R":{"d":{"7":{"p":1},"8":[{"p":2},{"p":3},4,null]}}},{"R":{"d":"{\\"9\\":{\\"p\\":5}}"}}]}'),
        (2, '{"events":[{"R":{"d":{"7":{}}}}, {"R":{"d":"no json"}}, {"R":null}]}'),
        (3, '{"events":['), (4, None), (5, ""), (None, '{"events":[{"R":{"d":{"1":{"p":6}}}}]}'),
    ]
    df = spark.createDataFrame([(a, b, "x") for a, b in lines], "line_id long, body string, path string")
    parsed = record_triples(df, "line_id", "body", ["events[].R.d"])
    got = {(r.record_id, r.o0, r.o1, r.o2, r.p) for r in table_of(parsed, "events[].R.d{}[]", {"p": "p"}).collect()}
    assert got == {(1, "0", "7", "0", "1"), (1, "0", "8", "0", "2"), (1, "0", "8", "1", "3"), (1, "1", "9", "0", "5"), (2, "0", "7", "0", None), (None, "0", "1", "0", "6")}
    assert table_of(record_triples(df.limit(0), "line_id", "body", []), "events[]", {"p": "p"}).collect() == []
