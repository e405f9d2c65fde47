"""A JSON text as (path, ordinals, value, type) triples, read item by item and checked as it is read."""

from __future__ import annotations

import json
import re
from collections.abc import Generator, Iterator
from json.decoder import scanstring

Triple = tuple[str, tuple[str, ...], str | None, str]


class _Number(str):
    """A number as it is written, of any length."""

    __slots__ = ()


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


_DECODER = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_refuse)
_SPACE = re.compile(r"[ \t\n\r]*")
_TOKEN = re.compile(
    r'[ \t\n\r]*([{}\[\],:]|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)'
)


class Wanted:
    """Which paths are wanted, by prefix, and which can lead to one; both are looked up once per path."""

    def __init__(self, prefixes: list[str] | None):
        self.prefixes = prefixes
        self.known: dict[str, tuple[bool, bool]] = {}

    def __call__(self, path: str) -> tuple[bool, bool]:
        """(whether the path is wanted, whether something below it may be)."""
        found = self.known.get(path)
        if found is None:
            under = self.prefixes is None or any(path.startswith(p) for p in self.prefixes)
            found = under, under or any(p.startswith(path) for p in self.prefixes)
            if len(path) < 512:
                self.known[path] = found
        return found


def _value(text: str, at: int) -> tuple[object, int]:
    """The value that begins at ``at``, decoded, and where it ends."""
    try:
        return _DECODER.scan_once(text, at)
    except StopIteration:
        raise ValueError(f"no value at {at}") from None


def _space(text: str, at: int) -> int:
    return _SPACE.match(text, at).end()


def _scalar(value: object, here: str, place: tuple[str, ...], maps: frozenset[str], wanted: Wanted, read) -> Iterator[Triple]:
    own = wanted(here)[0]
    if isinstance(value, str) and not isinstance(value, _Number):
        if here in maps and value:
            try:
                yield from list(read(value, maps, here, place, wanted))
                return
            except ValueError:
                pass
        if own:
            yield here, place, value, "string"
    elif own:
        kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number"
        yield here, place, None if value is None else str(value).lower() if kind == "boolean" else str(value), kind


def _walk(value: object, here: str, place: tuple[str, ...], maps: frozenset[str], wanted: Wanted) -> Iterator[Triple]:
    """The triples of a decoded value."""
    if isinstance(value, dict):
        if here.endswith("{}"):
            here, place = f"{here}[]", (*place, "0")
        own, below = wanted(here)
        if own:
            yield here, place, None, "object"
        if below:
            for key, child in value.items():
                if here in maps:
                    yield from _walk(child, f"{here}{{}}", (*place, key), maps, wanted)
                else:
                    yield from _walk(child, f"{here}.{key}" if here else key, place, maps, wanted)
    elif isinstance(value, list):
        if wanted(here)[1]:
            for position, child in enumerate(value):
                yield from _walk(child, f"{here}[]", (*place, str(position)), maps, wanted)
    else:
        yield from _scalar(value, here, place, maps, wanted, by_items)


def _members(text: str, at: int, here: str, place: tuple[str, ...], maps: frozenset[str], wanted: Wanted) -> Generator[Triple, None, int]:
    """The triples of the value that begins at ``at``; returns where it ends. Objects are read member by member, arrays
    item by item, and what is an item of an array or not wanted is decoded at once."""
    opening = text[at : at + 1]
    if opening == "{" and here.endswith("{}"):
        here, place = f"{here}[]", (*place, "0")
    own, below = wanted(here)
    if opening not in ("{", "[") or not below:
        value, end = _value(text, at)
        if opening not in ("{", "["):
            yield from _scalar(value, here, place, maps, wanted, by_items)
        return end
    closing = "}" if opening == "{" else "]"
    if opening == "{" and own:
        yield here, place, None, "object"
    at, position = _space(text, at + 1), 0
    if text[at : at + 1] == closing:
        return at + 1
    while True:
        if opening == "[":
            value, at = _value(text, at)
            yield from _walk(value, f"{here}[]", (*place, str(position)), maps, wanted)
            position += 1
        else:
            if text[at : at + 1] != '"':
                raise ValueError(f"no key at {at}")
            key, at = scanstring(text, at + 1, True)
            at = _space(text, at)
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            at = _space(text, at + 1)
            child, where = (f"{here}{{}}", (*place, key)) if here in maps else (f"{here}.{key}" if here else key, place)
            at = yield from _members(text, at, child, where, maps, wanted)
        at = _space(text, at)
        after = text[at : at + 1]
        if after == closing:
            return at + 1
        if after != ",":
            raise ValueError(f"no comma at {at}")
        at = _space(text, at + 1)


def by_items(text: str, maps: frozenset[str], path: str, ordinals: tuple[str, ...], wanted: Wanted) -> Iterator[Triple]:
    """Triples of a text, one array item in memory at a time; RecursionError where it is nested too deep for that."""
    end = yield from _members(text, _space(text, 0), path, ordinals, maps, wanted)
    if _space(text, end) != len(text):
        raise ValueError(f"more text at {end}")


VALUE, FIRST, KEY, COLON, AFTER = range(5)


def by_tokens(text: str, maps: frozenset[str], path: str, ordinals: tuple[str, ...], wanted: Wanted) -> Iterator[Triple]:
    """The same token by token, for texts of any depth."""
    #: Open containers: [is array, path or None where nothing below is wanted, ordinals, position or key]
    stack: list[list] = []
    state, at = VALUE, 0
    while match := _TOKEN.match(text, at):
        token, at = match.group(1), match.end()
        top = stack[-1] if stack else None
        if state == COLON:
            if token != ":":
                raise ValueError(f"no colon at {at}")
            state = VALUE
        elif token in "}]":
            if not top or state not in (FIRST, AFTER) or top[0] != (token == "]"):
                raise ValueError(f"nothing to close at {at}")
            stack.pop()
            state = AFTER
        elif state == AFTER:
            if token != "," or not top:
                raise ValueError(f"no comma at {at}")
            if top[0]:
                top[3] += 1
            state = VALUE if top[0] else KEY
        elif state == KEY or state == FIRST and not top[0]:
            if token[0] != '"':
                raise ValueError(f"no key at {at}")
            top[3], state = json.loads(token), COLON
        elif token in ",:":
            raise ValueError(f"no value at {at}")
        else:
            here, place = path, ordinals
            if top:
                is_array, up, ords, position = top
                if up is None:
                    here = None
                elif is_array:
                    here, place = f"{up}[]", (*ords, str(position))
                elif up in maps:
                    here, place = f"{up}{{}}", (*ords, position)
                else:
                    here, place = f"{up}.{position}" if up else position, ords
            if here is not None and token == "{" and here.endswith("{}"):
                here, place = f"{here}[]", (*place, "0")
            if token in "{[":
                own, below = wanted(here) if here is not None else (False, False)
                if own and token == "{":
                    yield here, place, None, "object"
                stack.append([token == "[", here if below else None, place, 0])
                state = FIRST
            else:
                if here is not None:
                    yield from _scalar(_DECODER.decode(token), here, place, maps, wanted, by_tokens)
                state = AFTER
    if state != AFTER or stack or _space(text, at) != len(text):
        raise ValueError(f"not JSON at {at}")


def triples(text: str, maps: frozenset[str] = frozenset(), path: str = "", ordinals: tuple[str, ...] = (), wanted: Wanted = Wanted(None)) -> Iterator[Triple]:
    """Triples of a JSON text; ValueError, perhaps after some, where it isn't valid (NaN and Infinity are not).

    In a path, ``.k`` is a member, ``[]`` an array item and ``{}`` an entry of a map whose keys are data (``maps`` has the
    paths of such maps); each ``[]`` and ``{}`` has its ordinal: the position in the array, the key of the entry. An
    object directly in a map entry counts as an array of one, a map given as JSON text is read as that map. Objects have
    a triple of their own, without value; arrays have none. Numbers stay as they are written. Of a key that an object in
    an array has twice, the last value counts. What isn't ``wanted`` is checked and passed over.
    """
    found: list[Triple] = []
    reader = by_items(text, maps, path, ordinals, wanted)
    try:
        for triple in reader:
            found.append(triple)
            if len(found) > 1000:
                # Too deep an item may still come: what is given must not be given again.
                break
        else:
            yield from found
            return
    except RecursionError:
        yield from by_tokens(text, maps, path, ordinals, wanted)
        return
    given = len(found)
    yield from found
    try:
        for triple in reader:
            given += 1
            yield triple
    except RecursionError:
        for k, triple in enumerate(by_tokens(text, maps, path, ordinals, wanted)):
            if k >= given:
                yield triple


def is_json(text: str | None) -> bool:
    """Whether ``text`` is one valid JSON value."""
    try:
        for _ in triples(text, wanted=Wanted([])):
            pass
    except (ValueError, TypeError):
        return False
    return True
