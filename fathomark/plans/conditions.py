"""Conditions as callers write them: a tree of JSON objects."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

MAX_NESTING = 50


class Number(str):
    """A JSON number as it was written, so that no digit is lost."""

    __slots__ = ()


@dataclass
class Simple:
    path: str
    operator: str
    value: Any = None
    type = "simple"

    def wire(self) -> dict:
        return {"type": self.type, "jsonPath": self.path, "operatorType": self.operator, "value": self.value}


@dataclass
class Lifecycle:
    field: str
    operator: str
    value: Any = None
    type = "lifecycle"

    def wire(self) -> dict:
        return {"type": self.type, "field": self.field, "operatorType": self.operator, "value": self.value}


@dataclass
class Group:
    operator: str = "AND"
    conditions: list = field(default_factory=list)
    type = "group"

    def wire(self) -> dict:
        return {"type": self.type, "operator": self.operator, "conditions": [c.wire() for c in self.conditions or []]}


@dataclass
class Array:
    path: str
    values: list = field(default_factory=list)
    type = "array"

    def wire(self) -> dict:
        return {"type": self.type, "jsonPath": self.path, "values": self.values}


@dataclass
class Function:
    type = "function"

    def wire(self) -> dict:
        return {"type": self.type}


Condition = Simple | Lifecycle | Group | Array | Function


def parse_condition(text: str | bytes) -> Condition:
    try:
        body = json.loads(text, parse_int=Number, parse_float=Number)
    except ValueError as e:
        raise ValueError(f"not a condition: {e}") from None
    return _parsed(body, 0)


def _text(body: dict, *names: str) -> str:
    """The first of these members that isn't empty."""
    for name in names:
        value = body.get(name)
        if value is not None and (not isinstance(value, str) or isinstance(value, Number)):
            raise ValueError(f"{name} must be text")
        if value:
            return value
    return ""


def _list(body: dict, name: str) -> list:
    value = body.get(name)
    if value is not None and not isinstance(value, list):
        raise ValueError(f"{name} must be a list")
    return value or []


def _parsed(body: Any, depth: int) -> Condition:
    if depth > MAX_NESTING:
        raise ValueError(f"conditions nest deeper than {MAX_NESTING}")
    if not isinstance(body, dict):
        raise ValueError("a condition must be an object")
    match body.get("type"):
        case "simple":
            return Simple(_text(body, "jsonPath"), _text(body, "operatorType", "operator", "operation"), body.get("value"))
        case "lifecycle":
            return Lifecycle(_text(body, "field"), _text(body, "operatorType", "operator", "operation"), body.get("value"))
        case "group":
            return Group(_text(body, "operator"), [_parsed(c, depth + 1) for c in _list(body, "conditions")])
        case "array":
            return Array(_text(body, "jsonPath"), _list(body, "values"))
        case "function":
            return Function()
        case other:
            raise ValueError(f"unknown condition type: {other!r}")


def _json(value: Any) -> str:
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_json(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(_json, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def write_condition(condition: Condition) -> str:
    """JSON that parses to the same condition; numbers keep their text."""
    return _json(condition.wire())
