"""Model schemas: the wire tree, and the fields that conditions can search."""

from __future__ import annotations

import json
from dataclasses import dataclass
from enum import Enum
from functools import lru_cache

from fathomark.functions.datatypes import DataType, TypeSet, parse_data_type


class NodeKind(Enum):
    LEAF = "LEAF"
    OBJECT = "OBJECT"
    ARRAY = "ARRAY"


class ModelNode:
    """A node of a schema. The types are the node's own; the children are handed out as a copy, and changed by set_child."""

    def __init__(self, kind: NodeKind, types: TypeSet | None = None, element: ModelNode | None = None) -> None:
        self.kind, self.element = kind, element
        self.types = TypeSet() if types is None else types
        self._children: dict[str, ModelNode] = {}

    @classmethod
    def of_object(cls) -> ModelNode:
        return cls(NodeKind.OBJECT)

    @classmethod
    def of_leaf(cls, data_type: DataType) -> ModelNode:
        return cls(NodeKind.LEAF, TypeSet(data_type))

    @classmethod
    def of_array(cls, element: ModelNode | None = None) -> ModelNode:
        """An array without an element was never seen with content, and declares no field."""
        return cls(NodeKind.ARRAY, element=element)

    @property
    def children(self) -> dict[str, ModelNode]:
        return dict(self._children)

    def set_child(self, name: str, node: ModelNode) -> None:
        self._children[name] = node

    def child(self, name: str) -> ModelNode | None:
        return self._children.get(name)

    def fields(self) -> list[FieldDescriptor]:
        """As the tree is now; nothing is kept between calls."""
        return fields_of(self)


@dataclass(frozen=True)
class FieldDescriptor:
    path: str
    types: tuple[DataType, ...]
    is_array: bool = False
    max_width: int = 0


def _node(wire: object, where: str) -> ModelNode:
    if not isinstance(wire, dict):
        raise ValueError(f"{where}: not a node")
    try:
        kind = NodeKind(wire.get("kind"))
    except ValueError:
        raise ValueError(f"{where}: unknown node kind {wire.get('kind')!r}") from None
    node = ModelNode(kind)
    if kind is NodeKind.OBJECT:
        for name, child in (wire.get("children") or {}).items():
            node.set_child(name, _node(child, f"{where}.{name}"))
    elif kind is NodeKind.ARRAY and wire.get("element") is not None:
        node.element = _node(wire["element"], f"{where}[*]")
    for name in wire.get("types") or ():
        if (t := parse_data_type(name)) is None:
            raise ValueError(f"{where}: unknown data type {name!r}")
        node.types.add(t)
    return node


def parse_model(data: str | bytes) -> ModelNode:
    try:
        wire = json.loads(data)
    except ValueError as e:
        raise ValueError(f"not a schema: {e}") from None
    return _node(wire, "$")


def fields_of(root: ModelNode) -> list[FieldDescriptor]:
    """Every path with scalar values: leaves, elements of arrays, and objects that were also seen as scalars."""
    out: list[FieldDescriptor] = []
    todo = [(root, "$", False)]
    while todo:
        node, path, in_array = todo.pop(0)
        concrete = tuple(t for t in node.types.types() if t != DataType.NULL)
        if node.kind is NodeKind.LEAF:
            out.append(FieldDescriptor(path, tuple(node.types.types()), in_array))
        elif node.kind is NodeKind.OBJECT:
            if concrete:
                out.append(FieldDescriptor(path, concrete, in_array))
            todo += [(child, f"{path}.{k}", False) for k, child in sorted(node.children.items())]
        elif node.element is not None:
            todo.append((node.element, f"{path}[*]", node.element.kind is NodeKind.LEAF))
    return sorted(out, key=lambda f: f.path)


@lru_cache(maxsize=1024)
def _cached(data: bytes) -> tuple[FieldDescriptor, ...]:
    return tuple(fields_of(parse_model(data)))


def fields_map(data: str | bytes | None) -> dict[str, FieldDescriptor]:
    """The fields of a stored schema by path; none for an empty one."""
    if not data:
        return {}
    return {f.path: f for f in _cached(data.encode() if isinstance(data, str) else bytes(data))}
