"""Workflow definitions and state machine events, to and from their wire form.

What is None is left out of the wire form, so that absent and false stay apart; annotations are carried
as they are.
"""

from __future__ import annotations

import dataclasses
import types
import typing
from dataclasses import dataclass, field
from datetime import datetime
from enum import Enum
from typing import Any


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


class Wire:
    """Members in camel case; members that are always written are named in ALWAYS."""

    ALWAYS: typing.ClassVar[tuple[str, ...]] = ()
    NAMES: typing.ClassVar[dict[str, str]] = {}

    def to_wire(self) -> dict[str, Any]:
        out = {}
        for f in dataclasses.fields(self):
            value = getattr(self, f.name)
            if value is None or f.name not in self.ALWAYS and value in ("", 0, [], {}) and not isinstance(f.default, type(None)):
                continue
            out[self.NAMES.get(f.name, _camel(f.name))] = _written(value)
        return out

    @classmethod
    def from_wire(cls, wire: dict[str, Any]):
        hints = typing.get_type_hints(cls)
        names = {cls.NAMES.get(f.name, _camel(f.name)): f.name for f in dataclasses.fields(cls)}
        return cls(**{names[k]: _read(hints[names[k]], v) for k, v in wire.items() if k in names})


def _written(value: Any) -> Any:
    if isinstance(value, Wire):
        return value.to_wire()
    if isinstance(value, list):
        return [_written(v) for v in value]
    if isinstance(value, dict):
        return {k: _written(v) for k, v in value.items()}
    return value.value if isinstance(value, Enum) else value.isoformat() if isinstance(value, datetime) else value


def _read(hint: Any, value: Any) -> Any:
    args = [a for a in typing.get_args(hint) if a is not type(None)]
    if value is None:
        return None
    if isinstance(hint, types.UnionType) or typing.get_origin(hint) is typing.Union:
        return _read(args[0], value)
    if typing.get_origin(hint) is list:
        return [_read(args[0], v) for v in value]
    if typing.get_origin(hint) is dict:
        return {k: _read(args[1], v) for k, v in value.items()}
    if isinstance(hint, type) and issubclass(hint, Wire):
        return hint.from_wire(value)
    if isinstance(hint, type) and issubclass(hint, Enum):
        return hint(value)
    return datetime.fromisoformat(value) if hint is datetime else value


@dataclass
class ProcessorConfig(Wire):
    attach_entity: bool | None = None
    calculation_nodes_tags: str = ""
    response_timeout_ms: int = 0
    retry_policy: str = ""
    context: str = ""
    start_new_tx_on_dispatch: bool | None = None
    async_result: bool | None = None
    crossover_to_async_ms: int | None = None


@dataclass
class ProcessorDefinition(Wire):
    ALWAYS = ("type", "name", "config")
    type: str = ""
    name: str = ""
    execution_mode: str = ""
    config: ProcessorConfig = field(default_factory=ProcessorConfig)
    annotations: Any = None


@dataclass
class ScheduleFunction(Wire):
    ALWAYS = ("name", "result_kind", "calculation_nodes_tags", "attach_entity")
    name: str = ""
    result_kind: str = "Schedule"
    calculation_nodes_tags: str = ""
    attach_entity: bool = False
    context: str = ""
    response_timeout_ms: int = 0


@dataclass
class TransitionSchedule(Wire):
    """A delay with an optional timeout, or a function that gives them; not both."""

    ALWAYS = ("delay_ms",)
    delay_ms: int = 0
    timeout_ms: int | None = None
    function: ScheduleFunction | None = None

    def validate(self) -> None:
        if self.function is not None and (self.delay_ms or self.timeout_ms is not None):
            raise ValueError("a schedule has a delay or a function")
        if self.function is not None and self.function.result_kind != "Schedule":
            raise ValueError("a schedule's function must give a Schedule")


@dataclass
class TransitionDefinition(Wire):
    ALWAYS = ("name", "next", "manual")
    name: str = ""
    next: str = ""
    manual: bool = False
    disabled: bool | None = None
    criterion: Any = None
    processors: list[ProcessorDefinition] = field(default_factory=list)
    schedule: TransitionSchedule | None = None
    annotations: Any = None
    criterion_annotations: Any = None


@dataclass
class StateDefinition(Wire):
    transitions: list[TransitionDefinition] = field(default_factory=list)
    annotations: Any = None


@dataclass
class WorkflowDefinition(Wire):
    ALWAYS = ("version", "name", "initial_state", "active", "states")
    NAMES = {"description": "desc"}
    version: str = ""
    name: str = ""
    description: str = ""
    initial_state: str = ""
    active: bool = False
    criterion: Any = None
    states: dict[str, StateDefinition] = field(default_factory=dict)
    annotations: Any = None
    criterion_annotations: Any = None


class EventType(Enum):
    """What a state machine reports."""

    STARTED = "STATE_MACHINE_START"
    FINISHED = "STATE_MACHINE_FINISH"
    CANCELLED = "CANCEL"
    FORCED_SUCCESS = "FORCE_SUCCESS"
    WORKFLOW_FOUND = "WORKFLOW_FOUND"
    WORKFLOW_NOT_FOUND = "WORKFLOW_NOT_FOUND"
    WORKFLOW_SKIPPED = "WORKFLOW_SKIP"
    TRANSITION_MADE = "TRANSITION_MAKE"
    TRANSITION_NOT_FOUND = "TRANSITION_NOT_FOUND"
    TRANSITION_CRITERION_NO_MATCH = "TRANSITION_NOT_MATCH_CRITERION"
    PROCESS_CRITERION_NO_MATCH = "PROCESS_NOT_MATCH_CRITERION"
    PROCESSING_PAUSED = "PAUSE_FOR_PROCESSING"
    STATE_PROCESS_RESULT = "STATE_PROCESS_RESULT"
    SCHEDULED_ARMED = "SCHEDULED_TRANSITION_ARM"
    SCHEDULED_FIRED = "SCHEDULED_TRANSITION_FIRE"
    SCHEDULED_EXPIRED = "SCHEDULED_TRANSITION_EXPIRE"
    SCHEDULED_CANCELLED = "SCHEDULED_TRANSITION_CANCEL"


@dataclass
class StateMachineEvent(Wire):
    ALWAYS = ("event_type", "entity_id", "time_uuid", "details", "timestamp")
    event_type: EventType = EventType.STARTED
    entity_id: str = ""
    time_uuid: str = ""
    state: str = ""
    transaction_id: str = ""
    details: str = ""
    data: dict[str, Any] | None = None
    timestamp: datetime | None = None


@dataclass
class ExecutionResult:
    state: str
    success: bool
    stop_reason: str = ""
    error: Exception | None = None
