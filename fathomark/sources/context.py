"""Who acts: the caller, the origin of what happens, and to whom a write is attributed."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from enum import Enum
from typing import Any

SYSTEM_TENANT = "SYSTEM"


class PrincipalKind(str, Enum):
    NONE = ""
    USER = "user"
    SERVICE = "service"
    SYSTEM = "system"


@dataclass(frozen=True)
class Principal:
    id: str = ""
    kind: PrincipalKind = PrincipalKind.NONE

    def __bool__(self) -> bool:
        return self != Principal()


@dataclass(frozen=True)
class UserContext:
    user_id: str
    tenant: str
    kind: PrincipalKind = PrincipalKind.USER
    roles: tuple[str, ...] = ()

    def has_role(self, role: str) -> bool:
        return role in self.roles

    @property
    def principal(self) -> Principal:
        return Principal(self.user_id, self.kind)


_user: ContextVar[UserContext | None] = ContextVar("user", default=None)
_ambient: ContextVar[Principal] = ContextVar("ambient", default=Principal())
_transaction: ContextVar[Any] = ContextVar("transaction", default=None)


@contextmanager
def _set(var: ContextVar, value: Any) -> Iterator[Any]:
    token = var.set(value)
    try:
        yield value
    finally:
        var.reset(token)


def acting(user: UserContext):
    return _set(_user, user)


def with_ambient_origin(p: Principal):
    return _set(_ambient, p or _ambient.get())


def with_transaction(tx: Any):
    return _set(_transaction, tx)


def current_user() -> UserContext | None:
    return _user.get()


def must_user() -> UserContext:
    user = _user.get()
    if user is None:
        raise RuntimeError("nobody is acting")
    return user


def ambient_origin() -> Principal:
    return _ambient.get()


def current_transaction() -> Any:
    return _transaction.get()


def resolve_origin() -> Principal:
    """The enclosing transaction's origin, else the ambient one, else the caller."""
    tx, user = _transaction.get(), _user.get()
    return (tx and tx.origin) or _ambient.get() or (user.principal if user else Principal())


def attribution() -> tuple[Principal, Principal]:
    """To whom a write is attributed, and who executes it: services and the system act for their transaction's origin."""
    user, tx = _user.get(), _transaction.get()
    executor = user.principal if user else Principal()
    if executor.kind in (PrincipalKind.SERVICE, PrincipalKind.SYSTEM) and tx is not None and tx.origin:
        return tx.origin, executor
    return executor, executor
