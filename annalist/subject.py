"""Subjects and events as Python objects."""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Mapping, Sequence
from typing import Any


class Event:
    """One event. Any property is an attribute, None where it is null; iteration gives the non-null ones by name."""

    __slots__ = ("_values",)

    def __init__(self, values: Mapping[str, Any]):
        object.__setattr__(self, "_values", values)

    def __getattr__(self, name: str) -> Any:
        try:
            return self._values[name]
        except KeyError:
            raise AttributeError(f"no property {name!r}") from None

    def __setattr__(self, name: str, value: Any) -> None:
        raise AttributeError("events of a database cannot be changed")

    def __iter__(self) -> Iterator[tuple[str, Any]]:
        return ((k, v) for k, v in self._values.items() if v is not None)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Event) and dict(self) == dict(other)

    __hash__ = None

    def __str__(self) -> str:
        return f"Event(time={self._values.get('time')}, code={self.code}, ...)"

    def __reduce__(self):
        return Event, (dict(self._values),)


class Events(Sequence):
    """A subject's events in order. Slices are tuples."""

    def __init__(self, subject_id: int, events: Sequence[Event]):
        self.subject_id, self._events = subject_id, tuple(events)

    def __len__(self) -> int:
        return len(self._events)

    def __getitem__(self, i):
        return self._events[i]

    def __iter__(self) -> Iterator[Event]:
        return iter(self._events)

    def __str__(self) -> str:
        return f"Events(subject_id={self.subject_id}, len(events)={len(self)})"


class Subject:
    """A subject's id and its events."""

    __slots__ = ("events", "subject_id")

    def __init__(self, subject_id: int, events: Sequence[Event]):
        self.subject_id, self.events = subject_id, Events(subject_id, events)

    def __str__(self) -> str:
        return f"Subject(subject_id={self.subject_id}, len(events)={len(self.events)})"


class MutableEvent:
    """An event that can be changed. Unknown properties read as None."""

    def __init__(self, time: datetime.datetime | None, code: str, properties: Mapping[str, Any] = {}):  # noqa: B006
        object.__setattr__(self, "properties", dict(properties) | {"time": time, "code": code})

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__") or name == "properties":
            raise AttributeError(name)
        return self.properties.get(name)

    def __setattr__(self, name: str, value: Any) -> None:
        self.properties[name] = value

    def __delattr__(self, name: str) -> None:
        if self.properties.pop(name, self) is self:
            raise AttributeError(name)

    def __iter__(self) -> Iterator[tuple[str, Any]]:
        return iter(self.properties.items())

    def __eq__(self, other: object) -> bool:
        return isinstance(other, MutableEvent) and self.properties == other.properties

    __hash__ = None

    def __repr__(self) -> str:
        return f"MutableEvent(time={self.time!r}, code={self.code!r}, properties={self.properties!r})"


class MutableSubject:
    """A subject whose id and events can be changed."""

    def __init__(self, subject_id: int, events: Sequence[MutableEvent] = ()):
        self.subject_id, self.events = subject_id, list(events)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, MutableSubject) and (self.subject_id, self.events) == (other.subject_id, other.events)

    __hash__ = None

    def __repr__(self) -> str:
        return f"MutableSubject(subject_id={self.subject_id!r}, events={self.events!r})"


def subject_from_rows(subject_id: int, rows: Sequence[Mapping[str, Any]]) -> MutableSubject:
    return MutableSubject(subject_id, [MutableEvent(r.get("time"), r.get("code"), {k: v for k, v in r.items() if k != "subject_id"}) for r in rows])


def rows_from_subject(subject: MutableSubject, columns: Sequence[str]) -> list[dict[str, Any]]:
    """Rows with the given columns: unknown properties are dropped, absent ones are null, the id is the subject's."""
    return [{c: subject.subject_id if c == "subject_id" else e.properties.get(c) for c in columns} for e in subject.events]
