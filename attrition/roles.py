"""Column roles passed to every operator so nothing hard-codes a column name."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Roles:
    key: str | tuple[str, ...]
    label: str | None = None
    numeric: tuple[str, ...] = ()
    nominal: tuple[str, ...] = ()
    binary: tuple[str, ...] = ()
    ignore: tuple[str, ...] = field(default_factory=tuple)

    @property
    def keys(self) -> tuple[str, ...]:
        return (self.key,) if isinstance(self.key, str) else tuple(self.key)

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(self.numeric) + tuple(self.binary) + tuple(self.nominal)

    def with_(self, **kw) -> "Roles":
        return replace(self, **kw)
