"""Declared structure of a table. Small, frozen and driver-side only.

Every expression held here (defaults, checks, conversions) is written by the
job's author. Text that arrives in row data is never run as an expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class ForeignKeySpec:
    columns: tuple[str, ...]
    ref_table: str
    ref_columns: tuple[str, ...] = ()
    name: str = ""
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"

    @property
    def target_columns(self) -> tuple[str, ...]:
        """Referenced columns; a blank or missing one takes the local name."""
        if not self.ref_columns:
            return self.columns
        if len(self.ref_columns) != len(self.columns):
            raise ValueError(f"foreign key {self.name!r}: column counts differ")
        return tuple(r or c for r, c in zip(self.ref_columns, self.columns))


@dataclass(frozen=True)
class CheckSpec:
    name: str
    predicate: str


@dataclass(frozen=True)
class UniqueSpec:
    """A unique rule: over columns, or over an expression, optionally partial."""

    name: str
    columns: tuple[str, ...] = ()
    expressions: tuple[str, ...] = ()
    where: str | None = None


@dataclass(frozen=True)
class EnumSpec:
    name: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class DomainSpec:
    name: str
    base_type: str
    nullable: bool = True
    default: str | None = None
    checks: tuple[CheckSpec, ...] = ()


@dataclass(frozen=True)
class PartitionSpec:
    column: str
    parts: int


@dataclass(frozen=True)
class SequenceSpec:
    start: int = 1
    increment: int = 1
    minimum: int = 1
    maximum: int = 2**63 - 1
    cycle: bool = False


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    nullable: bool = True
    default: str | None = None
    check: str | None = None
    old_name: str | None = None
    using: str | None = None
    serial_start: int | None = None
    enum: EnumSpec | None = None
    domain: DomainSpec | None = None


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]
    primary_key: tuple[str, ...] = ()
    schema: str = "public"
    foreign_keys: tuple[ForeignKeySpec, ...] = ()
    uniques: tuple[UniqueSpec, ...] = ()
    checks: tuple[CheckSpec, ...] = ()
    old_name: str | None = None
    old_schema: str | None = None
    inherits: str | None = None
    partition: PartitionSpec | None = None
    options: dict[str, str] = field(default_factory=dict, compare=False)

    def column(self, name: str) -> ColumnSpec | None:
        """Column by case-insensitive name."""
        wanted = name.lower()
        return next((c for c in self.columns if c.name.lower() == wanted), None)

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    def with_columns(self, *columns: ColumnSpec) -> "TableSpec":
        return replace(self, columns=tuple(columns))
