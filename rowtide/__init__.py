"""rowtide: manage change in tables by comparing states, on Spark.

Sub-packages
------------
``functions``  Column -> Column helpers (cells, text, types)
``sources``    snapshots, declared row sets, change-set sinks
``operators``  diff, overlay, checks, evolution, partitioning, sequences,
               dependency graphs, catalog drift and assembly, grants, verification
``streaming``  the row-change operators over feeds
``plans``      test inputs and the registered queries
"""

from rowtide.spec import (
    CheckSpec,
    ColumnSpec,
    DomainSpec,
    EnumSpec,
    ForeignKeySpec,
    PartitionSpec,
    SequenceSpec,
    TableSpec,
    UniqueSpec,
)

__all__ = [
    "CheckSpec",
    "ColumnSpec",
    "DomainSpec",
    "EnumSpec",
    "ForeignKeySpec",
    "PartitionSpec",
    "SequenceSpec",
    "TableSpec",
    "UniqueSpec",
]
