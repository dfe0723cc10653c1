"""Plain data model: view configuration and table specifications.

``ViewConfig.from_dict`` accepts the same JSON shape the original tool stores
(``from_tables``, ``joins``, ``columns``, ``computed_columns``, ``filters``,
``group_by``, ``aggregations``, ``order_by``, ``limit``), so saved configs can be
re-used unchanged.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

# ---------------------------------------------------------------------------
# View configuration
# ---------------------------------------------------------------------------


@dataclass
class ColumnSel:
    table: str | None
    column: str
    alias: str | None = None


@dataclass
class JoinSpec:
    left_table: str
    right_table: str
    left_key: str
    right_key: str
    join_type: str = "INNER"
    right_alias: str | None = None


@dataclass
class FilterSpec:
    column: str
    operator: str = "eq"
    value: Any = None
    date_start: str | None = None
    date_end: str | None = None


@dataclass
class AggSpec:
    function: str
    column: str
    alias: str | None = None


@dataclass
class Operand:
    type: str                      # "column" | "constant"
    table: str | None = None
    column: str | None = None
    value: str | None = None


@dataclass
class ComputedSpec:
    alias: str
    expression_type: str           # arithmetic | datetime_shift | datetime_trunc
    operands: list[Operand] = field(default_factory=list)
    operators: list[str] = field(default_factory=list)
    base_column: Operand | None = None
    shift_value: str | None = None
    shift_unit: str | None = None  # days | months | years
    trunc_column: Operand | None = None
    trunc_unit: str | None = None  # year quarter month week day hour minute


@dataclass
class OrderSpec:
    column: str
    direction: str = "asc"


@dataclass
class ViewConfig:
    from_tables: list[str]
    joins: list[JoinSpec] = field(default_factory=list)
    columns: list[ColumnSel] = field(default_factory=list)
    computed_columns: list[ComputedSpec] = field(default_factory=list)
    selected_computed_columns: list[str] = field(default_factory=list)
    filters: list[FilterSpec] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    aggregations: list[AggSpec] = field(default_factory=list)
    order_by: list[OrderSpec] = field(default_factory=list)
    limit: int | None = None

    @classmethod
    def from_dict(cls, d: dict) -> "ViewConfig":
        def operand(x):
            return None if x is None else (x if isinstance(x, Operand) else Operand(**x))

        def computed(c):
            if isinstance(c, ComputedSpec):
                return c
            c = dict(c)
            c["operands"] = [operand(o) for o in c.get("operands", [])]
            c["base_column"] = operand(c.get("base_column"))
            c["trunc_column"] = operand(c.get("trunc_column"))
            return ComputedSpec(**c)

        def many(kind, xs):
            return [x if isinstance(x, kind) else kind(**x) for x in xs or []]

        return cls(
            from_tables=list(d["from_tables"]),
            joins=many(JoinSpec, d.get("joins")),
            columns=many(ColumnSel, d.get("columns")),
            computed_columns=[computed(c) for c in d.get("computed_columns", []) or []],
            selected_computed_columns=list(d.get("selected_computed_columns", []) or []),
            filters=many(FilterSpec, d.get("filters")),
            group_by=list(d.get("group_by", []) or []),
            aggregations=many(AggSpec, d.get("aggregations")),
            order_by=many(OrderSpec, d.get("order_by")),
            limit=d.get("limit"),
        )

    def to_dict(self) -> dict:
        return asdict(self)


# ---------------------------------------------------------------------------
# Table specification (schema manager side)
# ---------------------------------------------------------------------------

# The closed list of column type keys of the original schema
# manager, and the decimal shape its Numeric type uses.
COLUMN_TYPES = ("String", "Text", "Integer", "BigInteger", "Numeric", "Boolean",
                "DateTime", "Date", "JSON")
NUMERIC_PRECISION, NUMERIC_SCALE = 12, 2
DEFAULT_STRING_LENGTH = 255
MAX_STRING_LENGTH = 4000

# Bookkeeping columns that never hold business data; the first three are hidden
# from every output.
BOOKKEEPING_COLUMNS = ("id", "imported_at", "created_at", "content_hash")
HIDDEN_COLUMNS = ("id", "imported_at", "content_hash")


@dataclass
class ColumnSpec:
    name: str
    type: str = "String"
    length: int | None = None          # String(n)
    nullable: bool = True
    label: str | None = None           # display label / file header
    default: Any = None
    unique: bool = False
    primary_key: bool = False
    fk: tuple[str, str] | None = None  # (parent table, parent column)

    def spark_type(self) -> str:
        return spark_type_name(self.type)


@dataclass
class TableSpec:
    name: str
    columns: list[ColumnSpec]
    upsert_key: list[str] | None = None
    dedup: bool = True                 # keyless: content-hash dedup on insert
    label: str | None = None

    def column(self, name: str) -> ColumnSpec:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(name)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def key(self) -> list[str] | None:
        """Explicit upsert key, else a user primary key, else unique columns."""
        if self.upsert_key:
            return list(self.upsert_key)
        pk = [c.name for c in self.columns if c.primary_key]
        if pk:
            return pk
        uq = [c.name for c in self.columns if c.unique]
        return uq[:1] or None

    def struct_type(self):
        from pyspark.sql.types import StructField, StructType
        from pyspark.sql.types import _parse_datatype_string as parse
        fields = []
        for c in self.columns:
            md = {"label": c.label or c.name}
            if c.length:
                md["length"] = c.length
            fields.append(StructField(c.name, parse(c.spark_type()), c.nullable, md))
        return StructType(fields)


def spark_type_name(kind: str) -> str:
    return {
        "String": "string", "Text": "string", "JSON": "string",
        "Integer": "int", "BigInteger": "bigint",
        "Numeric": f"decimal({NUMERIC_PRECISION},{NUMERIC_SCALE})",
        "Boolean": "boolean", "DateTime": "timestamp_ntz", "Date": "date",
    }[kind]
