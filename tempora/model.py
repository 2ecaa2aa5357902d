"""The data model: bitemporal vertex and edge histories as DataFrames, with declared property columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, types as T

OPEN = (1 << 63) - 1
#: The default instant of valid time: inside every interval that is still open.
LATEST = OPEN - 1

HISTORY = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("version", T.LongType(), False),
    T.StructField("valid_from", T.LongType()),
    T.StructField("valid_to", T.LongType()),
    T.StructField("tx_time", T.LongType(), False),
    T.StructField("tombstone", T.BooleanType(), False),
    T.StructField("log_index", T.LongType(), False),
    T.StructField("ordinal", T.LongType(), False),
])
VERTEX_FIELDS = ("labels",)
EDGE_FIELDS = ("src", "dst", "edge_type")
SYSTEM = tuple(f.name for f in HISTORY)

_TYPES = {"boolean": T.BooleanType(), "integer": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType()}


@dataclass(frozen=True)
class PropertySpec:
    """A declared property. type: boolean, integer, float, string, bytes, list<...> or map<...>."""

    name: str
    type: str
    required: bool = False

    def spark_type(self) -> T.DataType:
        if self.type in _TYPES:
            return _TYPES[self.type]
        if self.type.startswith("list<"):
            return T.ArrayType(PropertySpec("", self.type[5:-1]).spark_type())
        if self.type.startswith("map<"):
            return T.MapType(T.StringType(), PropertySpec("", self.type[4:-1]).spark_type())
        raise ValueError(f"unknown property type {self.type!r}")


@dataclass
class Graph:
    """Histories of vertices and edges. Columns: SYSTEM, labels or EDGE_FIELDS, and the declared properties.

    All puts of an edge between two of its deletes have the same ends, so filters on ends go below version resolution. fixed_types and
    fixed_labels say the same of edges' types and vertices' labels.
    """

    vertices: DataFrame
    edges: DataFrame
    vertex_properties: list[PropertySpec] = field(default_factory=list)
    edge_properties: list[PropertySpec] = field(default_factory=list)
    max_log_index: int | None = None
    fixed_types: bool = False
    fixed_labels: bool = False

    def schema_of(self, kind: str) -> T.StructType:
        extra = [T.StructField("labels", T.ArrayType(T.StringType()))] if kind == "vertex" else [T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("edge_type", T.StringType())]
        return T.StructType([*HISTORY.fields, *extra, *(T.StructField(p.name, p.spark_type()) for p in self.properties(kind))])

    def properties(self, kind: str) -> list[PropertySpec]:
        return self.vertex_properties if kind == "vertex" else self.edge_properties

    def history(self, kind: str) -> DataFrame:
        return self.vertices if kind == "vertex" else self.edges
