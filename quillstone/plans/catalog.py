"""The catalog of the driver's tables."""

from __future__ import annotations

from quillstone.functions.codecs import codec
from quillstone.schema import Attribute, Catalog, Model, Relation

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _model(name: str, attrs: dict, relations: dict[str, Relation] | None = None, unique_together=()) -> Model:
    made = {n: Attribute(n, codec(kind, **{k: v for k, v in o.items() if k not in ("primary", "unique")}), o.get("primary", False), o.get("unique", False)) for n, (kind, o) in attrs.items()}
    return Model(name, made, relations or {}, unique_together=list(unique_together))


KEY = {"primary": True, "unique": True}


def catalog() -> Catalog:
    models = [
        _model("region", {"r_regionkey": ("Integer", KEY), "r_name": ("String", {})}),
        _model("nation", {"n_nationkey": ("Integer", KEY), "n_name": ("String", {"unique": True})}, {"n_regionkey": Relation("n_regionkey", "N-1", "region", "nations", 1)}),
        _model("customer", {"c_custkey": ("Integer", KEY), "c_name": ("String", {"max_length": 18}), "c_acctbal": ("Float", {"min": 0.0}), "c_mktsegment": ("Enum", {"choices": SEGMENTS})}, {"c_nationkey": Relation("c_nationkey", "N-1", "nation", "customers", 1)}),
        _model("supplier", {"s_suppkey": ("Integer", KEY), "s_name": ("String", {}), "s_acctbal": ("Float", {})}, {"s_nationkey": Relation("s_nationkey", "N-1", "nation", "suppliers", 1)}),
        _model("part", {"p_partkey": ("Integer", KEY), "p_name": ("String", {}), "p_brand": ("Regex", {"pattern": r"^Brand#\d+$"}), "p_type": ("String", {}), "p_size": ("PositiveInteger", {"max": 45}), "p_retailprice": ("PositiveFloat", {})}),
        _model("orders", {"o_orderkey": ("Integer", KEY), "o_orderstatus": ("Enum", {"choices": ["F", "O"]}), "o_totalprice": ("PositiveFloat", {"max": 400000.0}), "o_orderdate": ("DateTime", {}), "o_orderpriority": ("Enum", {"choices": PRIORITIES[:4]})}, {"o_custkey": Relation("o_custkey", "N-1", "customer", "orders", 1)}),
        _model("lineitem", {"l_linenumber": ("Integer", {}), "l_quantity": ("PositiveFloat", {}), "l_returnflag": ("Enum", {"choices": ["A", "N", "R"]})}, {"l_orderkey": Relation("l_orderkey", "N-1", "orders", "lines", 1)}, [("l_orderkey", "l_linenumber")]),
    ]
    return Catalog({m.name: m for m in models}, "driver")
