"""Filters, sorts and paging: requests as plain values, turned into columns on the driver."""
from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.sources.shared import written

#: Default relevance floor, deepest hit that paging reaches, and REST limits.
MIN_RELEVANCE, MAX_HITS, REST_LIMIT, REST_DEFAULT = 0.4, 10_000, 50, 20
#: The sorts that are offered, and facets whose attribute is not their own name.
SORTS = {"relevance": [], "stars": ["stars:desc"], "score": ["score_total:desc"], "momentum": ["momentum:desc"], "recent": ["pushed_at:desc"]}
ATTRIBUTES = {"install_methods": "install_methods.method"}
COMPARISON = re.compile(r"^\s*([\w.]+)\s*(>=|<=|!=|=|>|<)\s*(.+?)\s*$")
MEMBERSHIP = re.compile(r"^\s*([\w.]+)\s+IN\s+\[(.*)\]\s*$", re.IGNORECASE)


def everything(clauses: Sequence[Column]) -> Column:
    """All clauses hold; true for none."""
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


def where_equal(where: dict | None) -> Column:
    """Conjunction of equalities; a null value matches nulls."""
    return everything([F.col(k).eqNullSafe(F.lit(v)) for k, v in (where or {}).items()])


def _field(schema: T.StructType, path: str) -> tuple[T.DataType, bool]:
    """The type at a dotted path and whether it is many-valued."""
    kind: T.DataType = schema
    many = False
    for part in path.split("."):
        if isinstance(kind, T.ArrayType):
            kind, many = kind.elementType, True
        if not isinstance(kind, T.StructType) or part not in kind.names:
            raise ValueError(f"unknown attribute {path}")
        kind = kind[part].dataType
    return (kind.elementType, True) if isinstance(kind, T.ArrayType) else (kind, many)


def values_of(df: DataFrame, path: str) -> Column:
    """All values at a dotted path as an array, nulls dropped."""
    _, many = _field(df.schema, path)
    return F.coalesce(F.array_compact(F.col(path) if many else F.array(F.col(path))), F.array())


def any_of(df: DataFrame, path: str, values: Sequence) -> Column:
    """Whether any value at the path is one of the values. A scalar stays a plain IN, which parquet scans can use."""
    _, many = _field(df.schema, path)
    if not many:
        return F.coalesce(F.col(path).isin(list(values)), F.lit(False))
    return F.coalesce(F.exists(F.col(path), lambda x: x.isin(list(values))), F.lit(False))


def literal(text: str):
    """A quoted literal is always a string; others are booleans or numbers."""
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return re.sub(r"\\(.)", r"\1", text[1:-1])
    if text in ("true", "false"):
        return text == "true"
    try:
        return int(text) if re.fullmatch(r"-?\d+", text) else float(text)
    except ValueError:
        raise ValueError(f"unsupported literal {text}") from None


def clause(df: DataFrame, text: str, filterable: Sequence[str] | None = None) -> Column:
    """``attribute op literal`` or ``attribute IN [a, b]`` as a column; other clauses are refused."""
    if m := MEMBERSHIP.match(text):
        path, make = m[1], lambda p: any_of(df, p, [literal(x.strip()) for x in re.findall(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[^,\s]+", m[2])])
    elif m := COMPARISON.match(text):
        path, value, op = m[1], literal(m[3]), m[2]
        tests = {"=": lambda c: c == value, "!=": lambda c: c != value, ">=": lambda c: c >= value, "<=": lambda c: c <= value, ">": lambda c: c > value, "<": lambda c: c < value}

        def make(p):
            _, many = _field(df.schema, p)
            test = F.exists(F.col(p), tests[op]) if many else tests[op](F.col(p))
            return F.coalesce(test, F.lit(False))
    else:
        raise ValueError(f"unsupported clause {text}")
    if filterable is not None and path not in filterable:
        raise ValueError(f"{path} is not filterable")
    return make(path)


def build_filters(df: DataFrame, selection: dict[str, Sequence] | None = None, clauses: Sequence[str] = (), include_archived: bool = False, min_relevance: float | None = None, filterable: Sequence[str] | None = None) -> Column:
    """The conjunction of a facet selection (or inside, and across), further clauses and default visibility."""
    parts = [any_of(df, path, values) for path, values in (selection or {}).items() if values]
    parts += [clause(df, text, filterable) for text in clauses]
    if not include_archived:
        parts.append(~F.col("archived"))
    parts.append(F.col("k8s_relevance") >= (MIN_RELEVANCE if min_relevance is None else min_relevance))
    return everything(parts)


def selection_from_params(params: dict[str, str | Sequence[str]], vocabulary: dict[str, Sequence[str]]) -> dict[str, list[str]]:
    """Facet selection from url parameters, comma-joined or repeated; values outside the vocabulary are dropped."""
    found = {}
    for family, known in vocabulary.items():
        raw = params.get(family, [])
        flat = [v.strip() for part in ([raw] if isinstance(raw, str) else raw) for v in part.split(",")]
        if kept := [v for v in dict.fromkeys(flat) if v in known]:
            found[family] = kept
    return found


def params_from_selection(selection: dict[str, Sequence[str]], params: dict[str, str]) -> dict[str, str]:
    """Url parameters for a selection; paging starts over."""
    rest = {k: v for k, v in params.items() if k not in selection and k != "page"}
    return rest | {k: ",".join(v) for k, v in selection.items() if v}


def toggle(selection: dict[str, list[str]], family: str, value: str) -> dict[str, list[str]]:
    now = selection.get(family, [])
    new = [v for v in now if v != value] if value in now else [*now, value]
    return {k: v for k, v in {**selection, family: new}.items() if v}


def order(spec: Sequence[str], sortable: Sequence[str] | None = None, tiebreak: str = "id") -> list[Column]:
    """Columns for ``field:asc`` or ``field`` (descending), missing values last either way, ties by ``tiebreak``."""
    found = []
    for text in spec:
        name, _, way = text.partition(":")
        if way not in ("", "asc", "desc") or not name:
            raise ValueError(f"bad sort {text}")
        if sortable is not None and name not in sortable:
            raise ValueError(f"{name} is not sortable")
        found.append(F.col(name).asc_nulls_last() if way == "asc" else F.col(name).desc_nulls_last())
    return [*found, F.col(tiebreak).asc()]


def is_sort_key(key: str | None) -> bool:
    return key in SORTS


def sort_spec(key: str | None = "relevance") -> list[str]:
    """The sort that a key stands for; unknown keys are refused."""
    if key not in SORTS:
        raise ValueError(f"unknown sort {key}")
    return list(SORTS[key])


def family_attribute(family: str) -> str:
    """The attribute that holds a family's values."""
    return ATTRIBUTES.get(family, family)


def default_facets(vocabulary) -> list[str]:
    """The attributes of all families with facets."""
    return [family_attribute(f.id) for f in vocabulary.families if f.facet]


def page(df: DataFrame, by: Sequence[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page in order: a top-k with offset, never a full sort. Hits past MAX_HITS are out of reach."""
    if number < 1:
        raise ValueError("pages count from 1")
    start = (number - 1) * size
    return df.orderBy(*by).offset(start).limit(max(0, min(size, MAX_HITS - start)))


def numbered(df: DataFrame, by: Sequence[Column], name: str = "place") -> DataFrame:
    """All rows with their place in the order, from 1.

    Rows are dealt by ranges and numbered in each; only the ranges' counts, one row for each partition, meet
    in one task. Rows that are equal in the order have any of its places.
    """
    rows = written(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    out = rows.join(F.broadcast(starts), "_range")  # as many rows as partitions
    return out.withColumn(name, F.col("_start") + inside).drop("_range", "_start")


def totals(df: DataFrame, size: int = 20) -> DataFrame:
    """(total_hits, total_pages), hits counted up to MAX_HITS."""
    hits = F.least(F.count(F.lit(1)), F.lit(MAX_HITS))
    return df.agg(hits.alias("total_hits"), (F.ceil(hits / size) if size else F.lit(0)).cast("long").alias("total_pages"))


def rest_paging(limit: int | None, number: int | None) -> tuple[int, int]:
    """Page size within 1..50 (20 if none is given) and page number within reach."""
    size = min(REST_LIMIT, max(1, REST_DEFAULT if limit is None else limit))
    return size, min(max(1, number or 1), math.floor(MAX_HITS / size))
