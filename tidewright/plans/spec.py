"""Dataset specs: a YAML text or dict, checked and turned into plain objects. Unknown fields are errors."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from ..errors import SpecError
from ..functions.calendar import PARTS
from ..functions.seasonality import to_date

TYPES = ("int", "float", "string", "bool", "date", "datetime", "uuid")
KINDS = ("one_to_many", "many_to_one", "one_to_one")
_FACTOR = {"base", "trend", "yearly", "monthly", "weekly", "daily", "holidays", "events", "noise", "anchor"}
_INNER = {
    "trend": {"kind", "annual_growth"}, "yearly": {"amplitude", "phase_days", "peaks"}, "monthly": {"shape", "strength", "weights_by_day"},
    "daily": {"hour_weights"}, "holidays": {"country", "subdiv", "dates", "strength", "window_days"}, "noise": {"kind", "sigma"},
}


@dataclass
class Reference:
    """child.column takes its values from parent.parent_column."""

    child: str
    column: str
    parent: str
    parent_column: str
    kind: str = "many_to_one"
    inherit: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Column:
    name: str
    type: str = "string"
    primary_key: bool = False
    values: dict[Any, float] | None = None
    mean: float | None = None
    std: float | None = None
    min: float | None = None
    max: float | None = None
    start: dt.date | None = None
    end: dt.date | None = None
    null_ratio: float = 0.0
    format: str | None = None
    expr: str | None = None
    after: dict | None = None
    null_unless: str | None = None
    values_by: dict | None = None
    seasonal_scale: dict | None = None
    calendar: dict | None = None


@dataclass
class Table:
    name: str
    columns: list[Column]
    rows: int | None = None
    seasonality: dict | None = None

    def column(self, name: str) -> Column:
        found = next((c for c in self.columns if c.name == name), None)
        if found is None:
            raise SpecError(f"table {self.name!r} has no column {name!r}")
        return found


@dataclass
class Dataset:
    tables: list[Table]
    references: list[Reference]
    version: int = 1

    def table(self, name: str) -> Table:
        found = next((t for t in self.tables if t.name == name), None)
        if found is None:
            raise SpecError(f"no table {name!r}")
        return found


def _known(where: str, got: dict, allowed: set[str]) -> dict:
    if not isinstance(got, dict):
        raise SpecError(f"{where} must be a mapping")
    extra = set(got) - allowed
    if extra:
        raise SpecError(f"{where}: unknown field {sorted(map(str, extra))[0]!r}")
    return got


def _parted(where: str, text: str) -> tuple[str, str]:
    if str(text).count(".") != 1:
        raise SpecError(f"{where}: {text!r} must be table.column")
    a, b = str(text).split(".")
    return a.strip(), b.strip()


def factor(where: str, got: dict) -> dict:
    """A seasonality factor, checked."""
    _known(where, got, _FACTOR)
    for k, allowed in _INNER.items():
        if got.get(k) is not None:
            _known(f"{where}.{k}", got[k], allowed)
    if got.get("daily") and len(got["daily"].get("hour_weights", ())) != 24:
        raise SpecError(f"{where}.daily: hour_weights must have 24 values")
    for e in got.get("events") or ():
        _known(f"{where}.events", e, {"name", "start", "end", "multiplier"})
        if to_date(e["end"]) < to_date(e["start"]):
            raise SpecError(f"{where}.events: {e.get('name')!r} ends before it starts")
    for p in (got.get("yearly") or {}).get("peaks") or ():
        _known(f"{where}.yearly.peaks", p, {"month", "day", "strength", "width_days"})
    return {k: v for k, v in got.items() if v is not None}


def _column(table: str, got: dict) -> tuple[Column, Reference | None]:
    where = f"{table}.{got.get('name')}"
    names = {f for f in Column.__dataclass_fields__} | {"references", "inherit"}
    got = dict(_known(where, got, names))
    if not got.get("name"):
        raise SpecError(f"a column of {table!r} has no name")
    if got.get("type", "string") not in TYPES:
        raise SpecError(f"{where}: unknown type {got['type']!r}")
    if not 0 <= float(got.get("null_ratio", 0)) <= 0.95:
        raise SpecError(f"{where}: null_ratio must lie in 0..0.95")
    target, inherit = got.pop("references", None), got.pop("inherit", None)
    reference = None
    if target is not None:
        parent, parent_column = _parted(f"{where}.references", target)
        reference = Reference(table, got["name"], parent, parent_column)
    if inherit is not None:
        if " as " not in inherit:
            raise SpecError(f'{where}: inherit must be "parent_column as local_name"')
        if reference is None:
            raise SpecError(f"{where}: inherit needs references")
        a, b = inherit.split(" as ", 1)
        reference.inherit.append((a.strip(), b.strip()))
    if isinstance(got.get("values"), list):
        got["values"] = dict.fromkeys(got["values"], 1.0)
    for k in ("start", "end"):
        if got.get(k) is not None:
            got[k] = to_date(got[k])
    if got.get("after") is not None:
        after = _known(f"{where}.after", got["after"], {"column", "min_minutes", "max_minutes"})
        got["after"] = {"min_minutes": 1, "max_minutes": 1440} | after
    if got.get("values_by") is not None:
        _known(f"{where}.values_by", got["values_by"], {"column", "mapping"})
    if got.get("seasonal_scale") is not None:
        got["seasonal_scale"] = factor(f"{where}.seasonal_scale", got["seasonal_scale"])
    if got.get("calendar") is not None:
        cal = _known(f"{where}.calendar", got["calendar"], {"anchor", "parts", "prefix", "fiscal_year_start_month", "hemisphere", "country"})
        if not cal.get("parts") or set(cal["parts"]) - set(PARTS):
            raise SpecError(f"{where}.calendar: parts must name calendar parts")
    return Column(**got), reference


def _in_table(table: str, join: dict) -> Reference:
    """A join inside a table: "{TABLE.a} = {other.b}"; the named table holds the key unless it is many_to_one."""
    _known(f"{table}.joins", join, {"name", "relationship", "sql"})
    kind = join.get("relationship", "many_to_one")
    if kind not in KINDS:
        raise SpecError(f"{table}.joins: unknown relationship {kind!r}")
    sides = re.findall(r"\{(\w+)(?:\.(\w+)\}|\}\.(\w+))", join["sql"])
    if len(sides) != 2:
        raise SpecError(f"{table}.joins: {join['sql']!r} must name two columns")
    own: dict[str, str] = {}
    for t, a, b in sides:
        own[table if t in ("TABLE", "CUBE") else t] = a or b
    other = join["name"]
    if set(own) != {table, other}:
        raise SpecError(f"{table}.joins: {join['sql']!r} must join {table!r} and {other!r}")
    if kind == "many_to_one":
        return Reference(table, own[table], other, own[other], kind)
    return Reference(other, own[other], table, own[table], "one_to_one" if kind == "one_to_one" else "many_to_one")


def _top_level(join: dict) -> Reference:
    _known("joins", join, {"left", "right", "relationship"})
    (lt, lc), (rt, rc) = _parted("joins.left", join["left"]), _parted("joins.right", join["right"])
    kind = join.get("relationship", "many_to_one")
    if kind not in KINDS:
        raise SpecError(f"joins: unknown relationship {kind!r}")
    return Reference(rt, rc, lt, lc) if kind == "one_to_many" else Reference(lt, lc, rt, rc, kind)


def load_spec(source: str | Path | dict) -> Dataset:
    """From a dict, a YAML text or the path of a YAML file."""
    if not isinstance(source, dict):
        import yaml

        text = str(source)
        if "\n" not in text and Path(text).suffix in (".yaml", ".yml", ".json"):
            text = Path(text).read_text()
        source = yaml.safe_load(text)
    _known("spec", source, {"version", "tables", "joins"})
    tables, references = [], []
    for got in source.get("tables") or ():
        _known(f"table {got.get('name')!r}", got, {"name", "columns", "joins", "rows", "seasonality"})
        if not got.get("columns"):
            raise SpecError(f"table {got.get('name')!r} needs a column")
        if got.get("rows") is not None and int(got["rows"]) < 1:
            raise SpecError(f"table {got['name']!r}: rows must be at least 1")
        pairs = [_column(got["name"], c) for c in got["columns"]]
        references += [r for _, r in pairs if r]
        references += [_in_table(got["name"], j) for j in got.get("joins") or ()]
        season = factor(f"{got['name']}.seasonality", got["seasonality"]) if got.get("seasonality") else None
        if season and season.get("anchor") not in {c.name for c, _ in pairs}:
            raise SpecError(f"{got['name']}.seasonality: anchor {season.get('anchor')!r} is not a column")
        tables.append(Table(got["name"], [c for c, _ in pairs], got.get("rows"), season))
    if not tables:
        raise SpecError("a spec needs a table")
    references += [_top_level(j) for j in source.get("joins") or ()]
    out = Dataset(tables, [], int(source.get("version", 1)))
    for r in references:
        out.table(r.child).column(r.column)
        out.table(r.parent).column(r.parent_column)
        same = next((x for x in out.references if (x.child, x.column) == (r.child, r.column)), None)
        if same is None:
            out.references.append(r)
        elif (same.parent, same.parent_column) == (r.parent, r.parent_column):
            same.kind = r.kind if r.kind == "one_to_one" else same.kind
            same.inherit += [x for x in r.inherit if x not in same.inherit]
        else:
            raise SpecError(f"{r.child}.{r.column} refers to two tables")
    return out
