"""URLs of gridded and tabular data requests: column and range constraints are pushed to the server.

Fixed values: the servers' file extensions, operator encodings and preference of formats.
"""

from __future__ import annotations

from dataclasses import dataclass, field

EXTENSIONS = {"parquet": ".parquet", "parquetWMeta": ".parquetWMeta", "csvp": ".csvp", "csv": ".csv", "jsonp": ".json"}
OPERATORS = {">=": "%3E=", "<=": "%3C=", ">": "%3E", "<": "%3C", "=": "=", "!=": "!=", "=~": "=~"}


def between(low: str | float, high: str | float, stride: int = 1) -> str:
    """One axis constraint with its brackets encoded."""
    return f"%5B({low}):{stride}:({high})%5D"


def noon(day: str) -> str:
    return f"{day[:10]}T12:00:00Z"


@dataclass(frozen=True)
class GridRequest:
    base: str
    dataset: str
    variable: str
    time: tuple[str, str]
    lat: tuple[float, float]
    lon: tuple[float, float]
    lat_descending: bool = True
    depth: float | None = None
    format: str = "parquet"
    callback: str = "erddapCb"

    def url(self) -> str:
        south, north = sorted(self.lat)
        west, east = sorted(self.lon)
        axes = [between(*self.time)]
        if self.depth is not None:
            axes.append(between(self.depth, self.depth))
        axes += [between(north, south) if self.lat_descending else between(south, north), between(west, east)]
        tail = f"&.jsonp={self.callback}" if self.format == "jsonp" else ""
        return f"{self.base.rstrip('/')}/griddap/{self.dataset}{EXTENSIONS[self.format]}?{self.variable}{''.join(axes)}{tail}"


def slice_url(request: GridRequest, at: str) -> str:
    """The same request for one time step."""
    from dataclasses import replace

    return replace(request, time=(at, at)).url()


def lobe_urls(request: GridRequest, boxes: list[tuple[float, float, float, float]]) -> list[str]:
    """One URL for each lobe's box (west, south, east, north)."""
    from dataclasses import replace

    return [replace(request, lon=(w, e), lat=(s, n)).url() for w, s, e, n in boxes]


@dataclass(frozen=True)
class TableRequest:
    base: str
    dataset: str
    columns: list[str]
    constraints: list[tuple[str, str, str | float]] = field(default_factory=list)
    functions: list[str] = field(default_factory=list)
    format: str = "parquetWMeta"
    callback: str = "erddapCb"

    def url(self) -> str:
        parts = ["%2C".join(self.columns), *[f"{c}{OPERATORS[op]}{v}" for c, op, v in self.constraints], *self.functions]
        tail = f"&.jsonp={self.callback}" if self.format == "jsonp" else ""
        return f"{self.base.rstrip('/')}/tabledap/{self.dataset}{EXTENSIONS[self.format]}?{'&'.join(parts)}{tail}"


def place_constraints(box: tuple[float, float, float, float], start: str, end: str, type_column: str | None = None, type_value: str | None = None) -> list[tuple[str, str, str | float]]:
    """A lobe's box and a window of days, and the row filter of a long table."""
    first = start if len(start) > 10 else f"{start}T00:00:00Z"
    last = end if len(end) > 10 else f"{end}T23:59:59Z"
    west, south, east, north = box
    out = [("time", ">=", first), ("time", "<=", last), ("longitude", ">=", west), ("longitude", "<=", east), ("latitude", ">=", south), ("latitude", "<=", north)]
    return out + [(type_column, "=", f"%22{type_value}%22")] if type_column and type_value else out


def pick_format(offered: list[str], cors: bool = True) -> str:
    """The best format that a server offers: columns before text; without CORS a script tag."""
    if not cors:
        return "jsonp"
    if not offered:
        return "parquet"
    return next((f for f in ("parquetWMeta", "parquet", "csvp") if f in offered), "csvp" if "csv" in offered else "jsonp")
