"""Binary asset packages: header, names, imports and exports, little-endian.

Table entries are read by the sizes that the summary's version implies for the layout
below: summary with counts and offsets, names as length-prefixed strings with a hash,
imports of four index pairs, exports that start with class, super and outer indexes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

# Fixed values of the format.
TAG, TAG_SWAPPED, MAX_DEPTH = 0x9E2A83C1, 0xC1832A9E, 32
ASSETS = "path string, parent string, imports array<string>, functions array<string>, error string"


class Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, form: str):
        size = struct.calcsize("<" + form)
        if self.at + size > len(self.data):
            raise ValueError("the package ends early")
        out = struct.unpack_from("<" + form, self.data, self.at)
        self.at += size
        return out[0] if len(out) == 1 else out

    def seek(self, at: int) -> None:
        if not 0 <= at <= len(self.data):
            raise ValueError("an offset lies outside the package")
        self.at = at

    def string(self) -> str:
        n = self.take("i")
        size = n if n >= 0 else -2 * n
        if self.at + size > len(self.data):
            raise ValueError("a string runs past the package")
        raw = self.data[self.at : self.at + size]
        self.at += size
        return raw.decode("latin-1" if n >= 0 else "utf-16-le", "replace").rstrip("\0")


@dataclass
class Package:
    names: list[str] = field(default_factory=list)
    imports: list[tuple[str, int, str]] = field(default_factory=list)  # class, outer, name
    exports: list[tuple[int, int, int, str]] = field(default_factory=list)  # class, super, outer, name

    def path(self, index: int, depth: int = 0) -> str:
        """Path of an import (negative) or export (positive): outers joined by /, . or :."""
        if not index or depth > MAX_DEPTH:
            return ""
        if index < 0:
            if -index > len(self.imports):
                return ""
            kind, outer, name = self.imports[-index - 1]
        else:
            if index > len(self.exports):
                return ""
            _, _, outer, name = self.exports[index - 1]
            kind = ""
        above = self.path(outer, depth + 1)
        if not above:
            return name
        return f"{above}{':' if kind == 'Function' else '/' if above.endswith('/') else '.'}{name}".replace("/.", "/")


def read_package(data: bytes) -> Package:
    r = Reader(data)
    if r.take("I") not in (TAG, TAG_SWAPPED):
        raise ValueError("not a package")
    name_count, name_at, import_count, import_at, export_count, export_at, export_size = r.take("7i")
    if min(name_count, import_count, export_count) < 0:
        raise ValueError("a count is negative")
    out = Package()
    r.seek(name_at)
    for _ in range(name_count):
        out.names.append(r.string())
        r.take("I")

    def name() -> str:
        index, number = r.take("2i")
        if not 0 <= index < len(out.names):
            raise ValueError("a name index is outside the names")
        return out.names[index] + (f"_{number - 1}" if number else "")

    r.seek(import_at)
    for _ in range(import_count):
        name()  # package of the class
        kind, outer, own = name(), r.take("i"), name()
        out.imports.append((kind, outer, own))
    for i in range(export_count):
        r.seek(export_at + i * export_size)
        kind, above, outer = r.take("3i")
        out.exports.append((kind, above, outer, name()))
    return out


def record(data: bytes) -> tuple[str | None, list[str], list[str]]:
    """(parent, imports, functions) of a package: the parent is the super of the first
    export that has one, else the class of the first export."""
    p = read_package(data)
    paths = [(kind, p.path(-i)) for i, (kind, _, _) in enumerate(p.imports, 1)]
    functions = sorted({x for kind, x in paths if kind == "Function"})
    others = sorted({x for kind, x in paths if kind != "Function"})
    supers = [e[1] for e in p.exports if e[1]] or [e[0] for e in p.exports if e[0]]
    return (p.path(supers[0]) if supers else None), others, functions


def read_packages(files: DataFrame) -> DataFrame:
    """files(path, content) as assets; a package that cannot be read has its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    parent, imports, functions = record(bytes(content))
                    rows.append((path, parent, imports, functions, None))
                except ValueError as e:
                    rows.append((path, None, [], [], str(e)))
            yield pd.DataFrame(rows, columns=["path", "parent", "imports", "functions", "error"])

    return files.select("path", "content").mapInPandas(run, ASSETS)
