"""Includes, types, members and calls out of C++ text.

No grammar of the language is at hand, so this reads a regular subset: declarations are
found by a scan over text without comments and literals, with a brace stack for the
scopes.  Macro-generated code and declarations split by macros are not seen.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

SYMBOLS = "path string, kind string, name string, owner string, type string, access string, detail string, return_type string, base string, line long, end_line long"
# What a cleaned type drops, and what wraps another type.
TYPE_NOISE = ("virtual", "static", "inline", "const", "constexpr", "explicit", "friend", "mutable", "extern", "volatile", "typename", "FORCEINLINE")
WRAPPERS = ("TObjectPtr", "TWeakObjectPtr", "TSoftObjectPtr", "TSoftClassPtr", "TSubclassOf", "TSharedPtr", "TSharedRef", "TUniquePtr", "TWeakPtr")
_BLANK = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)
_TYPE = re.compile(r"(?:^|[;{}>)\n])\s*(?:template\s*<[^{};]*>\s*)?(class|struct|enum(?:\s+class)?)\s+(?:[A-Z0-9_]+_API\s+)?([A-Za-z_]\w*)\s*(?:final\s*)?(?::\s*([^{};]*))?\{")
_MACRO = re.compile(r"\b(UCLASS|USTRUCT|UENUM|UFUNCTION|UPROPERTY)\s*\(")
_FUNCTION = re.compile(r"([A-Za-z_][\w:<>,&*~\s]*?[\s&*>])?((?:\w+::)*~?[A-Za-z_]\w*)\s*(\([^(){};]*(?:\([^()]*\)[^(){};]*)*\))\s*((?:const|override|final|noexcept|\s)*)(?:=\s*(?:0|default|delete)\s*)?([;{])")
_FIELD = re.compile(r"^\s*([A-Za-z_][\w:<>,*&\s]*?[\s*&>])([A-Za-z_]\w*)\s*(?:=[^;]*|\{[^;]*\})?;", re.M)
_NOT_NAMES = frozenset("if for while switch return sizeof catch else do new delete case class struct enum using namespace public private protected operator template typedef".split())


def blank(text: str) -> str:
    """The text with comments and literals blanked out; positions and lines stay."""
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def clean_type(text: str) -> str:
    """A type without specifiers, references, pointers, namespaces and known wrappers."""
    words = [w for w in re.split(r"\s+", re.sub(r"\b\w+_API\b", " ", text).replace("*", " ").replace("&", " ")) if w and w not in TYPE_NOISE]
    out = " ".join(words)
    while m := re.fullmatch(rf"(?:{'|'.join(WRAPPERS)})\s*<(.*)>", out):
        out = clean_type(m[1])
    return out if "<" in out else out.split(" ")[-1].split("::")[-1] if out else ""


def split_top_level(text: str) -> list[str]:
    """Parts between commas outside any brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += c in "(<[{"
        depth -= c in ")>]}" and depth > 0
        if c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()] if text.strip() else []


def template_argument(text: str) -> str | None:
    """First template argument of a type or call, brackets balanced."""
    start = text.find("<")
    depth = 0
    for i in range(start, len(text)) if start >= 0 else ():
        depth += {"<": 1, ">": -1}.get(text[i], 0)
        if not depth:
            parts = split_top_level(text[start + 1 : i])
            return parts[0] if parts else None
    return None


def normalize_parameters(text: str) -> str:
    """A parameter list without default values, white space collapsed."""
    inner = text.strip()
    inner = inner[1:-1] if inner.startswith("(") and inner.endswith(")") else inner
    parts = []
    for part in split_top_level(inner):
        depth, end = 0, len(part)
        for i, c in enumerate(part):
            depth += c in "(<[{"
            depth -= c in ")>]}" and depth > 0
            if c == "=" and not depth:
                end = i
                break
        parts.append(" ".join(part[:end].split()))
    return "(" + ", ".join(parts) + ")"


@dataclass
class Scope:
    kind: str
    name: str
    access: str
    start: int
    end: int = 0
    bases: list[str] = field(default_factory=list)


class _Places:
    """Lines, brace depths and access labels of a text, found once and then looked up."""

    def __init__(self, plain: str) -> None:
        self.newlines = [m.start() for m in re.finditer("\n", plain)]
        self.braces, self.depths, self.ends = [], [], {}
        opened, depth = [], 0
        for m in re.finditer("[{}]", plain):
            if m[0] == "{":
                opened.append(m.start())
            elif opened:
                self.ends[opened.pop()] = m.start()
            depth += 1 if m[0] == "{" else -1
            self.braces.append(m.start())
            self.depths.append(depth)
        self.ends.update(dict.fromkeys(opened, len(plain) - 1))
        labels = list(re.finditer(r"\b(public|protected|private)\s*:(?!:)", plain))
        self.label_at, self.label = [m.start() for m in labels], [m[1] for m in labels]

    def line(self, i: int) -> int:
        return bisect.bisect_left(self.newlines, i) + 1

    def depth(self, i: int) -> int:
        """Brace depth before a place."""
        at = bisect.bisect_left(self.braces, i)
        return self.depths[at - 1] if at else 0

    def access(self, start: int, i: int) -> str | None:
        """The last label between two places."""
        at = bisect.bisect_left(self.label_at, i)
        return self.label[at - 1] if at and self.label_at[at - 1] >= start else None


def _scopes(plain: str, places: _Places) -> list[Scope]:
    """Types with a body, and where each body ends."""
    out = []
    for m in _TYPE.finditer(plain):
        at = places.ends.get(m.end() - 1, len(plain) - 1)
        kind = m[1].split()[0]
        bases = [re.sub(r"\b(public|protected|private|virtual)\b", "", b).split("<")[0].strip().split("::")[-1] for b in split_top_level(m[3] or "")]
        before = plain[max(0, m.start() - 400) : m.start(1)]
        macro = [x[1] for x in _MACRO.finditer(before) if not re.search(r"[;{}]", before[x.end() :])]
        out.append(Scope(macro[-1] if macro and macro[-1] in ("UCLASS", "USTRUCT", "UENUM") else kind, m[2], "public" if kind == "struct" else "private", m.end() - 1, at, bases if kind != "enum" else []))
    return out


def parse(text: str) -> list[tuple]:
    """Symbol rows of one text, without the path: kind, name, owner, type, access, detail,
    return_type, base, line, end_line (lines from 1)."""
    plain = blank(text)
    places = _Places(plain)
    line_of = places.line
    rows: list[tuple] = []
    for m in re.finditer(r'^[ \t]*#[ \t]*include[ \t]+["<]([^">\n]+)[">]', text, re.M):
        rows.append(("include", m[1], None, None, None, None, None, None, line_of(m.start()), None))
    scopes = _scopes(plain, places)
    for s in scopes:
        rows.append(("class", s.name, None, s.kind, None, None, None, ",".join(s.bases) or None, line_of(s.start), line_of(s.end)))
        if s.kind in ("enum", "UENUM"):
            for part in split_top_level(plain[s.start + 1 : s.end]):
                if name := re.match(r"\w+", part):
                    at = plain.index(name[0], s.start)
                    rows.append(("enum_value", name[0], s.name, "enum_item", None, None, None, None, line_of(at), None))
    types = [s for s in scopes if s.kind not in ("enum", "UENUM")]  # in order, bodies nested or apart
    starts, around, open_ = [s.start for s in types], [], []
    for n, s in enumerate(types):
        while open_ and types[open_[-1]].end < s.start:
            open_.pop()
        around.append(open_[-1] if open_ else -1)
        open_.append(n)

    def owner_of(i: int) -> Scope | None:
        n = bisect.bisect_left(starts, i) - 1
        while n >= 0 and types[n].end <= i:
            n = around[n]
        return types[n] if n >= 0 else None

    def depth_in(s: Scope, i: int) -> int:
        return places.depth(i) - places.depth(s.start)

    def access_at(s: Scope, i: int) -> str:
        return places.access(s.start, i) or s.access

    def flags(i: int, name: str) -> str:
        before = plain[max(0, i - 300) : i]
        return name if any(x[1] == name and not re.search(r"[;{}]", before[x.end() :]) for x in _MACRO.finditer(before)) else ""

    taken: list[tuple[int, int]] = []
    for m in _FUNCTION.finditer(plain):
        name, at = m[2], m.start(2)
        if name.split("::")[-1].lstrip("~") in _NOT_NAMES or name in ("UCLASS", "USTRUCT", "UENUM", "UFUNCTION", "UPROPERTY") or name.startswith("GENERATED_"):
            continue
        s = owner_of(at)
        out_of_class = "::" in name and s is None
        declared = s is not None and depth_in(s, at) == 1
        if not (out_of_class or declared) or (not (m[1] or "").strip() and not out_of_class and name.lstrip("~") != (s.name if s else "")):
            continue
        taken.append(m.span())
        owner, short = (name.rsplit("::", 1)[0].split("::")[-1], name.rsplit("::", 1)[1]) if out_of_class else (s.name, name)
        access = "impl" if out_of_class else access_at(s, at)
        returned = clean_type((m[1] or "").rpartition(")")[2]) or None
        rows.append(("member", short, owner, " ".join(filter(None, [flags(m.start(), "UFUNCTION"), "function"])), access, normalize_parameters(m[3]), returned, None, line_of(at), None))
    for s in types:
        for m in _FIELD.finditer(plain, s.start + 1, s.end):
            t = bisect.bisect_right(taken, (m.start(2), len(plain))) - 1
            if (t >= 0 and m.start(2) < taken[t][1]) or "(" in m[0].split("=")[0] or owner_of(m.start(2)) is not s or depth_in(s, m.start(2)) != 1:
                continue
            if m[1].split()[0] in _NOT_NAMES:
                continue
            rows.append(("member", m[2], s.name, " ".join(filter(None, [flags(m.start(), "UPROPERTY"), "property"])), access_at(s, m.start(2)), None, clean_type(m[1]) or None, None, line_of(m.start(2)), None))
    for m in re.finditer(r"(?<![\w:~])([A-Za-z_]\w*)\s*\(", plain):
        if m[1] not in _NOT_NAMES and not m[1].isupper():
            rows.append(("call", m[1], None, None, None, None, None, None, line_of(m.start()), None))
    return rows


def parse_sources(texts: DataFrame) -> DataFrame:
    """Symbol rows of texts(path, text), in one pass over batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SYMBOLS.split(", ")]
        for batch in batches:
            rows = [(p, *r) for p, t in zip(batch["path"], batch["text"], strict=True) for r in parse(t or "")]
            yield pd.DataFrame(rows, columns=names)

    return texts.select("path", "text").mapInPandas(run, SYMBOLS)


@dataclass(frozen=True)
class Declaration:
    name: str
    type: str
    line: int


def declarations(text: str) -> list[Declaration]:
    """Local declarations of a buffer, lines from 1, in order."""
    plain = blank(text)
    found = re.finditer(r"(?:^|[;{}(,])\s*((?:const\s+)?[A-Za-z_][\w:]*(?:\s*<[^;{}()]*>)?[\s*&]+)([A-Za-z_]\w*)\s*(?=[=;,){\[])", plain)
    out = [Declaration(m[2], clean_type(m[1]), plain.count("\n", 0, m.start(2)) + 1) for m in found]
    return [d for d in out if d.type and d.type not in _NOT_NAMES and d.name not in _NOT_NAMES]


def variable_type(text: str, name: str, line: int) -> Declaration | None:
    """The nearest declaration of a name at or before a line, else the first one."""
    named = [d for d in declarations(text) if d.name == name]
    before = [d for d in named if d.line <= line]
    return before[-1] if before else named[0] if named else None


def in_member_context(text: str) -> bool:
    """Whether the end of a text lies directly in a class, struct, enum or namespace."""
    plain, stack, start = blank(text), [], 0
    for i, c in enumerate(plain):
        if c == "{":
            stack.append(plain[start:i])
        elif c == "}" and stack:
            stack.pop()
        if c in "{};":
            start = i + 1
    return bool(stack) and bool(re.search(r"\b(class|struct|enum|namespace)\b", stack[-1]))


def include_line(text: str) -> int:
    """Line from 1 where a new include goes: after the last include but never after a
    generated header, else after the pragma, else the first."""
    lines = text.split("\n")
    includes = [(i, x) for i, x in enumerate(lines, 1) if re.match(r"\s*#\s*include", x)]
    generated = [i for i, x in includes if ".generated.h" in x]
    if includes:
        after = includes[-1][0] + 1
        return min([after, *generated])
    pragma = [i for i, x in enumerate(lines, 1) if x.strip() == "#pragma once"]
    return pragma[0] + 1 if pragma else 1


def generated_definitions(specifiers: str, name: str) -> list[str]:
    """Names whose definitions a reflected function needs, by its specifiers."""
    words = {w.strip() for w in re.split(r"[,()=]", specifiers)}
    if "BlueprintImplementableEvent" in words:
        return []
    remote = words & {"Server", "Client", "NetMulticast", "BlueprintNativeEvent"}
    out = [f"{name}_Implementation" if remote else name]
    return [*out, f"{name}_Validate"] if "WithValidation" in words else out


def _blocks(plain: str) -> list[tuple[int, int]]:
    """Start and end of every brace block; one that is still open ends with the text."""
    out, stack = [], []
    for m in re.finditer(r"[{}]", plain):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out.append((stack.pop(), m.end()))
    return out + [(i, len(plain) + 1) for i in stack]


def visible_declarations(text: str, line: int) -> list[Declaration]:
    """Declarations at or before a line whose block is still open there; a parameter
    belongs to the block that follows its list.  Of a name, the nearest one."""
    plain = blank(text)
    starts = [0, *(m.end() for m in re.finditer("\n", plain))]
    cursor = starts[line] - 1 if line < len(starts) else len(plain)
    blocks = _blocks(plain)
    found: dict[str, Declaration] = {}
    for d in declarations(text):
        if d.line > line:
            continue
        place = re.compile(rf"\b{re.escape(d.name)}\b").search(plain, starts[d.line - 1])
        at = place.start() if place else starts[d.line - 1]
        if plain.count("(", 0, at) > plain.count(")", 0, at) and (body := re.compile(r"[{;]").search(plain, at)) and body[0] == "{":
            at = body.end()
        if all(not a < at < b or b > cursor for a, b in blocks):
            found.pop(d.name, None)
            found[d.name] = d
    return list(found.values())


def incomplete_members(text: str) -> list[tuple[str, int]]:
    """(name, line from 1) of member functions that end without ';' or a body: at the end
    of the class, at an access label, or where the next declaration starts."""
    plain = blank(text)
    plain = re.sub(r"(?m)^[ \t]*#.*$", lambda m: " " * len(m[0]), plain)
    out = []
    ends = re.compile(
        r"\b(~?[A-Za-z_]\w*)[ \t]*\(([^(){};]*(?:\([^()]*\)[^(){};]*)*)\)(?:\s*\b(?:const|override|final|noexcept)\b)*[ \t]*"
        r"(?:(?=\})|\n\s*(?=\}|(?:public|protected|private)[ \t]*:|(?!const\b|override\b|final\b|noexcept\b)[A-Za-z_~]))"
    )
    calls = re.compile(r"\b[A-Z][A-Z0-9_]+\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)")
    for s in _scopes(plain, _Places(plain)):
        if s.kind in ("enum", "UENUM"):
            continue
        for m in ends.finditer(plain, s.start + 1, s.end + 1):
            before = plain[s.start : m.start(1)]
            statement = re.split(r"[;{}]|\b(?:public|protected|private)\s*:(?!:)", before)[-1]
            statement = calls.sub(" ", statement)
            named = statement.strip() or m[1].lstrip("~") == s.name  # a macro call stands alone
            if before.count("{") - before.count("}") == 1 and m[1] not in _NOT_NAMES and "=" not in statement and named:
                out.append((m[1], plain.count("\n", 0, m.start(1)) + 1))
    return sorted(set(out), key=lambda x: x[1])


def _opening(text: str, end: int) -> int:
    """Where the bracket that closes at `end` (inclusive) opens; -1 if it does not."""
    pairs = {")": "(", "]": "[", ">": "<"}
    close, depth = text[end], 0
    for i in range(end, -1, -1):
        depth += (text[i] == close) - (text[i] == pairs[close])
        if not depth:
            return i
    return -1


def receiver(before: str) -> str | None:
    """The expression in front of a trailing '.', '->' or '::'; None without one."""
    tail = re.search(r"(?:\.|->|::)\s*$", before)
    at = tail.start() if tail else 0
    end = at
    while at > 0:
        i = len(before[:at].rstrip()) - 1
        if i < 0:
            break
        while i >= 0 and before[i] in ")]>" and before[i - 1 : i + 1] != "->":
            i = _opening(before, i) - 1
            i = len(before[: i + 1].rstrip()) - 1 if i >= 0 else i
        word = re.search(r"[A-Za-z_]\w*$", before[: i + 1])
        at = word.start() if word else i + 1
        step = re.search(r"(?:\.|->|::)\s*$", before[:at])
        if not step:
            break
        at = step.start()
    return before[at:end].strip() or None if tail else None


@dataclass(frozen=True)
class Hop:
    name: str
    argument: str | None
    called: bool
    subscripts: int


def hops(expression: str) -> list[Hop]:
    """The steps of a chained expression, outer parentheses removed: name, first template
    argument, whether it is called, and subscripts after it."""
    text, out, i = expression.strip().lstrip("*&! "), [], 0
    if text.startswith("(") and (close := next((j for j, c in enumerate(text) if c == ")" and _opening(text, j) == 0), -1)) > 0:
        out, i = hops(text[1:close]), close + 1
    while i < len(text):
        step = re.compile(r"\s*(?:(?:\.|->|::)\s*)?([A-Za-z_]\w*)\s*").match(text, i)
        if step:
            name, argument, called, subscripts, i = step[1], None, False, 0, step.end()
        elif out and re.compile(r"\s*\[").match(text, i):
            last = out.pop()
            name, argument, called, subscripts = last.name, last.argument, last.called, last.subscripts
        else:
            break
        while i < len(text) and text[i] in "<([":
            close = next((j for j in range(i, len(text)) if text[j] == {"<": ">", "(": ")", "[": "]"}[text[i]] and text[j - 1 : j + 1] != "->" and _opening(text, j) == i), -1)
            if close < 0:
                return out
            if text[i] == "<":
                argument = template_argument(text[i : close + 1])
            called |= text[i] == "("
            subscripts += text[i] == "["
            i = close + 1
        out.append(Hop(name, argument, called, subscripts))
    return out


def element_type(kind: str) -> str:
    """What a container holds: the value of a map, the element of an array or a set."""
    outer = re.match(r"\s*(TArray|TSet|TMap)\s*<(.*)>", kind, re.S)
    if not outer:
        return clean_type(kind)
    parts = split_top_level(outer[2])
    return clean_type(parts[-1] if outer[1] == "TMap" else parts[0]) if parts else ""


def assigned_text(text: str, name: str, line: int) -> str | None:
    """The last initialiser of, or assignment to, a name at or before a line."""
    head = "\n".join(text.split("\n")[:line])
    found = re.findall(rf"\b{re.escape(name)}\s*=(?!=)\s*([^;]+);", head)
    return found[-1].strip() if found else None


def open_macro(before: str) -> tuple[str, bool, str] | None:
    """The reflection macro whose argument list is open at the end of a text, whether
    that lies in its metadata, and the prefix typed there."""
    calls = list(re.finditer(r"\b(UPROPERTY|UFUNCTION|UCLASS|USTRUCT|UENUM|UPARAM|UMETA)\(", before))
    if not calls:
        return None
    inner = before[calls[-1].end() :]
    if inner.count(")") > inner.count("("):
        return None
    in_meta = bool(re.search(r"meta\s*[=(](?!.*meta)", inner, re.I | re.S)) and inner.count("(") > inner.count(")")
    return calls[-1][1], in_meta, re.search(r"\w*$", inner)[0]
