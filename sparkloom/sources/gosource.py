"""A reader of Go source text: tokens, and from them declarations, calls and type references.

No type checker is at hand, so receivers of calls are inferred from what a function's text shows: its receiver,
its parameters, and variables set to composite literals. Each call says how it was resolved."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"\s*(?:(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')"
    r"|(?P<word>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<mark>:=|\.\.\.|<-|&&|\|\||[^\s\w])|\Z)",
    re.S,
)
# The language's keywords and predeclared types.
KEYWORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
BUILTIN_TYPES = set(
    "any bool byte comparable complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr".split()
)
# End of the fixed values.
_OPEN, _CLOSE = "([{", ")]}"
_NO_PACKAGE = BUILTIN_TYPES | {"map", "interface"}
_NAME = re.compile(r"(?:(\w+)\.)?([^\W\d]\w*)")


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    at: int
    line: int


@dataclass
class Source:
    package: str = ""
    imports: dict[str, str] = field(default_factory=dict)
    functions: list[dict] = field(default_factory=list)
    types: list[dict] = field(default_factory=list)


def tokens(text: str) -> tuple[list[Token], dict[int, list[tuple[int, str]]]]:
    """The tokens without space, and comments by the line on which they end."""
    out, comments, line, at = [], {}, 1, 0
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind is None:
            continue
        token, start = m[kind], m.start(kind)
        if start > at:
            line += text.count("\n", at, start)
        if kind == "comment":
            last = line + token.count("\n")
            comments.setdefault(last, []).append((line, token))
        else:
            out.append(Token(kind, token, start, line))
        at = start
    return out, comments


def _closing(ts: list[Token], i: int) -> int:
    """The place of the bracket that closes the one at i."""
    depth = 0
    for j in range(i, len(ts)):
        if ts[j].kind == "mark":
            depth += (ts[j].text in _OPEN) - (ts[j].text in _CLOSE)
            if not depth:
                return j
    return len(ts) - 1


def _doc(comments: dict, line: int) -> str:
    parts, at = [], line - 1
    while at in comments:
        start, text = comments[at][-1]
        parts.insert(0, text[2:].strip() if text.startswith("//") else text[2:-2].strip())
        at = start - 1
    return "\n".join(parts).strip()


def type_text(ts: list[Token]) -> str:
    """A type as signatures show it: arrays as slices, interfaces as interface{}, what is not a name, pointer,
    slice, map or variadic as any."""
    if not ts:
        return ""
    head = ts[0].text
    if head == "*" or head == "...":
        return head + type_text(ts[1:])
    if head == "[":
        return "[]" + type_text(ts[_closing(ts, 0) + 1 :])
    if head == "map" and len(ts) > 1:
        end = _closing(ts, 1)
        return f"map[{type_text(ts[2:end])}]{type_text(ts[end + 1 :])}"
    if head == "interface":
        return "interface{}"
    if ts[0].kind == "word" and head not in KEYWORDS:
        return f"{head}.{ts[2].text}" if len(ts) > 2 and ts[1].text == "." else head
    return "any"


def type_names(ts: list[Token]) -> list[str]:
    """Named types within a type, through pointers, slices, arrays, maps and channels: name or alias.name."""
    if not ts:
        return []
    head = ts[0].text
    if head in ("*", "...", "chan", "<-"):
        return type_names(ts[1:])
    if head == "[":
        return type_names(ts[_closing(ts, 0) + 1 :])
    if head == "map" and len(ts) > 1:
        end = _closing(ts, 1)
        return type_names(ts[2:end]) + type_names(ts[end + 1 :])
    if ts[0].kind == "word" and head not in KEYWORDS and head not in BUILTIN_TYPES:
        return [f"{head}.{ts[2].text}" if len(ts) > 2 and ts[1].text == "." else head]
    return []


def _split(ts: list[Token]) -> list[list[Token]]:
    out, depth = [[]], 0
    for t in ts:
        if t.kind == "mark":
            depth += (t.text in _OPEN) - (t.text in _CLOSE)
        if t.text == "," and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return [p for p in out if p]


def parameters(ts: list[Token]) -> list[tuple[list[str], list[Token]]]:
    """The names and type of each group of a parameter list (without its brackets)."""
    parts = _split(ts)
    named = any(len(p) > 1 and p[0].kind == "word" and p[0].text not in KEYWORDS and p[1].text not in (".", "[") or len(p) > 2 and p[0].kind == "word" and p[0].text not in KEYWORDS and p[1].text == "[" and p[2].text == "]" for p in parts)
    if not named:
        return [([], p) for p in parts]
    out, names = [], []
    for p in parts:
        names.append(p[0].text)
        if len(p) > 1:
            out.append((names, p[1:]))
            names = []
    return out


def _params_text(groups: list[tuple[list[str], list[Token]]]) -> str:
    return ", ".join(" ".join([*names, type_text(t)]) for names, t in groups)


def _results(ts: list[Token], i: int) -> tuple[list, int]:
    """The result groups that start at i, and where the body or the next declaration starts."""
    if i >= len(ts) or ts[i].text == "{":
        return [], i
    if ts[i].text == "(":
        end = _closing(ts, i)
        return parameters(ts[i + 1 : end]), end + 1
    j = i
    while j < len(ts) and ts[j].line == ts[i].line:
        if ts[j].text == "{" and not (j > i and ts[j - 1].text in ("interface", "struct")):
            break
        j = _closing(ts, j) + 1 if ts[j].text in _OPEN else j + 1
    return ([([], ts[i:j])] if j > i else []), j


def _canonical(ts: list[Token], src: Source, package: str) -> str:
    return _NAME.sub(
        lambda m: m.group() if m.group() in _NO_PACKAGE else f"{src.imports.get(m.group(1), m.group(1)) if m.group(1) else package}.{m.group(2)}",
        type_text(ts),
    )


def _shape(params: list, results: list, src: Source, package: str) -> str:
    """What two methods of one name must share: their types with whole package paths, without names."""
    flat = lambda groups: ",".join(_canonical(t, src, package) for names, t in groups for _ in names or [0])
    return f"({flat(params)})({flat(results)})"


def _calls(body: list[Token], src: Source, package: str, known: dict[str, str]) -> list[dict]:
    """Calls in a body, closures included: package and name of each target, and how it was found."""
    known, out = dict(known), []
    for i, t in enumerate(body):
        if t.text == ":=" and i and body[i - 1].kind == "word":
            j = i + 1 + (body[i + 1].text == "&" if i + 1 < len(body) else 0)
            names = type_names(body[j : j + 3])
            end = j + (3 if names and "." in names[0] else 1)
            if names and end < len(body) and body[end].text == "{":
                known[body[i - 1].text] = names[0]
    for i, t in enumerate(body[:-1]):
        if t.kind != "word" or t.text in KEYWORDS or body[i + 1].text != "(":
            continue
        if i and body[i - 1].text == "func":
            continue
        if i and body[i - 1].text == ".":
            base = body[i - 2].text if i > 1 and body[i - 2].kind == "word" and (i < 3 or body[i - 3].text != ".") else None
            if base in known:
                alias, _, _ = known[base].rpartition(".")
                out.append({"package": src.imports.get(alias, alias) if alias else package, "name": t.text, "resolution": "receiver"})
            elif base in src.imports:
                out.append({"package": src.imports[base], "name": t.text, "resolution": "import"})
            else:
                out.append({"package": package, "name": t.text, "resolution": "fallback"})
        else:
            out.append({"package": package, "name": t.text, "resolution": "ident"})
    return out


def parse(text: str, package: str | None = None) -> Source:
    """A file's package, imports, functions and types; package is the whole import path if it is known. Raises
    ValueError for a text without a package clause."""
    ts, comments = tokens(text)
    src = Source()
    if len(ts) < 2 or ts[0].text != "package":
        raise ValueError("no package clause")
    src.package = package or ts[1].text
    i = 2
    while i < len(ts):
        t = ts[i]
        if t.text == "import":
            group = ts[i + 1].text == "(" if i + 1 < len(ts) else False
            end = _closing(ts, i + 1) if group else next((j for j in range(i + 1, len(ts)) if ts[j].kind == "string"), len(ts) - 1)
            alias = None
            for x in ts[i + 1 : end + 1]:
                if x.kind == "string":
                    path = x.text.strip('"`')
                    src.imports[alias or path.rsplit("/", 1)[-1]] = path
                    alias = None
                elif x.kind == "word" or x.text in "._":
                    alias = x.text
            i = end + 1
        elif t.text == "func":
            i = _function(text, ts, comments, i, src)
        elif t.text == "type":
            if i + 1 < len(ts) and ts[i + 1].text == "(":
                end, j = _closing(ts, i + 1), i + 2
                while j < end:
                    j = _type(ts, comments, j, src, ts[j].line)
                i = end + 1
            else:
                i = _type(ts, comments, i + 1, src, t.line)
        else:
            i = _closing(ts, i) + 1 if t.text in _OPEN else i + 1
    return src


def _function(text: str, ts: list[Token], comments: dict, i: int, src: Source) -> int:
    start, receiver, known = ts[i], None, {}
    j = i + 1
    if ts[j].text == "(":
        end = _closing(ts, j)
        names, t = (parameters(ts[j + 1 : end]) or [([], [])])[0]
        receiver = type_text(t)
        known |= {n: receiver.lstrip("*") for n in names}
        j = end + 1
    if j >= len(ts) or ts[j].kind != "word":
        return i + 1
    name, j = ts[j].text, j + 1
    if j < len(ts) and ts[j].text == "[":
        j = _closing(ts, j) + 1
    end = _closing(ts, j)
    params = parameters(ts[j + 1 : end])
    results, j = _results(ts, end + 1)
    for names, t in params:
        found = type_names(t) if t and t[0].text not in ("[", "map", "...", "chan") else []
        known |= {n: found[0] for n in names if found}
    body, code_end = [], ts[max(i, j - 1)]
    if j < len(ts) and ts[j].text == "{":
        end = _closing(ts, j)
        body, code_end, j = ts[j + 1 : end + 1], ts[end], end + 1
    signature = f"func {name}({_params_text(params)})" + (f" ({_params_text(results)})" if results else "")
    refs = [("accepts", n) for _, t in params for n in type_names(t)] + [("returns", n) for _, t in results for n in type_names(t)]
    src.functions.append(
        {
            "name": name,
            "receiver": receiver,
            "line": start.line,
            "col": start.at - (text.rfind("\n", 0, start.at) + 1) + 1,
            "signature": signature,
            "shape": _shape(params, results, src, src.package),
            "docstring": _doc(comments, start.line),
            "code": text[start.at : code_end.at + len(code_end.text)],
            "calls": _calls(body, src, src.package, known),
            "references": [{"role": r, "package": src.imports.get(n.rpartition(".")[0], n.rpartition(".")[0]) if "." in n else src.package, "name": n.rpartition(".")[2]} for r, n in dict.fromkeys(refs)],
        }
    )
    return j


def _type(ts: list[Token], comments: dict, i: int, src: Source, line: int) -> int:
    name, j = ts[i].text, i + 1
    if j < len(ts) and ts[j].text == "[" and j + 2 < len(ts) and ts[j + 1].kind == "word" and ts[j + 2].text != "]":
        j = _closing(ts, j) + 1
    if j < len(ts) and ts[j].text == "=":
        j += 1
    kind = ts[j].text if j < len(ts) and ts[j].text in ("struct", "interface") else "type"
    row = {"name": name, "kind": kind, "line": line, "docstring": _doc(comments, line), "methods": [], "embeds": []}
    if kind == "type":
        k = j
        while k < len(ts) and ts[k].line == ts[j].line:
            k = _closing(ts, k) + 1 if ts[k].text in _OPEN else k + 1
        end = max(k, j + 1)
    else:
        end = _closing(ts, j + 1) + 1
        inner = ts[j + 2 : end - 1]
        lines: list[list[Token]] = []
        k = 0
        while k < len(inner):
            part = [inner[k]]
            while k + 1 < len(inner) and inner[k + 1].line == part[-1].line and inner[k + 1].text != ";":
                k += 1
                if inner[k].text in _OPEN:
                    close = _closing(inner, k)
                    part += inner[k : close + 1]
                    k = close
                else:
                    part.append(inner[k])
            lines.append(part)
            k += 1
        for part in lines:
            if kind == "interface" and len(part) > 1 and part[1].text == "(":
                close = _closing(part, 1)
                params, (results, _) = parameters(part[2:close]), _results(part, close + 1)
                row["methods"].append({"name": part[0].text, "signature": f"func {part[0].text}({_params_text(params)})" + (f" ({_params_text(results)})" if results else ""), "shape": _shape(params, results, src, src.package)})
            else:
                bare = [t for t in part if t.kind != "string"]
                found = type_names(bare)
                whole = len(bare) == (bare[0].text == "*" if bare else 0) + (3 if found and "." in found[0] else 1)
                if found and whole:
                    alias, _, base = found[0].rpartition(".")
                    row["embeds"].append(f"{src.imports.get(alias, alias) if alias else src.package}.{base}")
    src.types.append(row)
    return end
