"""Facts of PHP files: what the extractors read. One row per fact, in the order of the file.

kind is class, attr, prop, rel (extends, implements, uses), import, new, dispatch, param, return. Names are resolved
by the namespace and the imports of their place. "The current class" of code is the last named one entered.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbograph.sources.php import PHP, K, Tokens, tokens
from arbograph.sources.spans import Nesting, between

SCHEMA = "file string, seq int, kind string, owner string, owner_kind string, name string, target string, args string, line int, end_line int, detail string"
_FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]
_ARROW = pa.schema([(n, pa.int32() if t == "int" else pa.string()) for n, t in (x.split() for x in SCHEMA.split(", "))])
#: Fixed: methods whose first new object counts as emitted.
DISPATCH = ("dispatch", "create", "emit")
#: Fixed: type names that are no classes.
BUILT_IN = frozenset("self static parent int float string bool array mixed void never null true false iterable object callable".split())
_CLASS_KINDS = {K["class"]: "class", K["interface"]: "interface", K["trait"]: "trait", K["enum"]: "enum"}
_NAMES = {K["NAME"], K["QNAME"]}


class _File:
    def __init__(self, text: str):
        self.text, self.t = text, tokens(text)
        self.result = PHP.run(self.t.kinds)
        self.ok = self.result.ok and not self.t.broken
        best: dict[tuple[str, int], int] = {}
        for n, a, b in self.result.spans:
            best[n, a] = max(b, best.get((n, a), 0))
        self.spans: dict[str, list[tuple[int, int]]] = {}
        for (n, a), b in sorted(best.items(), key=lambda x: x[0][1]):
            self.spans.setdefault(n, []).append((a, b))
        self.namespaces = self.spans.get("Namespace", [])
        self.imports: list[tuple[int, str, str]] = []  # (token, alias, name)
        self.names: dict[tuple[str, str], str] = {}  # of namespace and alias in small letters
        self._read_imports()
        self.lines = [m.end() for m in re.finditer(r"\r\n|\n|\r", text)]

    def word(self, i: int) -> str:
        return self.text[self.t.starts[i] : self.t.stops[i]]

    def line(self, i: int) -> int:
        return bisect_right(self.lines, self.t.starts[i]) + 1

    def namespace(self, i: int) -> str:
        for k in range(bisect_left(self.namespaces, (i + 1,)) - 1, -1, -1):
            a, b = self.namespaces[k]
            if self.t.kinds[b - 1] != K["}"] or i < b:
                return "" if self.t.kinds[a] == K["{"] else self.word(a)
        return ""

    def _read_imports(self) -> None:
        kinds = self.t.kinds
        for a, b in self.spans.get("UseItem", []):
            if kinds[a] in (K["function"], K["const"]) or a and kinds[a - 1] in (K["function"], K["const"]):
                continue
            name = self.word(a).lstrip("\\")
            if a + 1 < b and kinds[a + 1] == K["GROUP"]:
                for c, d in between(self.spans.get("GroupItem", []), a + 1, b):
                    if kinds[c] not in (K["function"], K["const"]):
                        self._import(c, d, f"{name}\\{self.word(c)}")
            else:
                self._import(a, b, name)

    def _import(self, a: int, b: int, name: str) -> None:
        alias = self.word(b - 1) if b - a >= 3 and self.t.kinds[b - 2] == K["as"] else name.rpartition("\\")[2]
        self.imports.append((a, alias, name))
        self.names.setdefault((self.namespace(a), alias.lower()), name)

    def resolve(self, name: str, i: int) -> str:
        """The full name of a class name at token i."""
        if name.startswith("\\"):
            return name[1:]
        ns = self.namespace(i)
        head, _, rest = name.partition("\\")
        if head.lower() == "namespace":
            return f"{ns}\\{rest}" if ns else rest
        if full := self.names.get((ns, head.lower())):
            return f"{full}\\{rest}" if rest else full
        return f"{ns}\\{name}" if ns else name

    # -- constants in attributes

    def value(self, i: int, end: int):
        """The constant at token i and the token after it; what is no constant is its text."""
        kinds = self.t.kinds
        if i >= end:
            return None, i
        k, word = kinds[i], self.word(i)
        after = kinds[i + 1] if i + 1 < end else None
        if k == K["STRING"] and after in (None, K[","], K["]"], K[")"], K["=>"]):
            body = word[1:-1]
            return (body.replace("\\'", "'").replace("\\\\", "\\") if word[0] == "'" else body.encode().decode("unicode_escape", "replace") if body.isascii() else body), i + 1
        if k == K["NUMBER"] and after in (None, K[","], K["]"], K[")"], K["=>"]):
            digits = word.replace("_", "")
            try:
                return int(digits, 0) if not re.search(r"[.eE]", digits) or digits[:2].lower() == "0x" else float(digits), i + 1
            except ValueError:
                return word, i + 1
        if k in _NAMES and word.lower() in ("true", "false", "null") and after != K["::"]:
            return {"true": True, "false": False, "null": None}[word.lower()], i + 1
        if k in _NAMES and after == K["::"] and i + 2 < end and self.word(i + 2).lower() == "class":
            return self.resolve(word, i), i + 3
        if k in _NAMES and after == K["::"] and i + 2 < end:
            return self.word(i + 2), i + 3
        if k == K["["]:
            out, keyed, j = [], {}, i + 1
            while j < end and kinds[j] != K["]"]:
                v, j = self.value(j, end)
                if j < end and kinds[j] == K["=>"]:
                    w, j = self.value(j + 1, end)
                    keyed[str(v)] = w
                else:
                    out.append(v)
                if j < end and kinds[j] == K[","]:
                    j += 1
            return (keyed if keyed else out), j + 1
        depth, j = 0, i
        while j < end and (depth or kinds[j] not in (K[","], K["]"], K[")"], K["=>"])):
            depth += (kinds[j] in (K["("], K["["], K["{"])) - (kinds[j] in (K[")"], K["]"], K["}"]))
            j += 1
        return self.text[self.t.starts[i] : self.t.stops[max(i, j - 1)]], max(j, i + 1)

    def arguments(self, a: int, b: int) -> dict:
        """The arguments of an attribute's span: names, and places as texts of numbers."""
        out: dict = {}
        i, place = a + 2, 0
        while i < b - 1:
            key = None
            if self.t.kinds[i] == K["LABEL"]:
                key, i = self.word(i), i + 2
            v, i = self.value(i, b - 1)
            if key is None:
                key, place = str(place), place + 1
            out[key] = v
            if i < b and self.t.kinds[i] == K[","]:
                i += 1
        return out

    def named_type(self, i: int, end: int) -> str | None:
        """The class of a type that is one name, with or without ?; else None."""
        if i < end and self.t.kinds[i] == K["?"]:
            i += 1
        if i < end and self.t.kinds[i] in _NAMES and (i + 1 >= end or self.t.kinds[i + 1] not in (K["|"], K["&"])):
            name = self.word(i)
            return None if name.lower() in BUILT_IN else self.resolve(name, i)
        return None


def facts(path: str, text: str) -> list[tuple]:
    """The facts of one file as rows of SCHEMA; of a file that does not parse one row of kind error."""
    f = _File(text)
    kinds = f.t.kinds
    rows: list[tuple] = []

    def add(kind, owner, owner_kind=None, name=None, target=None, args=None, a=None, b=None, detail=None):
        rows.append((path, len(rows), kind, owner, owner_kind, name, target, None if args is None else json.dumps(args, sort_keys=True, ensure_ascii=False), f.line(a) if a is not None else None, f.line(b) if b is not None else None, detail))

    if not f.ok:
        add("error", None, name="syntax", a=min(f.result.furthest, len(kinds) - 1))
        return rows
    classes: list[tuple[int, int, str, str]] = []  # (first token, end, name, kind)
    for a, b in f.spans.get("Class", []):
        k = next(i for i in range(a, b) if kinds[i] in _CLASS_KINDS)
        ns = f.namespace(a)
        fqcn = f"{ns}\\{f.word(k + 1)}" if ns else f.word(k + 1)
        kind = _CLASS_KINDS[kinds[k]]
        classes.append((a, b, fqcn, kind))
        add("class", fqcn, kind, name=f.word(k + 1), a=a, b=b - 1, detail=",".join(sorted({f.word(i).lower() for i in range(a, k)})))
        i, relation = k + 2, None
        while kinds[i] != K["{"]:
            if kinds[i] in (K["extends"], K["implements"]):
                relation = f.word(i).lower()
            elif relation and kinds[i] in _NAMES:
                add("rel", fqcn, kind, name=relation, target=f.resolve(f.word(i), i), a=i)
            i += 1
    by_ns: dict[str, list[str]] = {}
    for a, _, fqcn, _k in classes:
        by_ns.setdefault(f.namespace(a), []).append(fqcn)
    for at, alias, full in f.imports:
        add("import", None, name=alias, target=full, a=at, detail=f.namespace(at))

    around = Nesting(classes)  # the innermost class at a token

    def current(i: int):
        """The last named class entered before token i."""
        k = bisect_left(classes, (i,)) - 1
        return (classes[k][0], *classes[k][2:]) if k >= 0 else None

    hidden = Nesting([(a, b) for n in ("Closure", "AnonymousBody") for a, b in f.spans.get(n, [])])
    members = f.spans.get("MemberRest", [])
    properties = f.spans.get("Property", [])
    methods = f.spans.get("Method", [])
    for a, b in members:
        owner = around(a)
        if owner is None or hidden(a):
            continue
        if kinds[a] == K["use"]:
            for i in range(a + 1, b):
                if kinds[i] in (K["{"], K[";"]):
                    break
                if kinds[i] in _NAMES:
                    add("rel", owner[2], owner[3], name="uses", target=f.resolve(f.word(i), i), a=i)
        for c, d in between(properties, a + 1, b):
            i = a
            while kinds[i] not in _NAMES and kinds[i] not in (K["?"], K["VAR"]):
                i += 1
            add("prop", owner[2], owner[3], name=f.word(c)[1:], target=f.named_type(i, c), a=a, b=d - 1)
    member_end = dict(members)
    starts = sorted([(a, "class", n) for a, _, n, _k in classes] + [(a, "member", "") for a, _ in members] + [(a, "param", "") for a, _ in f.spans.get("ParamRest", [])] + [(a, "function", "") for a, _ in f.spans.get("Function", [])])
    ordinals: dict = {}
    for a, b in f.spans.get("Attribute", []):
        k = bisect_left(starts, (b,))
        if k == len(starts):
            continue
        s, kind, name = starts[k]
        owner = around(s)
        cls = name or (owner[2] if owner else None)
        if cls is None:
            continue
        prop = None
        if kind == "member":
            end = member_end[s]
            if hit := between(properties, s + 1, end):
                kind, prop = "property", f.word(hit[0][0])[1:]
            else:
                m = between(methods, s, end)
                kind, prop = ("method", f.word(m[0][0] + 1 + (kinds[m[0][0] + 1] == K["&"]))) if m else ("constant", None)
        key = (cls, kind, prop)
        ordinals[key] = ordinals.get(key, -1) + 1
        add("attr", cls, kind, name=f.resolve(f.word(a), a), target=prop, args=f.arguments(a, b), a=a, detail=str(ordinals[key]))
    for a, b in f.spans.get("New", []):
        owner = current(a)
        if owner and kinds[a + 1] in _NAMES and f.word(a + 1).lower() not in BUILT_IN:
            add("new", owner[1], owner[2], target=f.resolve(f.word(a + 1), a + 1), a=a)
    for i in range(5, len(kinds) - 3):
        # $this -> property -> method ( new X
        if kinds[i] == K["("] and kinds[i + 1] == K["new"] and kinds[i + 2] in _NAMES and f.word(i - 1) in DISPATCH and kinds[i - 2] == K["->"] and kinds[i - 4] == K["->"] and f.word(i - 5) == "$this":
            owner = current(i)
            if owner:
                add("dispatch", owner[1], owner[2], name=f.word(i - 1), target=f.resolve(f.word(i + 2), i + 2), a=i)
    for a, b in f.spans.get("ParamRest", []):
        owner = current(a)
        var = next((i for i in range(a, b) if kinds[i] == K["VAR"]), None)
        if owner is None or var is None:
            continue
        i = a
        while i < var and kinds[i] not in _NAMES and kinds[i] != K["?"]:
            i += 1
        if target := f.named_type(i, var):
            add("param", owner[1], owner[2], name=f.word(var)[1:], target=target, a=a)
    in_method, in_closure = Nesting(methods, True), Nesting(f.spans.get("Closure", []), True)
    for a, b in f.spans.get("Returns", []):
        owner = around(a)
        if owner and in_method(a) and not in_closure(a) and (target := f.named_type(a + 1, b)):
            add("return", owner[2], owner[3], target=target, a=a)
    return rows


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in facts(p, t)]
        yield pa.RecordBatch.from_pylist([dict(zip(_FIELDS, r, strict=True)) for r in rows], schema=_ARROW)


def file_facts(files: DataFrame) -> DataFrame:
    """SCHEMA's rows of files(file, content); null files and contents give none."""
    return files.filter("file IS NOT NULL AND content IS NOT NULL").select("file", F.col("content").cast("string").alias("content")).mapInArrow(_read, SCHEMA)


__all__ = ["DISPATCH", "SCHEMA", "Tokens", "facts", "file_facts"]
