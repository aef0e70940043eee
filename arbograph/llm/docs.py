"""Functions and methods of PHP files with the doc comments worth having.

Valid functions come out of broken files too: what the recogniser completed before it failed stays, and it starts
again at each later `function` with a name. Descriptions are reduced to templates, counted by hash over the whole
corpus: what a text alone does not tell (does it only ask for documentation?) its repetition does, as a stub stands
above functions of many names and a real description does not.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbograph.llm.parse import extension, spread
from arbograph.runtime import digest, stored
from arbograph.sources.php import PHP, K, Tokens, tokens
from arbograph.sources.spans import Nesting

#: Fixed: words that say nothing about a function.
FILLERS = frozenset("the a an this of for to from".split())
#: Fixed: endings apart from which two words are the same.
ENDINGS = frozenset(["", "s", "es", "d", "ed", "ing", "er", "ers", "e", "y", "ies", "ied", "or", "ors", "ion", "ions", "ation"])
#: Words by which a description speaks of documentation, and not of what the function does.
STUB_CORE = re.compile(r"(?:php)?docs?|doc(?:block|string|comment)s?|(?:un)?document(?:s|ed|ing|ation)?|descri(?:be[sd]?|bing|ptions?)|comment(?:s|ed|ing)?|(?:un)?explain(?:s|ed|ing)?|explanations?|todo|fixme|tbd|tba|xxx|stubs?|blank|placeholders?|boilerplate")
#: Words that point at the comment itself, at what it lacks, or at a later time.
STUB_MARKS = frozenset(
    "this here above below yet still later soon please no not none nothing nobody noone without missing lacks lacking absent todo fixme tbd tba xxx pending needed needs need required follow follows unavailable undocumented unexplained uncommented forgotten auto autogenerated generated sometime someday somebody someone eventually goes wanted awaiting until incomplete unfinished omitted blank empty".split()
)
#: Other words that stubs are made of.
STUB_WORDS = STUB_MARKS | FILLERS | frozenset(
    "available provided given found exists exist fill filled in out write writes written add added adds enter insert put go come comes coming to there what which does do did done is are it its that should must will shall would could can has have had been be was were method methods function functions routine code class by automatically generate as my your our we you i me text summary short long some something anything on at and or with up proper properly so far until now note one only just more information info details detail about purpose left leave intentionally deliberately supply supplied give provide author authors developer maintainer someone who how why when where time but".split()
)
#: Undecided texts are stubs if they stand above functions of so many different names.
STUB_NAMES = 3
_NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+|[^\W\d_a-zA-Z]+")


@dataclass
class Found:
    fqcn: str
    doc: str | None
    start: int
    stop: int
    recovered: bool


_CLASS_WORDS = {K[w] for w in ("class", "interface", "trait", "enum")}


def _contexts(t: Tokens, text: str, spans: list[tuple[str, int, int]]):
    """Functions for the namespace and the class at a token, from the spans that were recognised."""
    kinds, starts, stops = t.kinds, t.starts, t.stops
    word = lambda i: text[starts[i] : stops[i]]
    namespaces = sorted((a, b) for n, a, b in spans if n == "Namespace")
    bodies = Nesting([(a, b, n) for n, a, b in spans if n in ("Class", "AnonymousBody")], True)

    def namespace(i: int) -> str:
        for k in range(bisect_left(namespaces, (i + 1,)) - 1, -1, -1):
            a, b = namespaces[k]
            if kinds[b - 1] != K["}"] or i < b:
                return "" if kinds[a] == K["{"] else word(a)
        return ""

    def owner(i: int) -> str | None:
        """The class around token i, empty in an anonymous one, None in none."""
        around = bodies(i)
        if not around:
            return None
        if around[2] == "AnonymousBody":
            return ""
        k = next(k for k in range(around[0], around[1]) if kinds[k] in _CLASS_WORDS)
        return word(k + 1)

    return namespace, owner


def functions(text: str) -> tuple[bool, list[Found]]:
    """Whether a PHP file parses, and its named functions and methods in their order (of a broken file those that are whole)."""
    t = tokens(text)
    got = PHP.run(t.kinds)
    ok = got.ok and not t.broken
    kinds, starts, stops = t.kinds, t.starts, t.stops
    spans = list(dict.fromkeys(got.spans))
    word = lambda i: text[starts[i] : stops[i]]
    namespace, owner = _contexts(t, text, spans)
    groups = {b: a for n, a, b in spans if n == "AttributeGroup"}
    members = Nesting([(a, b) for n, a, b in spans if n == "MemberRest"])
    places = [i for i, _ in t.docs]
    out: list[Found] = []

    def doc(lower: int, at: int) -> str | None:
        """The nearest doc comment from the attributes before `lower` on to `at`, none within an attribute."""
        inside = []
        while lower in groups:
            inside.append((groups[lower], lower))
            lower = groups[lower]
        for k in range(bisect_right(places, at) - 1, -1, -1):
            i, d = t.docs[k]
            if i < lower:
                break
            if not any(a < i < b for a, b in inside):
                return d
        return None

    heads = [] if ok else [i for i in range(len(kinds) - 1) if kinds[i] in _CLASS_WORDS and kinds[i + 1] == K["NAME"] and (not i or kinds[i - 1] not in (K["::"], K["new"]))]

    def class_before(at: int) -> str | None:
        """The class whose head is the last before token `at` of a broken file."""
        i = bisect_left(heads, at) - 1
        return word(heads[i] + 1) if i >= 0 else None

    def head(at: int) -> int:
        """The first modifier before a function that was found again."""
        mods = {K[w] for w in ("public", "protected", "private", "static", "abstract", "final")}
        while at and kinds[at - 1] in mods:
            at -= 1
        return at

    ends: dict[tuple[str, int], int] = {}
    for n, a, b in spans:
        if n in ("Function", "Method"):
            ends[n, a] = max(b, ends.get((n, a), 0))
    for (n, a), b in sorted(ends.items(), key=lambda x: x[0][1]):
        k = a + 1 + (kinds[a + 1] == K["&"])
        ns = namespace(a)
        if n == "Method":
            cls = owner(a)
            if cls is None and not ok:
                cls = class_before(a)
            if not cls:
                continue
            around = members(a)
            first = around[0] if around else head(a)
            name = f"{cls}::{word(k)}"
        else:
            first, name = a, word(k)
        out.append(Found(f"{ns}\\{name}" if ns else name, doc(first, a), starts[first], stops[b - 1], not ok))
    if not ok:
        at, whole = got.furthest, Nesting([(f.start, f.stop) for f in out])
        named = [i for i, k in enumerate(kinds) if k == K["namespace"]]
        while at < len(kinds) - 1:
            if kinds[at] == K["function"] and not whole(starts[at]):
                k = at + 1 + (kinds[at + 1] == K["&"])
                if k < len(kinds) and kinds[k] != K["("]:
                    more = PHP.run(kinds, at, "Method")
                    if more.ok:
                        cls = class_before(at)
                        i = bisect_right(named, at) - 1
                        ns = word(named[i] + 1) if i >= 0 else ""
                        name = f"{cls}::{word(k)}" if cls else word(k)
                        groups |= {b: a for n, a, b in more.spans if n == "AttributeGroup"}
                        out.append(Found(f"{ns}\\{name}" if ns else name, doc(head(at), at), starts[head(at)], stops[more.end - 1], True))
                        at = more.end
                        continue
            at += 1
    return ok, out


def description(doc: str) -> str:
    """The text before the first line starting with @, without comment marks, {@...} and HTML tags, on one line."""
    lines = []
    for line in re.split(r"\r\n|\r|\n", doc[3:-2]):
        line = line.strip().lstrip("*").strip()
        if line.startswith("@"):
            break
        lines.append(line)
    text = re.sub(r"\{@[^{}]*\}", " ", "\n".join(lines))
    return " ".join(re.sub(r"</?[A-Za-z][^<>]*>|<!--[\s\S]*?-->", " ", text).split())


def words(text: str) -> list[str]:
    """The words of a text: what stands between blanks and has a letter or digit, without signs around it."""
    return [w for w in (re.sub(r"^\W+|\W+$", "", x) for x in text.split()) if re.search(r"[^\W_]", w)]


def _same(a: str, b: str) -> bool:
    """Whether two words are the same apart from their endings."""
    if a == b:
        return True
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    if n < min(3, len(a), len(b)):
        return False
    ends = []
    for x in (a[n:], b[n:]):
        if n and x[:1] == a[n - 1] and x[1:] in ("ed", "ing", "er", "ers"):
            x = x[1:]
        ends.append(x)
    return all(x in ENDINGS for x in ends)


def name_words(name: str) -> list[str]:
    return [w.lower() for w in _NAME_WORD.findall(name)]


def is_trivial(text: str, name: str) -> bool | None:
    """True for fewer than four words, nothing but the words of the name, or a stub; None if only the corpus can tell a stub.

    A stub has a word of STUB_CORE that is none of the name's, consists of the words of stubs and has one that points at
    the comment itself. Undecided is what has no such word (`Add a comment to the class` may be what a function does), and
    what has one but up to half of other words.
    """
    own = words(text)
    if len(own) < 4:
        return True
    parts = [p.lower() for w in own for p in re.findall(r"[^\W_]+", w)]
    named = name_words(name)
    of_name = [any(_same(p, n) for n in named) for p in parts]
    if all(p in FILLERS or o for p, o in zip(parts, of_name, strict=True)):
        return True
    core = [bool(STUB_CORE.fullmatch(p)) for p in parts]
    if not any(c and not o for c, o in zip(core, of_name, strict=True)):
        return False
    known = sum(c or p in STUB_WORDS for c, p in zip(core, parts, strict=True))
    marked = any(p in STUB_MARKS for p in parts)
    if known == len(parts):
        return True if marked else None
    return None if marked and 2 * known >= len(parts) else False


def said(text: str) -> str:
    """A description with case and signs gone: equal for copies of one stub."""
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def template(text: str, name: str) -> str:
    """A description with the words of the name masked and case and signs gone: equal for copies that a template made."""
    named = name_words(name)
    return " ".join("_" if any(_same(p, n) for n in named) else p for p in (x.lower() for x in re.findall(r"[^\W_]+", text)))


_OUT = "file_id long, fqcn string, description string, code string, template string, said string, trivial boolean, recovered boolean"


def _extract(with_code: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, found = functions(text)
                for f in found:
                    if f.doc is not None:
                        name = re.split(r"::|\\", f.fqcn)[-1]
                        d = description(f.doc)
                        rows.append((file_id, f.fqcn, d, text[f.start : f.stop] if with_code else None, template(d, name), said(d), is_trivial(d, name), f.recovered))
            yield pa.RecordBatch.from_pylist([dict(zip(_FIELDS, r, strict=True)) for r in rows], schema=_SCHEMA)

    return run


_FIELDS = [x.split()[0] for x in _OUT.split(", ")]
_SCHEMA = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[k]) for n, k in (x.split() for x in _OUT.split(", "))])


def documented(files: DataFrame, with_code: bool = True) -> DataFrame:
    """(file_id, fqcn, description, code, template, said, trivial, recovered) of every function with a doc comment in the .php rows of files.

    Null contents, files without functions and functions without a doc comment give no row; repeated rows are read each.
    Methods of anonymous classes have no fqcn and give none. trivial is null where only the corpus can tell.
    """
    rows = files.filter("content IS NOT NULL").filter(extension(F.coalesce("file", F.lit(""))) == "php").select(F.col("file_id").cast("long").alias("file_id"), "content")
    return spread(rows).mapInArrow(_extract(with_code), _OUT)


def worth_having(rows: DataFrame, names: int = STUB_NAMES) -> DataFrame:
    """The rows(fqcn, said, trivial, ...) that are not trivial; undecided ones are dropped if their text repeats above functions of `names` different names.

    Texts are counted by hash over all rows, first each (text, name) once, so that a text with most rows is spread by
    the names; only undecided rows are shuffled.
    """
    open_ = rows.filter("trivial IS NULL").withColumn("h", digest(F.col("said")))
    name = F.lower(F.regexp_extract("fqcn", r"([^:\\\\]*)$", 1))
    often = open_.select("h", name.alias("name")).distinct().groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= names).select("h")
    return rows.filter("NOT trivial").unionByName(open_.join(often, "h", "left_anti").drop("h").select(*rows.columns))


def found(files: DataFrame) -> DataFrame:
    """(file_id, fqcn) of the functions of valid files whose description is not trivial."""
    rows = stored(documented(files, False).filter("NOT recovered AND trivial IS NOT TRUE").select("file_id", "fqcn", F.when(F.col("trivial").isNull(), F.col("said")).alias("said"), "trivial"), "documented")
    return worth_having(rows).select("file_id", "fqcn")


def pairs(files: DataFrame, share: float = 0.005) -> DataFrame:
    """(file_id, fqcn, code, description, recovered, n_template): code-description pairs, those of broken files too.

    Dropped are trivial descriptions, and those whose template (the words of the function's own name masked) repeats and
    makes up more than `share` of all described functions, counted by the template's hash over the whole corpus; one that
    stands once is kept however few they are. n_template is the number of functions with the pair's template.
    """
    rows = stored(documented(files).withColumn("t", digest(F.col("template"))).drop("template"), "pairs")
    # Hash counts are grouped with map-side sums; only templates over the share, at most 1 / share of them, are broadcast.
    counts = rows.groupBy("t").agg(F.count("*").alias("n_template"))
    total = rows.count()
    often = F.broadcast(counts.filter(F.col("n_template") > max(1, share * total)).select("t"))
    kept = worth_having(rows).join(often, "t", "left_anti")
    return kept.join(counts, "t").select("file_id", "fqcn", "code", "description", "recovered", "n_template")
