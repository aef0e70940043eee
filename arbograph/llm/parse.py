"""Source files against their languages: which parse, which are misnamed, which are damaged.

Every file is parsed against all supported grammars, in the order of a ranking by tokens: PHP, JavaScript and JSON by
the generalised LL recogniser, Python by the interpreter's own parser. A file that fails its own grammar but parses
as another has a wrong extension; one that fails all is corrupt.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbograph.llm import js
from arbograph.sources import php
from arbograph.sources.gll import END, Grammar

#: Fixed: the language of each extension.
LANGUAGES = {"php": "php", "py": "python", "js": "javascript", "mjs": "javascript", "json": "json"}

JSON = Grammar(
    """
    Start: Value END ;
    Value: STRING | NUMBER | WORD | '{' Members '}' | '[' Elements ']' ;
    Members: | Member MembersRest ;
    MembersRest: | ',' Member MembersRest ;
    Member: STRING ':' Value ;
    Elements: | Value ElementsRest ;
    ElementsRest: | ',' Value ElementsRest ;
    """,
    "Start",
)
_JSON = re.compile(r'[ \t\n\r]+|(?P<STRING>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<NUMBER>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(?P<WORD>true|false|null)|(?P<sign>[{}\[\],:])')


def _json_by_grammar(text: str) -> bool:
    kinds, at = [], 0
    while at < len(text):
        m = _JSON.match(text, at)
        if not m:
            return False
        if m.lastgroup:
            kinds.append(JSON.kinds[m[0] if m.lastgroup == "sign" else m.lastgroup])
        at = m.end()
    return JSON.run([*kinds, JSON.kinds[END]]).ok


def _no_constant(name: str) -> None:
    raise ValueError(name)


def is_json(text: str) -> bool:
    """One value of RFC 8259; NaN and the like are none, a byte order mark is no part of a value."""
    try:
        json.loads(text, parse_constant=_no_constant, parse_int=len, parse_float=len)
        return True
    except RecursionError:
        return _json_by_grammar(text)
    except ValueError:
        return False


def is_python(text: str) -> bool:
    """What this interpreter's parser takes."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text.encode("utf-8", "surrogatepass"))
            return True
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False


def is_javascript(text: str) -> bool:
    t = js.tokens(text)
    return not t.broken and js.JS.run(t.kinds, fresh=t.fresh).ok


def is_php(text: str) -> bool:
    t = php.tokens(text)
    return not t.broken and php.PHP.run(t.kinds).ok


PARSERS = {"php": is_php, "python": is_python, "javascript": is_javascript, "json": is_json}

#: Tokens that speak for a language; each counts once a hit.
_SIGNS = {
    "php": re.compile(r"<\?(?:php|=)|\$[A-Za-z_]\w*|->|::|\bnamespace\b|\bfunction\b"),
    "python": re.compile(r"(?m)^[ \t]*(?:def|class|if|for|while|with|try|elif|else)\b[^{;\n]*:[ \t]*(?:#.*)?$|^[ \t]*(?:from[ \t]+\S+[ \t]+)?import\b|\bself\b|\bNone\b"),
    "javascript": re.compile(r"\b(?:const|let|var|export|function|import)\b|=>|===|`"),
    "json": re.compile(r'"[^"\n]*"\s*:|\A\s*[\[{]'),
}


def ranked(text: str) -> list[str]:
    """The languages by the share of the text that their tokens make up, the likeliest first; at a tie by name."""
    score = {k: sum(len(m) for m in r.findall(text)) for k, r in _SIGNS.items()}
    if not re.search(r"<\?(?:php|=)", text):
        score["php"] = -1
    return sorted(score, key=lambda k: (-score[k], k))


def judge(text: str, extension: str | None) -> tuple[bool | None, str, str]:
    """Whether a content is valid in its extension's language (None if that isn't known), all languages it parses as in ranked order, and the verdict.

    The verdict is ok, wrong_extension, corrupt or unknown_extension. Text without a PHP tag is output to PHP and says
    nothing about it, so it counts as PHP only if its extension says so; an empty content is never a foreign parse.
    """
    own = LANGUAGES.get((extension or "").lower())
    found = []
    for language in ranked(text):
        if language == "php" and own != "php" and not re.search(r"<\?(?:=|php(?:[ \t\r\n]|\Z))", text, re.I):
            continue
        if language != own and not text.strip():
            continue
        if PARSERS[language](text):
            found.append(language)
    if own is None:
        return None, ",".join(found), "unknown_extension"
    return own in found, ",".join(found), "ok" if own in found else "wrong_extension" if found else "corrupt"


def extension(file: Column) -> Column:
    """The lower-case extension of a path's last part, empty if it has none."""
    return F.lower(F.regexp_extract(file, r"\.([^./\\]*)$", 1))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [judge(c, e) for c, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["file_id", "valid", "parses_as", "verdict"])


def verdicts(files: DataFrame) -> DataFrame:
    """(file_id, valid, parses_as, verdict) of files(file_id, file, content); see judge(). Null contents give no row; repeated rows are judged each."""
    rows = files.filter("content IS NOT NULL").select(F.col("file_id").cast("long").alias("file_id"), "content", extension(F.coalesce("file", F.lit(""))).alias("e"))
    return spread(rows).mapInArrow(_judged, "file_id long, valid boolean, parses_as string, verdict string")


def spread(rows: DataFrame) -> DataFrame:
    """rows in as many partitions as the tasks' work asks for, where a scan gives too few: parsing costs far more than reading."""
    spark = rows.sparkSession
    scanned = rows.rdd.getNumPartitions()
    wanted = spark.sparkContext.defaultParallelism * 4
    return rows if scanned >= wanted else rows.repartition(wanted)


def bad_files(files: DataFrame) -> DataFrame:
    """(file_id) of the contents that don't parse as what the extension says; other extensions are not judged."""
    return verdicts(files).filter("NOT valid").select("file_id")


def rates(files: DataFrame) -> DataFrame:
    """(repo, module, language, n_files, n_bad, n_wrong_extension, bad_rate) over the rows with content; null repos and modules are groups of their own."""
    v = verdicts(files)
    names = files.filter("content IS NOT NULL").select(F.col("file_id").cast("long").alias("file_id"), "repo", "module", "file").distinct()
    language = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[extension(F.coalesce("file", F.lit("")))]
    n_bad = F.count_if(~F.col("valid"))
    return v.join(names, "file_id").filter("valid IS NOT NULL").groupBy("repo", "module", language.alias("language")).agg(F.count("*").alias("n_files"), n_bad.alias("n_bad"), F.count_if(F.col("verdict") == "wrong_extension").alias("n_wrong_extension"), F.round(n_bad / F.count("*"), 4).alias("bad_rate"))
