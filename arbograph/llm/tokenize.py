"""Token ids of whole texts by a public tokenizer (a tiktoken rank file), and back to text by their raw bytes."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbograph.llm.parse import spread

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed: the public splitting pattern of the byte-level vocabularies of 50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Between something and a blank the pattern always splits, so longer texts are cut there; the ids are the same.
LONG = 1 << 16
#: Fixed: what \s is in the pattern (White_Space of Unicode; Python's own has four more).
_BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SAFE = re.compile(rf"(?<={_BLANK.replace('[', '[^')})(?={_BLANK})")
_ALL_BLANK = re.compile(rf"{_BLANK}+")


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder(path: str = RANKS):
    """The tokenizer of a rank file, without special tokens; read once in each worker."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def _blank_run(long: int) -> re.Pattern:
    """A run of more than `long` blanks, tried at the first blank of a run only."""
    return re.compile(rf"{_BLANK}(?<!{_BLANK}{_BLANK}){_BLANK}{{{long},}}")


def pieces(text: str, long: int = LONG) -> Iterator[str]:
    """A text in pieces cut where the splitting pattern cuts anyway, of about `long` characters where it cuts often enough.

    Of a run of more than `long` blanks the pattern takes all but the last before something, or all at the end of the
    text: these are a piece of their own. A piece of blanks alone is one to the pattern too.
    """
    at = 0
    for run in _blank_run(long).finditer(text):
        yield from _between(text, at, run.start(), long)
        at = run.end() - (run.end() < len(text))
        yield text[run.start() : at]
    yield from _between(text, at, len(text), long)


def _between(text: str, at: int, end: int, long: int) -> Iterator[str]:
    while end - at > long:
        m = _SAFE.search(text, at + long, end)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    if at < end:
        yield text[at:end]


def encode(text: str | None, path: str = RANKS, long: int = LONG) -> np.ndarray:
    """The ids of a text; none for null and empty."""
    if not text:
        return np.zeros(0, np.int32)
    run, single = encoder(path).encode_ordinary, encoder(path)._encode_single_piece
    if len(text) <= long:
        return np.asarray(run(text), np.int32)
    # The regex engine of the tokenizer fails on a run of a million blanks; blanks alone don't need it.
    return np.asarray([i for p in pieces(text, long) for i in (single if _ALL_BLANK.fullmatch(p) else run)(p)], np.int32)


@lru_cache(maxsize=4)
def _bytes(path: str) -> dict[int, bytes]:
    return {i: b for b, i in _ranks(path).items()}


def decode(ids: list[int], path: str = RANKS) -> str:
    """The text of ids, by joining their raw bytes first: a character may be spread over several tokens."""
    table = _bytes(path)
    return b"".join(table[i] for i in ids).decode("utf-8")


def _encoded(path: str, count: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode(t.as_py(), path) for t in batch.column(1)]
            sizes = np.array([len(i) for i in ids], np.int64)
            if count:
                out = pa.array(sizes)
            else:
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["doc_id", "n_tokens" if count else "ids"])

    return run


def token_ids(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, ids) of docs(doc_id, text): an empty list for null and empty texts; repeated rows come out each; other columns aren't read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return spread(rows).mapInArrow(_encoded(path, False), "doc_id long, ids array<int>")


def token_counts(docs: DataFrame, path: str = RANKS, keep: tuple[str, ...] = (), spread_out: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ...keep), n_tokens as long as token_ids()'s lists. docs that are spread out already stay where they are."""
    struct = F.struct(F.col("doc_id").cast("long").alias("doc_id"), *keep)
    rows = docs.select(struct.alias("doc_id"), "text")
    kinds = rows.schema["doc_id"].dataType.simpleString()
    return (rows if spread_out else spread(rows)).mapInArrow(_encoded(path, True), f"doc_id {kinds}, n_tokens long").select("doc_id.*", "n_tokens")


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ok = [decode(encode(t, path).tolist(), path) == (t or "") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ok)], names=["doc_id", "same"])

    return run


def round_trip(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, same): whether the decoded ids are the text again, null being empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return spread(rows).mapInArrow(_round_trip(path), "doc_id long, same boolean")
