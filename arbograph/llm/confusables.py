"""One form for texts that look the same: the skeleton of decomposed look-alike characters.

A text is freed of characters without width, decomposed, every character replaced by its prototype, and decomposed
again. Width variants, ligatures, letter-like signs, small capitals and blanks come from the Unicode data by rule;
letters of other scripts that have the shape of a Latin letter are the short table below.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbograph.llm.parse import spread
from arbograph.runtime import digest, split_join, stored

#: Fixed: letters and signs of the shape of the Latin letter, digit or ASCII sign under them, by script.
LOOK_ALIKES = [
    ("аеорсухіјѕԁԛԝһӏүгѡѵҽ", "aeopcyxijsdqwhlyrwve"),  # Cyrillic, small
    ("АВЕКМНОРСТУХЅІЈԚԜҮӀԌѴ", "ABEKMHOPCTYXSIJQWYIGV"),  # Cyrillic, capital
    ("Зб", "36"),  # Cyrillic, like digits
    ("οανιρυγσ", "oavipuyo"),  # Greek, small
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),  # Greek, capital
    ("\u03f2\u03f3\u03f9\u037f", "cjCJ"),  # Greek, variants
    ("օսհոցզ", "ouhngq"),  # Armenian
    ("\u0555\u054d\u054f\u053c", "OUSL"),  # Armenian, capital
    ("\u0251\u0261\u0269\u028b\u0131\u0237\u01c0", "agivijl"),  # Latin, phonetic and without dot
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),  # Cherokee
    ("ⲟⲞⲤⲥⲢⲣ", "oOCcPp"),  # Coptic
    ("\u2c82\u2c8e\u2c92\u2c94\u2c98\u2c9a\u2ca6\u2cac", "BHIKMNTX"),  # Coptic, capital
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFNLSRVHWXYAEIOU"),  # Lisu
    ("\u05e1\u0627\u0647\u0665", "oloo"),  # Hebrew and Arabic
    ("\u212e\u237a\u2373\u2374", "eaip"),
    ("‐‑‒–−", "-----"),
    ("‘’‛′\u02bc", "'''''"),
    ("\u201c\u201d\u201f\u2033", '""""'),
    ("⁄∕", "//"),
    ("∶꞉։", ":::"),
    ("‚․∗ǃ∼", ",.*!~"),
    ("\u2223\u05c0", "||"),
]
#: Fixed: Latin small capitals whose shape is that of the small letter.
SMALL_CAPITALS = "CIOSVWZ"
#: Fixed: scripts whose digit zero is a plain ring, of the shape of the letter o.
RING_ZEROS = ("DEVANAGARI", "GUJARATI", "GURMUKHI", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "THAI", "LAO", "MYANMAR")
#: Marks of general category Cf that are seen.
_SEEN = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
_KEPT_CONTROLS = {0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85}
#: Classes of compatibility variants that have their prototype's shape.
_SHAPES = ("<wide>", "<narrow>", "<font>", "<noBreak>")


def _is_widthless(c: int, category: str) -> bool:
    return category == "Cf" and c not in _SEEN or category == "Cc" and c not in _KEPT_CONTROLS or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or c in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)


@lru_cache(maxsize=1)
def tables() -> tuple[dict[int, None], dict[int, str]]:
    """Characters without width, and prototypes of decomposed characters."""
    gone: dict[int, None] = {}
    to: dict[int, str] = {}
    for c in range(0x80):
        if _is_widthless(c, unicodedata.category(chr(c))):
            gone[c] = None
    for c in range(0x80, sys.maxunicode + 1):
        ch = chr(c)
        category = unicodedata.category(ch)
        if category in ("Cn", "Co", "Cs"):
            continue
        if _is_widthless(c, category):
            gone[c] = None
        elif category == "Zs" and c != 0x1680 or c == 0x2800:
            to[c] = " "
        else:
            kind, _, rest = unicodedata.decomposition(ch).partition(" ")
            if kind in _SHAPES:
                to[c] = unicodedata.normalize("NFKD", ch)
            elif kind == "<compat>" and " " not in (text := unicodedata.normalize("NFKD", ch)) and (text.isalpha() or text.strip(".") == ""):
                to[c] = text
    to[0x09] = " "
    for letter in SMALL_CAPITALS:
        to[ord(unicodedata.lookup(f"LATIN LETTER SMALL CAPITAL {letter}"))] = letter.lower()
    for script in RING_ZEROS:
        to[ord(unicodedata.lookup(f"{script} DIGIT ZERO"))] = "o"
    for signs, shapes in LOOK_ALIKES:
        to |= dict(zip(map(ord, signs), shapes, strict=True))
    # A prototype may itself have one.
    return gone, {c: "".join(to.get(ord(x), x) for x in t) for c, t in to.items()}


def skeleton(text: str) -> str:
    """The form that texts which look the same share. Letter case, accents, line breaks and the number of blanks stay."""
    gone, to = tables()
    if text.isascii():
        return text.translate(gone).replace("\t", " ")
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text.translate(gone)).translate(to))


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([None if t is None else skeleton(t) for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text", "form"])


def forms(docs: DataFrame) -> DataFrame:
    """(doc_id, text, form) of docs(doc_id, text): the one form of each text; null for null, repeated rows each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return spread(rows).mapInArrow(_skeletons, "doc_id long, text string, form string")


def groups(docs: DataFrame) -> DataFrame:
    """(h, doc_id, t) of the documents of groups with equal forms and at least two different texts.

    h is the group, t the text, as 128-bit digests. Texts without a visible character are in none. Rows that are equal
    in doc_id and text are one.
    """
    f = forms(docs).filter("form IS NOT NULL").filter(F.col("form").rlike(r"\S"))
    rows = stored(f.select("doc_id", digest(F.col("form")).alias("h"), digest(F.col("text")).alias("t")), "forms")
    several = rows.groupBy("h").agg(F.min("t").alias("a"), F.max("t").alias("b")).filter("a != b").select("h")
    several = stored(several, "several")  # its size decides how it is joined
    return split_join(rows, several, "h", "left_semi").distinct()


def look_alikes(docs: DataFrame, block: int = 1000) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: the pairs of documents whose texts differ but look the same.

    Copies of one text are no pairs of each other, nor are they compared: the different texts of a group are paired, and
    each pair of texts is expanded to the documents that have them. Both steps go in blocks of `block` texts or
    documents, so that no task gets all of a large group or of a text with many copies. A doc_id that stands in several
    rows gives each pair once, and none with itself.
    """
    g = stored(groups(docs), "look-alikes")
    texts = stored(g.groupBy("h", "t").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "texts")
    sizes = stored(texts.groupBy("h").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")), "sizes")
    texts = split_join(texts, sizes, "h")
    part = lambda what, n: F.pmod(F.xxhash64(what), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = texts.select("h", F.col("t").alias("a"), F.col("blocks").alias("a_blocks"), part("t", F.col("parts")).alias("part"))
    right = texts.select("h", F.col("t").alias("b"), F.col("blocks").alias("b_blocks"), every(F.col("parts")).alias("part"))
    pairs = left.join(right, ["h", "part"]).filter("a < b").select("a", "b", "a_blocks", "b_blocks")
    # Several texts under one doc_id can give a pair twice; only such rows are made distinct.
    ids = g.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", F.lit(True).alias("again"))
    members = stored(g.join(texts.select("t", "blocks"), "t").join(ids, "doc_id", "left").select("t", "doc_id", part("doc_id", F.col("blocks")).alias("block"), F.coalesce("again", F.lit(False)).alias("again")), "members")
    side = lambda s: members.select(F.col("t").alias(s), F.col("doc_id").alias(f"{s}_id"), F.col("block"), F.col("again").alias(f"{s}_again"))
    half = pairs.withColumn("block", every(F.col("a_blocks"))).join(side("a"), ["a", "block"]).drop("block")
    full = half.withColumn("block", every(F.col("b_blocks"))).join(side("b"), ["b", "block"]).filter("a_id != b_id")
    full = full.select(F.least("a_id", "b_id").alias("doc_id_a"), F.greatest("a_id", "b_id").alias("doc_id_b"), (F.col("a_again") | F.col("b_again")).alias("again"))
    out = ["doc_id_a", "doc_id_b"]
    return full.filter("NOT again").select(*out).unionByName(full.filter("again").select(*out).distinct())


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_variants): each document of a look-alike group with the group's least doc_id and its number of different texts."""
    g = stored(groups(docs), "look-alikes")
    texts = g.groupBy("h", "t").agg(F.min("doc_id").alias("least"))
    heads = stored(texts.groupBy("h").agg(F.min("least").alias("class_id"), F.count("*").alias("n_variants")), "heads")
    return split_join(g, heads, "h").select("doc_id", "class_id", "n_variants")
