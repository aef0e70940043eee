"""Tokenizing, mixing and look-alikes against brute force."""

import itertools
import random

import pytest

from arbograph.llm import confusables, mix, tokenize

DOCS = "doc_id long, text string, source string"
ODD = [None, "", " ", "\n\n  \t", "<|endoftext|> it's 12345 'll", "naïve 🔥🤷‍♂️ 你好 नमस्ते", "a" * 3000, "x y\t\tz \n" * 5000, "\u200b\ufeff"]


def test_ids(spark):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(ODD)] + [(0, None, "s")], DOCS).selectExpr("*", "1 AS ids")
    got = sorted((r.doc_id, r.ids) for r in tokenize.token_ids(df).collect())
    plain = tokenize.encoder().encode_ordinary
    assert got == sorted([(i, plain(t) if t else []) for i, t in enumerate(ODD)] + [(0, [])])
    assert all(r.same for r in tokenize.round_trip(df).collect())
    assert tokenize.token_ids(df.limit(0)).collect() == []
    counts = {r.doc_id: r.n_tokens for r in tokenize.token_counts(df).collect()}
    assert counts == {i: len(ids) for i, ids in got}


@pytest.mark.parametrize("before,after", [("", ""), ("ab", ""), ("", "ab"), ("ab ", "cd e"), ("1", "!"), ("x", "\x1c\x1cy")])
@pytest.mark.parametrize("blank", [" ", "\n", "\u3000", " \t"])
def test_long_runs_of_blanks(before, after, blank):
    plain = tokenize.encoder().encode_ordinary
    for n in (1, 2, 3, 9, 40):
        text = before + blank * n + after
        for long in (1, 2, 3, 8):
            assert "".join(tokenize.pieces(text, long)) == text
            assert tokenize.encode(text, long=long).tolist() == plain(text)
    # As long as the pattern's own engine bears it, the ids are the same.
    text = before + blank * (300_000 // len(blank)) + after
    assert tokenize.encode(text).tolist() == plain(text)


def test_separators_are_no_blanks_to_the_pattern():
    plain = tokenize.encoder().encode_ordinary
    for text in ("!!\x1c\x1d" * 20 + " a\x1f b", "a" * 9 + "\x1e\x85\x1f" * 9):
        for long in (1, 2, 5):
            assert tokenize.encode(text, long=long).tolist() == plain(text)


def test_millions_of_blanks(spark):
    blanks = " " * 3_000_000
    docs = [(1, blanks), (2, f"one {blanks}two"), (3, f"{blanks[:2_000_000]}\n"), (4, "one two")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert all(r.same for r in tokenize.round_trip(df).collect()) and tokenize.round_trip(df).count() == 4
    counts = {r.doc_id: r.n_tokens for r in tokenize.token_counts(df).collect()}
    got = {r.doc_id: r.ids for r in tokenize.token_ids(df).collect()}
    assert counts == {i: len(ids) for i, ids in got.items()}
    plain = tokenize.encoder().encode_ordinary
    # The last blank before the word goes with the word; the others are a piece of their own.
    assert got[2][0] == plain("one")[0] and got[2][-1] == plain(" two")[0] and got[4] == plain("one two")


@pytest.mark.parametrize("long", [1, 5, 50])
def test_pieces(long):
    plain = tokenize.encoder().encode_ordinary
    r = random.Random(long)
    for _ in range(300):
        text = "".join(r.choice(["a", "b1", " ", "  ", "\n", "\t", "'s", "é", "🔥", "!!", "\u3000", "don't"]) for _ in range(r.randrange(120)))
        assert "".join(tokenize.pieces(text, long)) == text
        assert tokenize.encode(text, long=long).tolist() == plain(text)


def test_fit_is_exact():
    r = random.Random(3)
    for _ in range(200):
        lengths = sorted(r.sample(range(1, 12), r.randrange(1, 5)))
        counts = [r.randrange(4) for _ in lengths]
        budget = r.randrange(60)
        taken, short = mix.fit(lengths, counts, budget)
        assert short == budget - sum(a * b for a, b in zip(lengths, taken, strict=True))
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        best = max(s for x in itertools.product(*[range(c + 1) for c in counts]) if (s := sum(a * b for a, b in zip(lengths, x, strict=True))) <= budget)
        assert sum(a * b for a, b in zip(lengths, taken, strict=True)) == best
        # A programme that starts small and is widened ends as near as the one over the whole budget.
        many, far = [c * 50 for c in counts], budget * 20
        size = lambda x: sum(a * b for a, b in zip(lengths, x, strict=True))  # noqa: B023, E731
        whole = size(mix.knapsack(lengths, many, min(far, size(many))))
        big, short = mix.fit(lengths, many, far, first=8)
        assert size(big) == far - short == whole and all(0 <= t <= c for t, c in zip(big, many, strict=True))


@pytest.mark.parametrize("lengths,counts", [([100, 250, 25001], [100, 100, 60]), ([21000, 33000, 50000], [40, 30, 60]), ([7], [3000]), ([3, 50_021], [9, 40])])
@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 0.77, 1.0])
def test_fit_of_long_documents(lengths, counts, share):
    size = lambda x: sum(a * b for a, b in zip(lengths, x, strict=True))
    budget = round(share * size(counts))
    exact = size(mix.knapsack(lengths, counts, budget))
    for first in (1, 1000, mix.FIRST):
        taken, short = mix.fit(lengths, counts, budget, first)
        assert size(taken) == exact == budget - short and all(0 <= t <= c for t, c in zip(taken, counts, strict=True))


def test_mixture(spark):
    r = random.Random(5)
    docs = [(i, r.choice([None, "", "word " * r.randrange(1, 9), "same text"]), r.choice(["a", "a", "a", "b", "c", "other", None])) for i in range(400)]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS uses")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 2), ("c", 0.1, 3), ("missing", 0.2, 4)], "source string, target_share double, max_repeats int")
    size = {i: len(tokenize.encode(t)) for i, t, _ in docs}
    total = sum(size[i] for i, _, s in docs if s in ("a", "b", "c"))
    got = mix.mixture(df, targets)
    rows = got.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix.mixture(df, targets).collect()))
    own = {s: sum(size[i] for i, _, x in docs if x == s) for s in "abc"}
    used = {s: sum(x.n_tokens * x.uses for x in rows if x.source == s) for s in "abc"}
    caps = {"a": 1, "b": 2, "c": 3}
    for s, share in (("a", 0.2), ("b", 0.5), ("c", 0.1)):
        want = min(round(share * total), caps[s] * own[s])
        # The budget is met as near as the exact knapsack over all documents of the source does.
        lengths = sorted({size[i] for i, _, x in docs if x == s and size[i]})
        counts = [sum(size[i] == n for i, _, x in docs if x == s) for n in lengths]
        passes = min(caps[s], want // own[s])
        rest = mix.knapsack(lengths, counts, want - passes * own[s]) if passes < caps[s] else [0] * len(lengths)
        assert used[s] == passes * own[s] + sum(a * b for a, b in zip(lengths, rest, strict=True)) <= want
        assert all(1 <= x.uses <= caps[s] for x in rows if x.source == s)
    assert {x.source for x in rows} == {"a", "b", "c"} and all(x.n_tokens == size[x.doc_id] > 0 for x in rows)
    shares = {x.source: x for x in mix.shares(got, targets).collect()}
    assert shares["missing"].n_tokens == 0 and abs(sum(x.actual_share for x in shares.values()) - 1) < 1e-9
    assert mix.mixture(df.limit(0), targets).collect() == [] and mix.mixture(df, targets.limit(0)).collect() == []
    assert {x.doc_id for x in mix.mixture(df, targets, seed=2).collect() if x.source == "a"} != {x.doc_id for x in rows if x.source == "a"}


SAME = [("Ｈｅｌｌｏ，１", "Hello,1"), ("сору", "copy"), ("ΑΒΕ ο", "ABE o"), ("e\u0301te\u0301", "été"), ("ﬁnal ﬂow oﬃce", "final flow office"), ("a\u00a0b\u2009c\u3000d\te", "a b c d e"), ("so\u00adft\u200b\ufeff\u200d", "soft"), ("\u212a", "K"), ("й", "и\u0306"), ("a\u0328\u200b\u0301", "a\u0301\u0328"), ("non‑break", "non-break"), ("e\u200b\u0301", "é")]
OTHER = [("a", "A"), ("e", "é"), ("a b", "a  b"), ("a\nb", "a b"), ("a\n", "a"), ("l", "1"), ("o", "0"), ("rn", "m"), ("и", "n"), ("a ", "a")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert confusables.skeleton(a) == confusables.skeleton(b) == confusables.skeleton(confusables.skeleton(a))


@pytest.mark.parametrize("a,b", OTHER)
def test_other(a, b):
    assert confusables.skeleton(a) != confusables.skeleton(b)


@pytest.mark.parametrize("signs,shapes", [("\u0555\u054d\u054f\u053c", "OUSL"), ("\u03f2\u03f3\u03f9\u037f", "cjCJ"), ("\u0251\u0261", "ag"), ("\u02bc", "'")])
def test_variants_and_capitals(signs, shapes):
    assert [confusables.skeleton(c) for c in signs] == list(shapes)


PROBES = {
    "g": "\u0261\uff47", "c": "\u03f2\u1d04с", "B": "\ua4d0Β", "O": "\ua4f3О", "o": "\u1d0f\u03c3\u05e1", "v": "\u1d20\u0475ν", "w": "\u1d21\u0461ԝ", "z": "\u1d22", "i": "\u0131і", "a": "\u0251а",
    "G": "\u050c\ua4d6", "l": "\u01c0\u0627ӏ", '"': "\u201c\u201d", "s": "\ua731ѕ", "3": "З", "אב": "\u2135\u2136",
}


@pytest.mark.parametrize("shape", PROBES)
def test_shapes_of_many_scripts(shape):
    if len(shape) == 1:
        assert {confusables.skeleton(c) for c in PROBES[shape]} == {shape}
    else:
        assert confusables.skeleton(PROBES[shape]) == shape


def test_copies_of_one_text_are_not_compared(spark):
    """30,000 copies and one variant give 30,000 pairs; a join of all with all would have 4.5e8 candidates."""
    n = 30_000
    df = spark.range(n).selectExpr("id AS doc_id", "'copy of it' AS text").unionByName(spark.createDataFrame([(n, "сору of it")], "doc_id long, text string"))
    got = confusables.look_alikes(df, block=100)
    assert got.count() == n and got.filter(f"doc_id_a < {n} AND doc_id_b = {n}").count() == n
    assert confusables.classes(df).filter("class_id = 0 AND n_variants = 2").count() == n + 1


def test_several_texts_of_one_id(spark):
    df = spark.createDataFrame([(1, "copy"), (1, "сopy"), (2, "coрy"), (2, "coрy"), (3, "copy")], "doc_id long, text string")
    assert sorted(map(tuple, confusables.look_alikes(df).collect())) == [(1, 2), (1, 3), (2, 3)]


def test_look_alikes(spark):
    r = random.Random(9)
    base = ["copy", "сору", "ｃｏｐｙ", "co\u200bpy", "other", "оther", "Copy", None, "", " ", "\u200b", "\u00a0", "stock answer"]
    docs = [(i, r.choice(base), "s") for i in range(150)]
    docs += docs[:10]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS form", "2 AS members")
    form = {t: confusables.skeleton(t) for t in base if t is not None}
    unique = sorted(set(docs))
    expected = sorted((a[0], b[0]) for a, b in itertools.combinations(unique, 2) if a[1] is not None and b[1] is not None and a[1] != b[1] and form[a[1]] == form[b[1]] and form[a[1]].strip())
    for block in (3, 1000):
        assert sorted(map(tuple, confusables.look_alikes(df, block).collect())) == expected
    members = {x.doc_id for x in confusables.classes(df).collect()}
    assert members == {x for p in expected for x in p}
    assert confusables.look_alikes(df.limit(0)).collect() == []
