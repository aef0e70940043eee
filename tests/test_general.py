"""Problems 1, 2, 3 and 6 against brute force on small fixtures with nulls, ties, copies, hot keys, cycles and empty tables."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from arbograph.operators import hierarchy, ledger, orphans, skew

T0 = dt.datetime(2025, 1, 1)
EDGES = "edge_id long, source_id string, target_id string, type string, indexed_at timestamp_ntz"
NODES = "node_row long, id string, is_placeholder boolean, indexed_at timestamp_ntz, removed_at timestamp_ntz"
ITEMS = "item_id long, node_id string, packed_at timestamp_ntz"


def at(n):
    return None if n is None else T0 + dt.timedelta(hours=n)


def valid(x):
    return x is not None and x.strip() != ""


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def random_edges(seed, n=600):
    r = random.Random(seed)
    ids = [f"n{i}" for i in range(40)] + [None, "", " \t"]
    hot = lambda: "hot" if r.random() < 0.35 else r.choice(ids)
    out = [(i, hot(), hot(), r.choice(["extends", "calls", None]), at(r.choice([None, *range(9)]))) for i in range(n)]
    return out + out[:30]


@pytest.mark.parametrize("chunk,partitions", [(7, 5), (65536, 1), (1, 3), (64, 4)])
def test_degrees(spark, chunk, partitions):
    edges = random_edges(chunk)
    expected = []
    for side, a, b in (("source", 1, 2), ("target", 2, 1)):
        count, others = defaultdict(int), defaultdict(set)
        for e in edges:
            if valid(e[a]):
                count[e[a]] += 1
                if valid(e[b]):
                    others[e[a]].add(e[b])
        expected += [(side, k, n, len(others[k])) for k, n in count.items()]
    df = spark.createDataFrame(edges, EDGES).selectExpr("*", "source_id AS k1", "1 AS side", "2 AS n")
    assert rows(skew.key_degrees(df, chunk=chunk, partitions=partitions)) == sorted(expected)
    hot = sorted((s, k) for s, k, n, _ in expected if n * 100 >= 2 * len(edges))
    assert rows(skew.hot_keys(df, partitions=partitions)) == hot


def test_degrees_of_one_pair_and_of_nothing(spark):
    same = spark.createDataFrame([(i, "a", "b", "x", at(0)) for i in range(100)], EDGES)
    assert rows(skew.key_degrees(same, chunk=8, partitions=4)) == [("source", "a", 100, 1), ("target", "b", 100, 1)]
    none = spark.createDataFrame([], EDGES)
    assert rows(skew.key_degrees(none)) == [] and rows(skew.hot_keys(none)) == []


def test_chunks_are_of_equal_size(spark):
    edges = spark.createDataFrame([(i, "hot" if i % 3 else f"a{i}", f"b{i % 9}", "x", at(0)) for i in range(300)], EDGES).repartition(5)
    numbered, total = skew.numbered(skew.counted(skew.side_rows(edges)), 4)
    got = sorted((r["at"], r.n) for r in numbered.collect())
    assert total == 300 and [a for a, _ in got] == [sum(n for _, n in got[:i]) for i in range(len(got))] and sum(n for _, n in got) == 600
    for chunk in (1, 7, 64, 10_000):
        sizes = {r.chunk: r.n for r in skew.chunk_states(numbered, chunk, 3).groupBy("chunk").sum("n").withColumnRenamed("sum(n)", "n").collect()}
        last = max(sizes)
        assert sorted(sizes) == list(range(last + 1)) and all(n == chunk for c, n in sizes.items() if c < last) and sum(sizes.values()) == 600


@pytest.mark.parametrize("seed", range(2))
def test_orphans(spark, seed):
    r = random.Random(seed)
    ids = [f"n{i}" for i in range(25)]
    pick = lambda: "hot" if r.random() < 0.35 else r.choice(ids)
    hour = lambda: r.choice([None, *range(20)])
    nodes = [(i, pick(), r.choice([False, False, True, None]), at(hour()), at(hour())) for i in range(120)]
    nodes += nodes[:10] + [(999, None, False, at(0), None)]
    edges = [(i, pick(), r.choice([pick(), "gone", None, " "]), "calls", at(hour())) for i in range(300)]
    items = [(i, r.choice([pick(), "", "gone"]), at(hour())) for i in range(80)]

    def lives(ref, t):
        return any(n[1] == ref and n[2] is False and n[3] is not None and n[3] <= t and (n[4] is None or t < n[4]) for n in nodes)

    cases = [("graph_edges", e[0], e[2], e[4]) for e in edges] + [("context_items", i[0], i[1], i[2]) for i in items]
    expected = sorted((a, b) for a, b, ref, t in cases if valid(ref) and (t is None or not lives(ref, t)))
    half = len(nodes) // 2
    tables = [spark.createDataFrame(nodes[:half], NODES), spark.createDataFrame(nodes[half:], NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(items, ITEMS)]
    for partitions in (1, 7):
        assert rows(orphans.orphans(*tables, partitions=partitions).select("ref_table", "row_id")) == expected
    assert rows(orphans.cascade(*tables).filter("kind = 'direct'").select("ref_table", "row_id")) == expected


def test_cascade(spark):
    nodes = [(i, n, False, at(0), None) for i, n in enumerate(["a", "b", "c", "d"])]
    # a extends a missing class: a is broken; b extends a, so b's row and b are inherited orphans; c calls b.
    edges = [(1, "a", "gone", "extends", at(1)), (2, "b", "a", "extends", at(1)), (3, "c", "b", "calls", at(1)), (4, "d", "c", "extends", at(1)), (5, "a", "b", "extends", at(1))]
    tables = [spark.createDataFrame(nodes, NODES), spark.createDataFrame([], NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame([(7, "a", at(2)), (8, "d", None)], ITEMS)]
    found = orphans.cascade(*tables)
    assert rows(found.select("ref_table", "row_id", "kind", "round")) == [("context_items", 7, "inherited", 1), ("context_items", 8, "direct", 0), ("graph_edges", 1, "direct", 0), ("graph_edges", 2, "inherited", 1), ("graph_edges", 3, "inherited", 2), ("graph_edges", 5, "inherited", 2)]
    assert rows(orphans.orphan_report(found).filter("ref_table = 'context_items'").select("kind", "n")) == [("direct", 1), ("inherited", 1)]
    empty = [t.limit(0) for t in tables]
    assert rows(orphans.cascade(*empty)) == []


@pytest.mark.parametrize("seed", range(3))
def test_cascade_of_chains_cycles_and_several_parents(spark, seed):
    """Rounds against a search in breadth: long chains, endless chains, records with several parents, hot parents."""
    r = random.Random(seed)
    links = {(f"c{i}", f"c{i + 1}") for i in range(150)} | {(f"loop{i}", f"loop{(i + 1) % 5}") for i in range(5)} | {("tail", "loop0"), ("both", "loop1"), ("both", "c40")}
    links |= {(f"m{i}", r.choice(["c60", "hot", f"m{r.randrange(60)}"])) for i in range(60) for _ in range(r.choice([1, 1, 2, 3]))}
    broken = {"c149", "c90", f"m{r.randrange(60)}", "gone"} | ({"hot"} if seed else set())
    best = {b: 1 for b in broken}
    edge = set(broken)
    while edge:
        edge = {c for c, p in links if p in edge and c not in best and not best.update({c: best[p] + 1})}
    got = orphans.rounds(spark.createDataFrame(sorted(links), "id string, parent string"), spark.createDataFrame([(b,) for b in broken], "id string"))
    assert rows(got) == sorted(best.items())


def brute_tree(edges):
    best = {}
    for e in edges:
        if e[3] in ("extends", "extends_module") and valid(e[1]) and valid(e[2]):
            key = (e[4] is not None, e[4] or T0, e[0], e[2])
            if e[1] not in best or key > best[e[1]][0]:
                best[e[1]] = (key, e[2])
    parent = {k: v[1] for k, v in best.items()}
    out = {}
    for n in parent:
        path = [n]
        while path[-1] in parent and parent[path[-1]] not in path:
            path.append(parent[path[-1]])
        if path[-1] in parent:
            loop = path[path.index(parent[path[-1]]) :]
            out[n] = (min(loop), -1, None)
        else:
            out[n] = (path[-1], len(path) - 1, path[::-1])
    return parent, out


@pytest.mark.parametrize("split", [3, 1_000_003])
def test_hierarchy(spark, split):
    r = random.Random(split)
    chain = [(i, f"c{i}", f"c{i + 1}", "extends", at(i)) for i in range(37)]
    loop = [(100 + i, f"l{i}", f"l{(i + 1) % 9}", "extends_module", at(1)) for i in range(9)]
    tail = [(200, "t0", "t1", "extends", at(1)), (201, "t1", "l4", "extends", at(1)), (202, "self", "self", "extends", at(1)), (203, "s2", "self", "extends", None)]
    more = [(300 + i, f"r{r.randrange(60)}", r.choice([f"r{r.randrange(60)}", "", None, "c5"]), r.choice(["extends", "calls"]), at(r.choice([None, 1, 2]))) for i in range(120)]
    edges = chain + loop + tail + more + more[:20] + [(900, None, "x", "extends", at(1))]
    parent, expected = brute_tree(edges)
    df = spark.createDataFrame(edges, EDGES)
    got = {x.id: (x.root_id, x.depth, x.path) for x in hierarchy.resolve(hierarchy.parents(df), paths=True, split=split).collect()}
    assert {k: (v[0], v[1], v[2][::-1] if v[2] else None) for k, v in got.items()} == expected
    on_cycle = sorted((expected[n][0], n) for n in parent if expected[n][1] < 0 and any(n == m for m in _walk(parent, n)))
    assert rows(hierarchy.cycles(df)) == on_cycle
    pairs = sorted((a, n, v[1] - i) for n, v in expected.items() if v[2] for i, a in enumerate(v[2][:-1]))
    assert rows(hierarchy.descendants(df)) == pairs


def _walk(parent, n):
    m = n
    for _ in range(len(parent)):
        m = parent[m]
        yield m


@pytest.mark.parametrize("split", [hierarchy.SPLIT, 2])
def test_splitters_below_a_cycle_without_one(spark, split):
    ids = [f"m{i}" for i in range(120)]
    of = spark.createDataFrame([(i,) for i in ids], "id string").selectExpr("id", f"pmod(xxhash64(id, 17), {split}) = 0 AS s").collect()
    some, no = iter([r.id for r in of if r.s]), iter([r.id for r in of if not r.s])
    take = lambda kinds: [next(some) if k == "s" else next(no) for k in kinds]
    loop, other = take("nn"), take("n")
    # Below the loops, from the loop down: plain nodes, a splitter, two in a row, and a splitter after plain nodes.
    chains = [(loop[0], take("snn")), (loop[1], take("nssnsn")), (loop[0], take("n")), (other[0], take("nsn"))]
    tree = take("nsnsn")
    links = [(loop[0], loop[1]), (loop[1], loop[0]), (other[0], other[0]), *zip(tree, tree[1:])]
    for head, chain in chains:
        links += zip(chain, [head, *chain])
    edges = [(i, a, b, "extends", at(1)) for i, (a, b) in enumerate(links)]
    parent, expected = brute_tree(edges)
    df = spark.createDataFrame(edges, EDGES)
    got = rows(hierarchy.resolve(hierarchy.parents(df), paths=True, split=split).selectExpr("id", "root_id", "depth", "array_join(reverse(path), ' ') AS path"))
    assert len(got) == len(parent)
    assert got == sorted((n, r, d, p and " ".join(p)) for n, (r, d, p) in expected.items())
    if split == hierarchy.SPLIT:
        assert rows(hierarchy.tree_nodes(df)) == [(n, r, d) for n, r, d, _ in got]
        assert rows(hierarchy.cycles(df)) == sorted((expected[n][0], n) for n in loop + other)


def test_hierarchy_of_nothing(spark):
    none = spark.createDataFrame([], EDGES)
    assert rows(hierarchy.tree_nodes(none)) == [] and rows(hierarchy.tree_paths(none)) == [] and rows(hierarchy.cycles(none)) == []


FEED = "seq long, node_id string, file string, op string, content_hash string, changed_at timestamp_ntz, arrived_at timestamp_ntz"
RUNS = "run_id long, cutoff_at timestamp_ntz, status string"


def feed_and_runs(seed):
    r = random.Random(seed)
    feed = []
    for i in range(250):
        node = r.choice(["hot", *[f"n{k}" for k in range(12)], None])
        op = r.choice(["upsert", "upsert", "delete", None])
        feed.append((i, node, r.choice(["f1", "f2", None]), op, r.choice(["h1", "h2", "h3", None]), at(r.choice([None, *range(30)])), at(r.randrange(40))))
    runs = [(k, at(c), r.choice(["ok", "ok", "failed", None])) for k, c in enumerate(sorted(r.sample(range(45), 14)))]
    return feed + feed[:5], runs


def brute_changes(feed, runs):
    ok = [x for x in runs if x[2] == "ok"]
    before, out = {}, []
    for run, cutoff, _ in ok:
        best = {}
        for f in feed:
            if f[1] is not None and f[6] <= cutoff and (f[3] == "delete" or f[3] == "upsert" and f[4] is not None):
                key = (f[5] is not None, f[5] or T0, f[0])
                if f[1] not in best or key > best[f[1]][0]:
                    best[f[1]] = (key, (f[2], f[4]) if f[3] == "upsert" else None)
        now = {k: v[1] for k, v in best.items() if v[1] is not None}
        out += [(run, n) for n in now.keys() | before.keys() if now.get(n) != before.get(n)]
        before = now
    return sorted(out)


@pytest.mark.parametrize("wave,fold", [(1, 3), (4, 1), (50, 8)])
def test_changed_nodes(spark, wave, fold, tmp_path):
    feed, runs = feed_and_runs(wave)
    engine = ledger.IncrementalFeed(spark, str(tmp_path / "l"), wave=wave, fold=fold)
    df = spark.createDataFrame(feed, FEED)
    engine.process(df, ledger.ok_runs(spark.createDataFrame(runs, RUNS)))
    assert rows(engine.result()) == brute_changes(feed, runs)


def test_changed_nodes_of_nothing(spark):
    assert rows(ledger.changed_nodes(spark.createDataFrame([], FEED), spark.createDataFrame([], RUNS))) == []
    assert rows(ledger.changed_nodes(spark.createDataFrame([], FEED), spark.createDataFrame([(1, at(1), "ok")], RUNS))) == []


def test_failures_neither_skip_nor_repeat(spark, tmp_path):
    feed, runs = feed_and_runs(7)
    df, ok = spark.createDataFrame(feed, FEED), ledger.ok_runs(spark.createDataFrame(runs, RUNS))
    now = [0.0]
    make = lambda: ledger.IncrementalFeed(spark, str(tmp_path / "l"), wave=3, lease_seconds=10, clock=lambda: now[0])
    r = random.Random(1)
    for _ in range(12):

        def fail(where):
            if r.random() < 0.4:
                raise RuntimeError(where)

        engine = make()
        try:
            engine.process(df, ok, fail=fail)
        except RuntimeError:
            assert engine.process(df, ok) == 0  # still leased by the failed worker
            now[0] += 11
    make().process(df, ok)
    assert rows(make().result()) == brute_changes(feed, runs)


@pytest.mark.parametrize("where", ["leased", "changes written", "state written"])
def test_an_overtaken_writer_changes_nothing(spark, tmp_path, where):
    """Its lease runs out, another writer finishes all, then it goes on with an older feed."""
    feed, runs = feed_and_runs(7)
    df, ok = spark.createDataFrame(feed, FEED), ledger.ok_runs(spark.createDataFrame(runs, RUNS))
    now = [0.0]
    make = lambda: ledger.IncrementalFeed(spark, str(tmp_path / "l"), wave=4, lease_seconds=10, clock=lambda: now[0])
    expected = brute_changes(feed, runs)

    def overtaken(step):
        if step == where:
            now[0] += 11
            assert make().process(df, ok, owner="two") == len(ok)
            assert rows(make().result()) == expected

    with pytest.raises(Exception):
        make().process(df.filter("seq < 20"), ok, owner="one", fail=overtaken)
    assert rows(make().result()) == expected and make().process(df, ok) == 0


@pytest.mark.parametrize("marks,then", [(1, 3), (2, 3), (4, 2), (1, 50)])
def test_death_at_a_done_mark(spark, tmp_path, marks, then):
    """The driver dies after some mark, the next one uses waves of another size."""
    feed, runs = feed_and_runs(7)
    df, ok = spark.createDataFrame(feed, FEED), ledger.ok_runs(spark.createDataFrame(runs, RUNS))
    now = [0.0]
    make = lambda wave: ledger.IncrementalFeed(spark, str(tmp_path / "l"), wave=wave, lease_seconds=10, clock=lambda: now[0])
    engine, left = make(3), [marks]
    finish = engine.ledger.finish

    def dying(*args):
        finish(*args)
        left[0] -= 1
        if not left[0]:
            raise RuntimeError("died")

    engine.ledger.finish = dying
    try:
        engine.process(df, ok)
    except RuntimeError:
        now[0] += 11
    half = rows(engine.result())
    assert set(half) <= set(brute_changes(feed, runs)) and len(half) == len(set(half))
    make(then).process(df, ok)
    assert make(then).process(df, ok) == 0
    assert rows(make(then).result()) == brute_changes(feed, runs)
    with pytest.raises(ValueError):
        make(then).process(df, ok[1:])


def test_fencing(spark, tmp_path):
    now = [0.0]
    book = ledger.Ledger(spark, str(tmp_path / "book"), lease_seconds=10, clock=lambda: now[0])
    book.add(["a"])
    first = book.lease("a", "one")
    assert book.state("a") == "leased" and book.lease("a", "two") is None
    now[0] = 11
    second = book.lease("a", "two")
    assert second.token == first.token + 1
    with pytest.raises(ledger.StaleLease):
        book.finish(first)
    book.finish(second, "out")
    assert book.state("a") == "done" and book.note("a") == "out" and book.lease("a", "three") is None
    with pytest.raises(ledger.StaleLease):
        book.finish(second)
