"""The grammars on valid and invalid programs, verdicts, and functions with their documentation."""

import json

import pytest

from arbograph.llm import docs, parse

PHP_VALID = [
    "",
    "plain text <b>and</b> { no code",
    "<?php",
    "<?php\n",
    "<?= $a ?>text<?php if ($a): ?>x<?php elseif ($b): ?>y<?php else: ?>z<?php endif; ?>",
    "<?php foreach ($a as $k => [$x, 'y' => $y]): echo $x, $y; endforeach; for ($i = 0, $j = 1; $i < 3; $i++, $j--); while (1): break; endwhile;",
    "<?php switch ($a) { case 1: case 'x'; echo 1; break; default: }",
    "<?php namespace A\\B; use C\\{D, E as F, function g}; use function h\\i; use const J; const K = 1, L = K . 'x';",
    "<?php namespace A { const X = 1; function f() {} } namespace { f(); }",
    "<?php declare(strict_types=1); abstract class A extends B implements C, D { use T, U { T::f insteadof U; U::f as protected g; h as i; } }",
    "<?php class A { public const int X = 1, Y = 2; final protected const Z = self::X; private ?int $a = null, $b; public readonly int|string $c; static $d; var $e = [1, 2]; public (A&B)|null $f; }",
    "<?php class A { public string $n { get => $this->n; set(string $v) { $this->n = $v; } } public private(set) int $x = 1; abstract public int $y { get; } }",
    "<?php final readonly class P { public function __construct(private int $x = 0, protected(set) array $y = [], ...$rest,) { parent::__construct(); } }",
    "<?php enum S: string implements I { case A = 'a'; case B = 'b'; const C = self::A; public static function list(): array { return self::cases(); } }",
    "<?php interface I extends J, K { public function f(int ...$a): static; const X = 1; } trait T { abstract function class(); }",
    "<?php #[A, B(1, name: 'x]')] function &f(#[C] ?A $a, int|null &$b = null, self ...$c): never { throw new X; }",
    "<?php $f = fn(int $x): int => $x * 2; $g = static function () use ($a, &$b,): void {}; $h = #[A] static fn&($x) => $x; $s = strlen(...); $o->m(...); A::b(...);",
    "<?php $x = match (true) { $a, $b => 1, default => throw new E(), }; $y = $a ?? $b ?: $c ? 1 : 2; $z = $a <=> $b; $q = !$a instanceof B && $c xor $d and $e;",
    "<?php [$a, [, $b], 'k' => $c] = $d; list($a, list(, $b)) = $c; [$a, $b] = [$b, $a]; $a[] = &$b; $a['x']['y'] ??= 1; $a->b->c[1]++; --$a;",
    "<?php echo \"a $b[0] $b[key] $b[-1] $b->c {$d->e['f']} ${g} ${h['i']} \\$x {not}\", 'it\\'s', `ls $dir`;",
    "<?php $t = <<<EOT\n  a $b {$c['d']}\n    x\n  EOT . 'y'; $u = <<<'N'\nraw $x { \nN;\n$v = <<<\"Q\"\nQ;",
    "<?php function g() { yield; yield 1; yield 'a' => 2; $x = yield $y; yield from h(); return; } goto end; end: echo 1;",
    "<?php try { f(); } catch (A | B $e) { } catch (C) { } finally { }",
    "<?php new class(1) extends A { public $x; function f() {} }; (new A)->b(); new A()->b()::C; new ($x . 'y')(1); new $a->b['c'](1); new static; clone $x;",
    "<?php $a = (int) $b; $c = (array) [1]; @f(); print 'x'; include 'y'; exit; exit(1); die(); isset($a, $b['c'],); empty($a); eval('x');",
    "<?php A::{'f'}(); A::$b(); A::$b['c']; $a::B; $a?->b?->c(); $$a; ${'x'}; $a->{'b'}; $a->$b(); 'A'::f(); [1][0]; 'abc'[1]; (f)(); \\A\\b(); namespace\\c();",
    "<?php f(a: 1, class: 2, ...$x); f(\n  $a,\n); if ($a) echo 1; else if ($b) echo 2; else { } do { } while (0);",
    "<?php $x = 1_000 + 0x1F + 0b11 + 0o17 + 017 + 1.5e3 + .5 + 6.; // a ?> tail\n<?php # c\n/* d */ /** e */",
    "<?php static $a = 1, $b; global $c, $$d; unset($a, $b[1]); echo PHP_EOL; const A = 1; return;",
    "<?php class if_ { function if() { return $this->class->list()::new; } } A::class; enum(1); $enum = 1; function enum() {} readonly class R {} function readonly() {}",
    "<?php __halt_compiler(); } } <<<<<<< any { thing",
    "<?php /* <<<<<<< ours */ $x = '=======\n>>>>>>> theirs'; function () {};",
    "<?php PUBLIC_(); IF (TRUE) { ECHO 1; } ELSEIF (0) {} CLASS Q { PUBLIC STATIC FUNCTION f() {} }",
]
PHP_INVALID = [
    "<?php {",
    "<?php }",
    "<?php function f( { }",
    "<?php class { }",
    "<?php class A { function f() {} ",
    "<?php class A { int $x; }",
    "<?php class A { public function f() { return 1 } }",
    "<?php\n<<<<<<< HEAD\n$a = 1;\n=======\n$a = 2;\n>>>>>>> b\n",
    "<?php $a = 'unclosed;\n",
    "<?php $a = \"unclosed {$b};\n",
    "<?php /* open",
    "<?php $x = <<<EOT\nnever closed\n",
    "<?php $x = <<<EOT\n a\n  EOT;",
    "<?php 1 = 2;",
    "<?php if ($a) { } else { } else { }",
    "<?php echo 1 echo 2;",
    "<?php use A\\{B, C;",
    "<?php f(1, , 2);",
    "<?php $a->;",
    "<?php function 1f() {}",
    "<?php foreach ($a $b) {}",
    "<?php namespace A; class list {}",
    "<?php $x = fn($a) {};",
    "<?php \"$a[\";",
    "<?php class A { case; }",
    "<?php a: b: c",
    "<?= ?>",
]
JS_VALID = [
    "",
    "#!/usr/bin/env node\nimport a, { b as c, default as d } from 'e'; import * as f from \"g\"; import 'h'; export * from 'i'; export * as j from 'k'; export { a, c as l };",
    "export default class { #p = 1; static #q; static { this.x = 1 } get a() { return this.#p } set a(v) {} static async *g() { yield* h() } [k] = 1; 'x' = 2; constructor() { super() } async m() { await 1 } }",
    "export const f = async ({ a = 1, ...r }, [b, , c] = []) => { await x; return `a ${b + `n ${c}`} d` };",
    "const re = /[/\"'{(]\\/x/gu.test(s) / 2; let y = a / b / c; if (x) /re/.exec(y); const o = { a, b: 1, 'c': 2, [d]: 3, get e() { return 1 }, async f() {}, *g() {}, ...h }; ({ a, b: [c] } = d); [a, b.c] = e",
    "let a = 1\nlet b = a\n++b\nfor (const x of y) z(x)\nfor (let i = 0, j; i < 3; i++) continue\nfor (k in o) { break }\nfor await (const q of r) {}\nlabel: while (1) { break label }",
    "a?.b?.[c]?.(d) ?? e; x ||= y; x **= 2; new Foo; new a.b(c).d(); new.target; import('x').then(m => m); import.meta.url; 1_000n; .5; 0x1f; `x`;",
    "switch (a) { case 1: let x = 1; break; default: } try { a() } catch { b() } finally { c() } do x++; while (x < 5) y(); throw new Error('x')",
    "function* g() { const x = yield; yield a, b } async function h() {} (function () {})(); (() => {})(); (a, b) => a; async x => x; async () => ({}); x = function y() {}; var z = class extends B {}",
    "if (a) b(); else if (c) d(); else e()\nreturn_ = 1; of = 2; get = 3; async = 4; x.class.if; ({ class: 1, if: 2 })",
    "#x in y".replace("#x in y", "class A { #x; has(y) { return #x in y } }"),
]
JS_INVALID = [
    "{ \"a\": 1 }",
    "let a b",
    "function f( {",
    "const a;",
    "<?php echo 1;",
    "return 1",
    "if (a { }",
    "'unclosed",
    "`open ${a",
    "a +",
    "let x = 08;",
    "export { a",
    "import a from b",
    "<<<<<<< HEAD\na()\n=======\nb()\n>>>>>>> c",
    "def f():\n    pass",
    "var class = 1",
    "x = { a = 1 }",
    "1 = 2",
    "with (a) {}",
    "}",
]


@pytest.mark.parametrize("text", PHP_VALID)
def test_php_valid(text):
    assert parse.is_php(text)


@pytest.mark.parametrize("text", PHP_INVALID)
def test_php_invalid(text):
    assert not parse.is_php(text)


@pytest.mark.parametrize("text", JS_VALID)
def test_js_valid(text):
    assert parse.is_javascript(text)


@pytest.mark.parametrize("text", JS_INVALID)
def test_js_invalid(text):
    assert not parse.is_javascript(text)


def test_json():
    good = ["1", ' {"a": [1, -2.5e3, true, null, "\\u00e9"]}\n', "[]", '"x"', "9" * 5000, "[" * 50_000 + "]" * 50_000]
    bad = ["", " ", "{", "[1,]", "{'a': 1}", "NaN", "01", '"\t"', "1 2", "[" * 50_000, "\ufeff1", '{"a" 1}']
    assert all(map(parse.is_json, good)) and not any(map(parse.is_json, bad))
    assert all(parse._json_by_grammar(t) for t in good[:5]) and not any(parse._json_by_grammar(t) for t in bad)


def test_python():
    assert parse.is_python("def f[T](x: T) -> T:\n    match x:\n        case 1: return f'{x!r:>{3}}'\n") and parse.is_python("") and parse.is_python("\ufeffx = 1\r\n")
    assert not parse.is_python("def f(:\n") and not parse.is_python("x = 'a\n") and not parse.is_python("x\0")


def test_verdicts(spark):
    rows = [(1, "a.php", "<?php f();"), (2, "a.py", "<?php f();"), (3, "b.json", "{"), (4, "c.js", None), (5, "d.txt", "x"), (6, None, "x = 1"), (7, "e.JSON", '{"a": 1}'), (8, "f.mjs", '{"a": 1}'), (9, "g.json", ""), (9, "g.json", ""), (10, "h.php", "x = 1"), (11, "x.y/noext", "1")]
    df = spark.createDataFrame(rows, "file_id long, file string, content string").selectExpr("*", "'r' AS repo", "CAST(NULL AS string) AS module", "1 AS valid")
    got = sorted((r.file_id, r.valid, r.verdict) for r in parse.verdicts(df).collect())
    assert got == [(1, True, "ok"), (2, False, "wrong_extension"), (3, False, "corrupt"), (5, None, "unknown_extension"), (6, None, "unknown_extension"), (7, True, "ok"), (8, False, "wrong_extension"), (9, False, "corrupt"), (9, False, "corrupt"), (10, True, "ok"), (11, None, "unknown_extension")]
    assert sorted(r.file_id for r in parse.bad_files(df).collect()) == [2, 3, 8, 9, 9]
    assert parse.bad_files(df.limit(0)).collect() == []
    rates = {r.language: (r.n_files, r.n_bad, r.n_wrong_extension) for r in parse.rates(df.filter("file_id != 9")).collect()}
    assert rates == {"php": (2, 0, 0), "python": (1, 1, 1), "json": (2, 1, 0), "javascript": (1, 1, 1)}


def test_long_file():
    body = "".join(f"    /** Adds item number {i} to the whole list. */\n    public function f{i}(array $a): int {{ return count($a) + {i}; }}\n" for i in range(3000))
    ok, found = docs.functions(f"<?php\nclass Big\n{{\n{body}}}\n")
    assert ok and len(found) == 3000


SOURCE = """<?php
namespace A\\B;

/** Class comment that is long enough. */
class C
{
    /**
     * Moves every open entry into the {@see Note} list of <em>today</em>.
     *
     * @param int $x
     */
    #[R('/x', name: 'function fake() {')]
    // ordinary
    final public static function &moveAll(int $x) { return $x; }

    /** First comment with quite enough words. */
    /** @return int */
    public function second() { function inner() {} $c = function () {}; }

    /** Explains the constant with enough words. */
    const X = 1;
    public function third() { $x = 'function nope() {}'; /* function no() {} */ }

    /** Get the next item */
    public function getNextItem() {}

    /** TODO: document this function properly please */
    abstract function todo();

    public /** Between modifiers but still above it. */ function between() { return new class { /** An anonymous one with words. */ function anon() {} }; }
}

if (true) {
    /* Ordinary comment with enough words. */
    function plain() {}
    /**
     * Runs the plain job once for each given key
     */
    function run_plain() {}
}
"""


def test_functions():
    ok, found = docs.functions(SOURCE)
    assert ok
    assert [f.fqcn for f in found] == ["A\\B\\C::moveAll", "A\\B\\C::second", "A\\B\\inner", "A\\B\\C::third", "A\\B\\C::getNextItem", "A\\B\\C::todo", "A\\B\\C::between", "A\\B\\plain", "A\\B\\run_plain"]
    described = {f.fqcn.split("\\")[-1]: docs.description(f.doc) for f in found if f.doc}
    assert described == {"C::moveAll": "Moves every open entry into the list of today .", "C::second": "", "C::getNextItem": "Get the next item", "C::todo": "TODO: document this function properly please", "C::between": "Between modifiers but still above it.", "run_plain": "Runs the plain job once for each given key"}


def test_functions_of_broken_files():
    ok, found = docs.functions(SOURCE.replace("const X = 1;", "<<<<<<< HEAD\n const X = ;"))
    assert not ok and all(f.recovered for f in found)
    assert {"A\\B\\C::moveAll", "A\\B\\C::third", "A\\B\\run_plain"} & {f.fqcn for f in found} >= {"A\\B\\C::moveAll", "A\\B\\C::third"}


def test_long_broken_files():
    """The class stands first in the file; what is whole comes out before and after the damage, in linear time."""
    body = "".join(f"/** Moves item {i} into the other list. */ #[Tag({i})] public function f{i}(Y $y): Z {{ return new Q{i}(); }}\n" for i in range(2000))
    ok, found = docs.functions("<?php class A {" + body)
    assert not ok and [f.fqcn for f in found] == [f"A::f{i}" for i in range(2000)] and all(f.doc for f in found)
    ok, found = docs.functions("<?php class A {" + body.replace("Q200()", "<<<<<<< ours"))
    assert not ok and [f.fqcn for f in found] == [f"A::f{i}" for i in range(2000) if i != 200]


def test_namespaces_in_braces():
    _, found = docs.functions("<?php namespace X { function a() {} class K { function m() {} } } namespace { function b() {} interface I { function n(); } }")
    assert [f.fqcn for f in found] == ["X\\a", "X\\K::m", "b", "I::n"]


@pytest.mark.parametrize(
    "text,name,trivial",
    [
        ("", "f", True),
        ("Runs it all", "f", True),
        ("Resolves the allowed page lists for a", "resolveAllowedPageList", True),
        ("Resets this entries of the entry", "reset_entry", True),
        ("Trimmed the stopping point for it", "f", False),
        ("No description available for this method yet", "f", True),
        ("Auto-generated stub, documentation still to be written", "f", True),
        ("Please fill in the description of this function", "f", True),
        ("Describes the stub of the order", "f", False),
        ("Add a comment to the class", "f", None),
        ("Add a comment to the class", "addComment", False),
        ("Generate documentation for a class", "f", None),
        ("Explanation to follow in a later release", "f", None),
        ("======= !!! ... ---- a", "f", True),
    ],
)
def test_trivial(text, name, trivial):
    assert docs.is_trivial(text, name) == trivial


def test_repeated_stubs(spark):
    """An undecided text is a stub above functions of three names, in whatever files, and none above copies of one function."""
    said = ["Explanation to follow in a later release"] * 3 + ["Add a comment to the class"] * 2
    one = "<?php " + " ".join(f"/** {d}. */ function f{i}() {{}}" for i, d in enumerate(said))
    other = "<?php class K { /** add a comment to the class */ function f3() {} /** Moves all the open entries. */ function g() {} }"
    df = spark.createDataFrame([(1, "a.php", one), (2, "b.php", other), (3, "b.php", other)], "file_id long, file string, content string")
    assert sorted(map(tuple, docs.found(df).collect())) == [(1, "f3"), (1, "f4"), (2, "K::f3"), (2, "K::g"), (3, "K::f3"), (3, "K::g")]
    assert docs.found(df.filter("file_id = 1")).count() == 2 and docs.pairs(df, share=1.0).filter("fqcn LIKE 'f%'").count() == 2


def test_stubs_and_descriptions_of_other_wordings():
    """Wordings that the word lists were not made from; the README has the figures."""
    stubs = ["Nobody has explained this one so far", "Left blank on purpose by author", "This method still needs a description", "No comment has been written for this function", "There is no documentation for this method", "Someone should document what this does", "TODO: explain what happens in this function", "Undocumented, see the code for now"]
    real = ["Adds the comment of the user to the given post", "Removes every comment that no visitor has seen yet", "Creates a stub for the given interface", "Fills blank cells with the value of the row above", "Checks whether the document is missing a signature", "Counts the comments that were written this week", "Sends the comment to the moderators for review"]
    assert all(docs.is_trivial(t, "f") is not False for t in stubs) and not any(docs.is_trivial(t, "f") for t in real)


def test_found_and_pairs(spark):
    rows = [(1, "a.php", SOURCE), (2, "b.php", SOURCE[:-3]), (3, "c.py", SOURCE), (4, "d.php", None), (5, "e.php", ""), (6, "f.PHP", SOURCE)]
    df = spark.createDataFrame(rows, "file_id long, file string, content string").selectExpr("*", "1 AS fqcn", "2 AS code")
    one = ["A\\B\\C::between", "A\\B\\C::moveAll", "A\\B\\run_plain"]
    assert sorted((r.file_id, r.fqcn) for r in docs.found(df).collect()) == [(i, f) for i in (1, 6) for f in one]
    pairs = docs.pairs(df, share=1.0).collect()
    assert sorted({r.file_id for r in pairs}) == [1, 2, 6] and all(r.recovered == (r.file_id == 2) for r in pairs)
    assert all(r.code.endswith(("}", ";")) and "function" in r.code for r in pairs)
    assert docs.pairs(df, share=0.1).count() == 0
    assert docs.found(df.limit(0)).collect() == []


def test_pairs_of_a_few_functions(spark):
    """A template that stands once is no repeated one, however few functions there are."""
    said = ["Moves every open entry into the list of today", "Trims the stopping point before it is kept", "Counts what the buyers sent back", *["Walks the whole tree again"] * 3]
    source = "<?php " + " ".join(f"/** {d}. */ function f{i}() {{}}" for i, d in enumerate(said))
    df = spark.createDataFrame([(1, "a.php", source)], "file_id long, file string, content string")
    assert sorted((r.fqcn, r.n_template) for r in docs.pairs(df).collect()) == [("f0", 1), ("f1", 1), ("f2", 1)]
    assert sorted((r.fqcn, r.n_template) for r in docs.pairs(df, share=0.5).collect()) == [("f0", 1), ("f1", 1), ("f2", 1), ("f3", 3), ("f4", 3), ("f5", 3)]
    assert docs.pairs(df.limit(0)).collect() == []
