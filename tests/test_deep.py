"""Deep mode: full scan and strict walk."""

import time

import pytest
from pyspark.sql import functions as F

from claimlens.operators.deep import full_references, lexed_references, strict_references
from claimlens.operators.references import references

STRICT = [
    ("require('a')", ["a"]),
    ("let x = require('React'), y = 1, z = require(\"node:fs\");", ["React", "node:fs"]),
    ("var x = require('no')", []),
    ("x = require('b'); f(require('c'), function () { require('d') })", ["b", "c", "d"]),
    ("function g() { if (a) { require('e') } else require('f'); return require('h') }", ["e", "f", "h"]),
    ("for (let i = require('i'); i < 3; i++) { require('j') }", ["i", "j"]),
    ("const f = () => require('no'); const o = {a: require('no')}; [require('no')]", []),
    ("require('no').y; new A(require('no')); a ? require('no') : 1; a + require('no')", []),
    ("try { require('no') } catch (e) { require('no') } while (x) { require('no') }", []),
    ("class A { m() { require('no') } } switch (x) { case 1: require('no') }", []),
    ("// require('no')\n/* require('no') */ 'require(\"no\")'; `require('no')`", []),
    ("require(x); require(); require(`no`); req('no')", []),
    ("(function () { require('k') })()", ["k"]),
    ("let a = 1\nlet b = require('l')\nrequire('m')", ["l", "m"]),
]


@pytest.mark.parametrize(("text", "found"), STRICT)
def test_strict_walk(text, found):
    assert strict_references(text) == found


@pytest.mark.parametrize("text", ["import a from 'a'", "export {a} from 'a'", "let x = {", "'open"])
def test_no_plain_script(text):
    assert strict_references(text) is None


FULL = [
    ("var x = require('a').y; const f = () => require(\"b\")", ["a", "b"]),
    ("import c from 'c'; import 'd'; import('e'); export * from 'f'", ["c", "d", "e", "f"]),
    ("// require('no')\n/* require('no') */ s = \"require('no')\"; `require('no')`", []),
    ("myrequire('no'); a.require('no'); require(x)", []),
    ("r = /'/; require('g')", ["g"]),
    ("require('it\\'s')", ["it\\'s"]),
]


def test_full_scan(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FULL)], "i int, x string").orderBy("i")
    assert [r[0] for r in rows.select(full_references(F.col("x"))).collect()] == [f for _, f in FULL]


def test_fallback_to_the_pattern(spark):
    files = spark.createDataFrame([(1, "import a from 'mod'\nvar x = require('y-y')"), (2, "let x = require('react-dom/client')"), (3, None)], "id int, body string")
    assert {(r.id, r.package) for r in references(files, "deep_strict").collect()} == {(1, "mod"), (1, "y-y"), (2, "react-dom")}
    with pytest.raises(ValueError):
        references(files, "other")


def test_long_texts_end(spark):
    long = "x = '" + "a" * 200_000 + "'; require('end')"
    assert spark.createDataFrame([(long,)], "x string").select(full_references(F.col("x"))).first()[0] == ["end"]


def test_strict_mode_is_linear():
    began = time.perf_counter()
    assert strict_references("f(1);" * 200_000 + "require('end')") == ["end"]
    assert time.perf_counter() - began < 60


def test_nesting_of_any_depth_is_read_alike():
    n = 20_000
    assert strict_references("{" * n + "require('aa');" + "}" * n) == ["aa"]
    assert strict_references("f(" * n + "require('aa')" + ")" * n) == ["aa"]
    assert strict_references("if (x) y(); else " * n + "require('aa')") == ["aa"]


LEXER = [
    (r"require('a\u0062c'); require('a\x62c'); require('a\u{62}c'); require('it\'s'); require('a\
b')", ["abc", "abc", "abc", "it's", "ab"]),
    (r"require('\ud83d\ude00')", ["😀"]),
    ("require(('x')); (require)('y'); ((require))((('z')))", ["x", "y", "z"]),
    ("x = `${`}`}`; require('a')", ["a"]),
    ("x = `a${b(`c${`d}`}{`)}e`; require('a')", ["a"]),
    ("x = `${{a: {b: `${1}`}}.a}`; require('a')", ["a"]),
    ("if (x) /re'/.test(y); require('a')", ["a"]),
    ("while (x) /[/'`]/.test(y)\nrequire('a')", ["a"]),
    ("f(x) / 2; y = a[0] / b / c; require('a')", ["a"]),
    ("if (x) { y() } /'/.test(z); require('a')", ["a"]),
    ("x = `\\`${1}\\${`; require('a')", ["a"]),
    ("x.if(y) / z; require('a')", ["a"]),
]


@pytest.mark.parametrize(("text", "found"), LEXER)
def test_lexer(text, found):
    assert strict_references(text) == found
    assert lexed_references(text) == found


def test_references_in_templates(spark):
    nested = "require('x')"
    for i in range(400):
        nested = f"`${{{nested}}} ${{require('t{i}')}}`"
    assert strict_references(f"y = {nested}; require('a')") == ["a"]
    assert lexed_references(f"y = {nested}; require('a')") == ["x", *[f"t{i}" for i in range(400)], "a"]
    assert [lexed_references(x) for x in ("`${", "`${a", "`", "a)", None, r"require('\u00')")] == [None] * 6
    assert lexed_references("foo(require)('no'); a.require('no'); import('e'); import 'f'; export * from 'g'; from('no'); f(`${import('h')}`)") == ["e", "f", "g", "h"]


def test_full_mode_reads_intricate_bodies(spark):
    rows = spark.createDataFrame(list(enumerate([r"import x from 'a\x62'", "x = `${require('inner')}`", "plain = require('plain')", "(require)('cc')", None, "`${ require('left') "])), "i int, body string")
    assert sorted((r.i, r.package) for r in references(rows, "deep_full").collect()) == [(0, "ab"), (1, "inner"), (2, "plain"), (3, "cc"), (5, "left")]  # the last one is no script, so the pattern reads it


def test_a_megabyte_of_templates_takes_seconds():
    began = time.perf_counter()
    text = "x = `a${f('b', `c${d}`)}e` / 2; if (y) /z'/.test(w);\n" * 20_000 + "require('end')"
    assert strict_references(text) == ["end"] and lexed_references(text) == ["end"]
    assert time.perf_counter() - began < 60
