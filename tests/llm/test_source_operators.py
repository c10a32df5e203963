import os
import random
from datetime import datetime

import pytest

from cartolith.llm import grammar, sourcefiles, syntax
from cartolith.llm.lexing import lex
from cartolith.runtime import shared_dir

GOOD = {
    "java": 'package a.b;\nimport java.util.*;\npublic final class A<T> extends B<T> { int x = 1; @Override public <U> List<U> f(U u) throws E { for (int i = 0; i < 3; i++) { if (i > 1) break; } try { g(); } catch (A | B e) { throw new X("a"); } return (i) -> i + 1; } }',
    "javascript": "import { a as b } from './c'\nexport const f = async (x = 1, { y }) => await x?.y?.[0] ?? `z ${y + `q`}`\nclass A extends B { #p = 1; static async *g() { yield* a } get x() { return /[/]]/.test(this.#p) } }\nfor (const k of list) if (k) continue; else break\nexport default function () {}",
    "typescript": "export interface F<T = string> { readonly a?: T[]; b(x: T): Promise<void> }\ntype U = 'a' | { [K in keyof T]?: T[K] };\nabstract class K<T> implements I { constructor(private x: number) { super(); } m(): void {} }\nfunction g<T extends object>(a: T, b?: string): a is F { return a as unknown as boolean }",
    "cpp": '#include <map>\ntemplate <typename T> T f(const std::map<std::string, T>& m) { auto g = [&](int a) -> int { return a << 1; }; for (const auto& [k, v] : m) { if (v) return v; } switch (x) { case 1: break; default: return static_cast<T>(1); } }\nclass A final : public B { public: A() : b_(1), c_{2} {} virtual ~A() = default; private: int b_ = 41\'000; };\n',
    "python": "@d(1)\nasync def f(a, *, b: int = 1, **k) -> int:\n    if (n := a) > 1: return {x: y for x, y in b if x}\n    try:\n        pass\n    except* E as e:\n        raise X from e\n    return [*a, f\"{a!r}\"][1:2] if a else lambda x=[]: x or []\n",
    "json": '{"a": [1, -2.5e3, true, null], "b": {"c": "\\u00e9"}}',
}
BAD = {
    "java": ["class A { int f() { return 1 } }", "class A { void f() { int = 3; } }", "class A {", "package a.b", "class A { String s = \"x; }", "int x y;"],
    "javascript": ["const x = ;", "function f( { }", "const v = = 1", "x = {a: 1,, b: 2}", "const x: number = 1", "foo(1, 2", "})", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x\n", "const s = 'abc", "f(row[k] [])"],
    "typescript": ["const x: = 1", "interface A { x: number y: string }", "export function f(a: string { }"],
    "cpp": ["int f() { return 1 }", "int x = ;", "void f( { }", "class X { int a; }", "package app.x;", "int f() { return else; }", "#includ <x>\n", "/* open"],
    "python": ["def f(:\n  pass", "if x\n  y", "x = = 1", "  x = 1\n y = 2", "try:\n    a\n", "return else", "s = 'abc", "print(1", "f(row[k] [])", '"""open "x"\n'],
    "json": ["", "{'a': 1}", '{"a": 1,}', "[1 2]", '{"a": 01}', "NaN", '{"a": 1} x', '{"a": "x\ny"}'],
}


@pytest.mark.parametrize("lang", GOOD)
def test_grammar_accepts(lang):
    assert grammar.check(lex(GOOD[lang], lang), lang)[0]


@pytest.mark.parametrize("lang, text", [("cpp", "int main() { int n; cin >> n; while (n--) cout << n << endl; return n >> 1; }"), ("javascript", "do { a() } while (b)"), ("javascript", "x = a >>> 2 >> 1"), ("java", "class A { int f(int a) { return a >>> 2; } }"), ("typescript", "const h = (a: string, b: number): string => `${a}${b}`;"), ("typescript", "declare module 'x' { export function f(a: number): string; }"), ("cpp", "template <typename... A> void log(A&&... a) { (cout << ... << a); }")])
def test_grammar_accepts_more(lang, text):
    assert grammar.check(lex(text, lang), lang)[0]


@pytest.mark.parametrize("lang, text", [(lang, t) for lang, ts in BAD.items() for t in ts])
def test_grammar_rejects(lang, text):
    tokens = lex(text, lang) or [("ERR", 0)]
    assert not grammar.check(tokens, lang)[0]


@pytest.mark.parametrize("lang", GOOD)
def test_truncation_inside_brackets_is_found(lang):
    text = GOOD[lang]
    opened = [i for i in range(1, len(text)) if text[:i].count("(") > text[:i].count(")")] or [text.index("[") + 3]
    assert not grammar.check(lex(text[: opened[len(opened) // 2]], lang), lang)[0]


EXT = {"java": "java", "javascript": "js", "typescript": "ts", "cpp": "cpp", "python": "py", "json": "json"}
FILES = "project_id string, path string, length bigint, modification_time timestamp, scanned_at timestamp, content string, language string, f1 string, ord string"
T1, T2 = datetime(2026, 1, 1), datetime(2026, 1, 2)


def _files(spark, rows):
    return spark.createDataFrame([(p, f, 1, t, T1, c, "x", "y", "z") for p, f, t, c in rows], FILES)


def test_invalid_files_of_a_table(spark):
    rows, want = [], set()
    for lang, ext in EXT.items():
        rows.append(("p", f"good.{ext}", T1, "\ufeff" + GOOD[lang]))
        for n, t in enumerate(BAD[lang]):
            rows.append(("p", f"bad{n}.{ext}", T1, t))
            want.add(("p", f"bad{n}.{ext}"))
    rows += [("p", "empty.py", T1, ""), ("p", "null.cpp", T1, None), ("p", "fixed.json", T2, "[]"), ("p", "fixed.json", T1, "["), ("p", "worse.json", T1, "[]"), ("p", "worse.json", T2, "["), (None, "n.json", T1, "{"), ("p", None, T1, "{"), ("p", "x.txt", T1, "{"), ("p", "notime.json", None, "{")]
    rows += [("p", "big.json", T1, "[" + "1," * 60000 + "1]"), ("p", "deep.json", T1, "[" * 300 + "]" * 300)] + rows[:5]
    want |= {("p", "worse.json"), (None, "n.json"), ("p", "notime.json")}
    assert {tuple(r) for r in syntax.invalid_files(_files(spark, rows)).collect()} == want


def test_invalid_python_that_the_productions_allow(spark):
    texts = ["try:\n    pass\nexcept ValueError, e:\n    pass\n", "x = 10L\n", "x = 0777\n", "f() = 1\n", "1 = x\n", "def f(a=1, b):\n    pass\n", "f(a=1, 2)\n"]
    rows = [("p", f"bad{n}.py", T1, t) for n, t in enumerate(texts)] + [("p", "good.py", T1, GOOD["python"])]
    assert {r.path for r in syntax.invalid_files(_files(spark, rows)).collect()} == {f"bad{n}.py" for n in range(len(texts))}


def test_invalid_files_of_nothing_and_rates(spark):
    assert syntax.invalid_files(_files(spark, [])).count() == 0
    f = _files(spark, [("p", "a.json", T1, "{"), ("p", "b.json", T1, "{}"), ("p", "c.json", T1, None)])
    parsed = spark.createDataFrame([("p", "a.json", 1, True, T1), ("p", "a.json", 2, False, T2), ("p", "zz.json", 1, True, T1)], "project_id string, file_path string, attempt int, succeeded boolean, parsed_at timestamp")
    assert {(r.path, r.valid, r.attempts, r.reported) for r in syntax.file_status(f, parsed).collect()} == {("a.json", False, 2, False), ("b.json", True, 0, None), ("c.json", None, 0, None)}
    assert [tuple(r) for r in syntax.invalid_rates(f, parsed).collect()] == [("p", "json", 2, 1, 0.5)]


def _code(seed, n=14):
    rnd = random.Random(seed)
    return "".join(f"int value_{rnd.randrange(10**6)} = compute({rnd.randrange(10**6)});\n" for _ in range(n))


def test_machine_files(spark):
    lib = _code(1)
    edited = lib.split("\n")
    edited[3] = "int own_change_here = 17;"
    rows = [
        ("a", "vendor/lib/x.cpp", T1, lib), ("b", "src/copied.cpp", T1, "\n".join(edited)), ("b", "src/own.cpp", T1, _code(2)), ("c", "src/half.cpp", T1, "\n".join(lib.split("\n")[:7]) + _code(3)),
        ("a", "src/gen.cpp", T1, "// Code generated by tool 1.2; DO NOT EDIT.\n" + _code(4)), ("a", "src/writer.py", T1, "HEADER = '// Code generated by tool; DO NOT EDIT'\n" + _code(5)), ("a", "src/twin.ts", T1, "// Do not edit the generated twin of this table; change it here.\n" + _code(6)),
        ("a", "src/lic.cpp", T1, "// Copyright (c) the own team. Part of this project, see LICENSE.\n" + _code(7)), ("a", "src/foreign.cpp", T1, "/*!\n * tiny v1.2.3 | (c) the tiny authors | MIT licensed\n */\n" + _code(8)),
        ("a", "web/app.min.js", T1, "x"), ("a", "src/moc_view.cpp", T1, None), ("a", "src/bundle_loader.cpp", T1, _code(9)), ("a", "src/distribution/x.cpp", T1, _code(10)), ("a", "out/x.cpp", T1, ""),
        ("a", "src/packed.js", T1, "var a=b(1,c);" * 200), ("a", "src/table.cpp", T1, "int t[] = {" + ",\n".join("1, 2, 3, 4" for _ in range(60)) + "};"), ("a", None, T1, lib), (None, "src/copy2.cpp", T1, lib),
    ]
    shared = _code(11)
    rows += [(p, "src/same.cpp", T1, shared) for p in ("a", "b", "c")] + [("a", "src/two.cpp", T1, _code(12)), ("b", "src/two.cpp", T1, _code(12))] + rows[:4]
    got = {(r.project_id, r.path): r.reason for r in sourcefiles.machine_files(_files(spark, rows)).collect()}
    assert got == {
        ("a", "vendor/lib/x.cpp"): "third-party", ("b", "src/copied.cpp"): "third-party", (None, "src/copy2.cpp"): "third-party", ("a", "src/gen.cpp"): "output", ("a", "src/foreign.cpp"): "third-party", ("a", "web/app.min.js"): "output",
        ("a", "src/moc_view.cpp"): "output", ("a", "out/x.cpp"): "output", ("a", "src/packed.js"): "minified", ("a", "src/table.cpp"): "data", ("a", "src/same.cpp"): "third-party", ("b", "src/same.cpp"): "third-party", ("c", "src/same.cpp"): "third-party",
    }


def _edited(text, seed):
    lines = text.split("\n")
    lines[seed % (len(lines) - 1)] = f"int own_change_{seed}_here = {seed};"
    return "\n".join(lines)


def test_edited_copies_are_found_however_many(spark):
    lib = _code(20, 24)
    rows = [("a", "vendor/lib/x.cpp", T1, lib)] + [(f"p{n}", f"src/copied{n}.cpp", T1, _edited(lib, n)) for n in range(12)]
    rows += [(f"p{n}", "src/own.cpp", T1, _code(100 + n) + "".join(f"common_line_of_many_files({k});\n" for k in range(40))) for n in range(12)]
    got = {r.path for r in sourcefiles.machine_files(_files(spark, rows)).collect()}
    assert got == {"vendor/lib/x.cpp"} | {f"src/copied{n}.cpp" for n in range(12)}


def test_the_one_source_among_many_versions_is_found(spark):
    lib = _code(21, 20).split("\n")[:-1]
    rnd = random.Random(5)
    rows = [("a", f"vendor/v{n}/x.cpp", T1, "\n".join(rnd.sample(lib, 9)) + "\n" + _code(200 + n)) for n in range(40)]
    rows += [("a", "vendor/true/x.cpp", T1, "\n".join(lib)), ("b", "src/copied.cpp", T1, _edited("\n".join(lib), 3)), ("b", "src/half.cpp", T1, "\n".join(lib[:10]) + "\n" + _code(300, 10))]
    got = {r.path for r in sourcefiles.machine_files(_files(spark, rows)).collect()}
    assert "src/copied.cpp" in got and "src/half.cpp" not in got


def test_edited_copies_without_a_marked_original_are_found(spark):
    lib, two = _code(22, 20), _code(23, 20)
    rows = [(p, f"src/{p}.cpp", T1, _edited(lib, n)) for n, p in enumerate("abcdefg")] + [(p, f"src/two_{p}.cpp", T1, _edited(two, n)) for n, p in enumerate("ab")]
    rows += [("a", f"src/again{n}.cpp", T1, _edited(two, n + 5)) for n in range(3)]
    assert {r.path for r in sourcefiles.machine_files(_files(spark, rows)).collect()} == {f"src/{p}.cpp" for p in "abcdefg"}


def test_a_statement_of_origin_counts_wherever_it_stands(spark):
    rows = [("a", "src/low.cpp", T1, "// part of the banner\n" * 30 + "// tiny v1.2.3 | (c) the tiny authors | MIT licensed\n" + _code(30)), ("a", "src/own.cpp", T1, "// part of the banner\n" * 30 + _code(31))]
    assert {r.path for r in sourcefiles.machine_files(_files(spark, rows)).collect()} == {"src/low.cpp"}


def test_machine_files_of_nothing(spark):
    assert sourcefiles.machine_files(_files(spark, [])).count() == 0


def test_report_paths_are_normalised(spark):
    df = spark.createDataFrame([("./src//a.cpp", "/r"), ("/r/src/./a.cpp", "/r/"), ("src\\a.cpp", None), ("D:\\w\\src\\a.cpp", "D:\\w"), (None, "/r")], "p string, r string")
    assert [r[0] for r in df.select(sourcefiles.normal_path(df.p, df.r)).collect()] == ["src/a.cpp"] * 4 + [None]


def test_lines_alone_tell_copies(spark):
    """Copies with edits in ordinary folders, whose originals are the only files that path or text give away."""
    rnd = random.Random(12)
    libs = [_code(400 + k, 30) for k in range(12)]
    rows, want = [], set()
    for k, lib in enumerate(libs):
        rows.append(("a", f"vendor/lib{k}/x.cpp", T1, lib))
        for n in range(3):
            lines = lib.split("\n")
            for at in rnd.sample(range(30), 1 + n):
                lines[at] = f"int own_{k}_{n}_{at} = {at};"
            rows.append((f"p{n}", f"src/c{k}_{n}.cpp", T1, "\n".join(lines)))
            want.add(f"src/c{k}_{n}.cpp")
    rows += [(f"p{n}", f"src/own{n}.cpp", T1, _code(600 + n, 30)) for n in range(40)]
    got = sourcefiles.machine_files(_files(spark, rows)).where("evidence = 'lines'").collect()
    assert {r.path for r in got} == want


def test_files_of_common_lines_are_no_pairs_and_leave_nothing_behind(spark, monkeypatch):
    """Files that share lines and are no copies are not moved as pairs; what is staged goes before the result is read."""
    rnd = random.Random(31)
    words = [f"shared_statement_{k}(value_{k});" for k in range(150)]
    rows = [(f"p{n}", f"src/own{n}.cpp", T1, "\n".join(rnd.sample(words, 14))) for n in range(200)]
    lib = _code(700, 20)
    rows += [("a", "vendor/lib/x.cpp", T1, lib), ("b", "src/copied.cpp", T1, _edited(lib, 3))]
    files, moved, compare = _files(spark, rows), [], sourcefiles.contained_pairs
    monkeypatch.setattr(sourcefiles, "contained_pairs", lambda pairs, lined: (moved.append(pairs.count()), compare(pairs, lined))[1])
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    found = sourcefiles.machine_files(files)
    assert {x.split("-")[1] for x in set(os.listdir(folder)) - before} == {"verdicts", "copied"}
    assert {r.path for r in found.collect()} == {"vendor/lib/x.cpp", "src/copied.cpp"}
    assert 1 <= sum(moved) < 100


def test_the_newest_state_is_judged(spark):
    gen = "// Code generated by tool 1.2; DO NOT EDIT.\n"
    rows = [("a", "src/a.cpp", T1, gen + _code(1)), ("a", "src/a.cpp", T2, _code(1)), ("a", "src/b.cpp", T2, gen + _code(2)), ("a", "src/b.cpp", T1, _code(2)), ("a", "src/c.cpp", T2, None), ("a", "src/c.cpp", T1, gen + _code(3))]
    assert {r.path for r in sourcefiles.machine_files(_files(spark, rows)).collect()} == {"src/b.cpp"}
