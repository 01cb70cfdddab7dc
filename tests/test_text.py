"""Text edge cases: decoding, Unicode names, page names, file suffixes."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from codeloom.functions import names, text
from codeloom.operators import javascript, parsed, rules
from codeloom.operators.facts import explode_facts
from codeloom.operators.javascript_scopes import scopes
from codeloom.operators.javascript_source import script_facts


def facts_of(spark, expression, content, ext=".x", directory="a/b"):
    files = spark.createDataFrame(
        [("r", f"{directory}/f{ext}", directory, f"f{ext}", ext, content)],
        "repo string, file_id string, dir string, name string, ext string, content string",
    )
    rows = explode_facts(files, expression).orderBy("stage", "pos").collect()
    return [(r["name"], r["type"]) for r in rows]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("naïve\r\nx\ry\n".encode(), "naïve\nx\ny\n"),
        (b"caf\xe9\r\n", "café\n"),
        (b"", ""),
        ("a b".encode(), "a b"),
    ],
)
def test_decode(spark, raw, expected):
    df = spark.createDataFrame([(bytearray(raw),)], "b binary")
    assert df.select(text.decode_text(F.col("b"))).first()[0] == expected


def test_unreadable_is_empty(spark):
    df = spark.createDataFrame([(None,)], "b binary")
    assert df.select(text.decode_text(F.col("b"))).first()[0] == ""


def test_unicode_identifiers_and_line_separator(spark):
    go = "func Größe(x int) {\n}\n" + "x\u2028func NotALine() {\n}\n"
    assert facts_of(spark, rules.language_facts("go", F.col("content")), go) == [
        ("Größe", "function")
    ]


def test_unicode_space_separates(spark):
    source = "class\u00a0Straße {\n};\n"
    assert ("Straße", "class") in facts_of(
        spark, rules.language_facts("cpp", F.col("content")), source
    )


@pytest.mark.parametrize(
    "name, ext",
    [("a.PY", ".py"), (".py", ""), ("..py", ""), ("a.tar.gz", ".gz"), ("a.", ""), ("a", ""),
     ("a..py", ".py"), (".a.ts", ".ts")],
)
def test_file_extension(spark, name, ext):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(names.file_extension(F.col("n"))).first()[0] == ext


@pytest.mark.parametrize(
    "name, expected",
    [("latest.py", "test"), ("domain.py", "main"), ("ModelService.ts", "service"),
     ("routes.go", "router"), ("screenRouter.ts", "component"), ("x.py", "file"),
     ("grpc_main.go", "main"), ("grpc.go", "grpc")],
)
def test_file_class(spark, name, expected):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(names.classify_file(F.col("n"))).first()[0] == expected


def test_page_names(spark):
    long = "pkg/" + "ü" * 150 + "::f"
    cases = {
        "a/b.py::C": "a_b.py_C",
        "a\\b(c)\t*?": "a_b_c",
        "__x__": "x",
        "///": "unnamed_node",
        long: ("pkg_" + "ü" * 150 + "_f")[:120]
        + "__" + hashlib.sha1(long.encode()).hexdigest()[:10],
        "x" * 140: "x" * 140,
    }
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    found = {r[0]: r[1] for r in df.select("n", names.page_name(F.col("n"))).collect()}
    assert found == cases


def test_keywords_are_distinct_and_long_enough(spark):
    df = spark.createDataFrame([("src/ab.Größe_x::Größe_x", "Class")], "i string, t string")
    words = df.select(names.keywords(F.col("i"), F.col("t"))).first()[0]
    assert sorted(words) == sorted(["src", "größe_x", "class"])


# ------------------------------------------------------------------ JavaScript


def script_rows(spark, sources, ext=".ts"):
    """Facts of each source text, in order."""
    files = spark.createDataFrame(
        [("r", f"{i:04d}", ext, s) for i, s in enumerate(sources)],
        "repo string, file_id string, ext string, content string",
    )
    found = [[] for _ in sources]
    for r in script_facts(files).orderBy("file_id", "stage", "pos").collect():
        found[int(r.file_id)].append(r)
    return found


def js(spark, content, ext=".ts"):
    return [(r["name"], r["type"]) for r in script_rows(spark, [content], ext)[0]]


def test_class_window_is_counted_in_characters(spark):
    near = "// @Guard\n" + "// é\n" * 380 + "class A {\n}\n"
    far = "// @Guard\n" + "// é\n" * 400 + "class A {\n}\n"
    assert js(spark, near) == [("A", "nestjs_guard")]  # 1,910 characters back
    assert js(spark, far) == [("A", "class")]


def test_own_decorator_beats_the_window(spark):
    source = "@Injectable()\nexport class A {\n}\n@Module({\n  x: [1]\n})\nexport class B {\n}\n"
    assert js(spark, source) == [("A", "nestjs_injectable"), ("B", "nestjs_module")]


def test_foreign_decorators_take_listed_order(spark):
    assert js(spark, "// @Pipe and @Controller\nclass A {\n}\n") == [("A", "nestjs_controller")]


def test_method_window_reaches_over_class_borders(spark):
    source = "class A {\n  first() {\n    return 1;\n  }\n}\nclass B {\n  @Get()\n  get() {\n  }\n}\n"
    assert ("first", "nestjs_endpoint") in js(spark, source)


def declared(spark, *contents, ext=".ts"):
    return [
        [f"{r.parent}.{r['name']}" if r.parent else r["name"] for r in rows if r.stage == 0]
        for rows in script_rows(spark, contents, ext)
    ]


def test_methods_whatever_their_parameters_and_types(spark):
    source = """
@Controller('x')
export class C {
  constructor(@Inject(forwardRef(() => X)) private x: X) {
    super();
  }
  find(@Query('p', new Pipe({a: f(1)})) p: P) { return {inner(a) { return 1; }}; }
  @Get() one() {
  }
  two(): Map<string, () => void> { const z = () => 1; }
  three(): { a: string } { }
  many(a: string): void
  many(a: any) {}
  value = () => { return 1 };
  other: Map<string, {a: 1}> = new Map()
  static async gen<T extends {a: 1}>(x: T): Promise<{b: T}> { }
  get size() { return 1 }
  #hidden() {}
  'quoted'() {}
  [Symbol.iterator]() {}
  async() {}
}
"""
    assert declared(spark, source) == [["C"] + [
        f"C.{m}" for m in ("constructor", "find", "one", "two", "three", "many", "gen", "size", "async")
    ]]


DECLARATIONS = [
    ("class B { foo() {} bar() {} }", ["B", "B.foo", "B.bar"]),
    ("const p = () => 1, q = () => 2", ["p", "q"]),
    ("const deep = (a = g(h(1))) => a", ["deep"]),
    ("const t: F<{a: 1}> = async (x): Promise<void> => {}", ["t"]),
    ("if (x) { function inIf() {} }", ["inIf"]),
    ("describe('a', () => { const y = () => 1; })", ["y"]),
    ("namespace N { export class K {} }", ["K"]),
    ("(function () { function own() {} })()", ["own"]),
    ("const k = call(() => { const closed = () => 1 })", []),
    ("/* function ghost() {} */ function real() {\nconst hidden = () => 1\n}", ["real"]),
    ("const s = `class T {} ${x} function f() {}`; let r = /function g() {}/", []),
    ("function over(a: string): void;\nfunction over(a: any) {}", ["over"]),
    ("const v = <p>don't</p>\nfunction after() {}", ["after"]),
    ("", []),
    ("}}) function f() {}", ["f"]),
    ("function f(", []),
]


def test_declarations_wherever_they_stand(spark):
    found = declared(spark, *[source for source, _ in DECLARATIONS], ext=".tsx")
    assert found == [expected for _, expected in DECLARATIONS]


def test_deep_nesting_has_no_limit(spark):
    depth = 50_000
    assert declared(
        spark, "{" * depth + "function f() {}" + "}" * depth,
        "a(" * depth + "() => { class C { m() {} } }" + ")" * depth,
    ) == [["f"], ["C", "C.m"]]


def test_reading_is_linear_and_without_recursion(spark):
    long = [
        ("const a = async <b\n" * 20_000, 0), ("/[" * 40_000, 0), ("import 'a'\n" * 20_000, 20_000),
        ("'\\" * 40_000, 0), ("function f(): A" + "\n  | A" * 20_000 + " {}", 1),
        ("const x = 1" + " +\n 1" * 20_000 + ", y = () => 1", 1), ("class A\n" * 20_000, 1),
        ("class A {" + " m() {}" * 20_000 + "}", 20_001), ("const a = [() => 1];\n" * 20_000, 0),
    ]
    start = time.time()
    assert [len(rows) for rows in script_rows(spark, [s for s, _ in long])] == [n for _, n in long]
    assert time.time() - start < 60


def test_scopes_are_lines_of_their_own_tokens():
    assert scopes("if (a) { b('x y', `t ${c} u`) }\n// note\nd < e; f<G>()") == [
        (0, 53, ";\nif#0 (1) {2}\nd#40 < e#44 ; f#47 <5> (6)"),
        (3, 5, ", a#4"), (7, 30, "; b#9 (3)"), (10, 28, ', "x\x01y" , ` $4$'), (21, 24, ", c#23"),
        (48, 50, ", G#49"), (51, 52, ","),
    ]


def test_function_bodies_are_not_descended(spark):
    source = "function outer() {\n  function inner() {\n  }\n  const f = () => 1;\n}\n"
    assert js(spark, source) == [("outer", "function")]


def test_interfaces_only_in_typescript(spark):
    source = "interface A {\n}\ntype B = string;\n"
    assert js(spark, source) == [("A", "interface"), ("B", "type_alias")]
    assert js(spark, source, ".js") == []


def test_typed_arrows_and_noise(spark):
    source = (
        "export const f: (a: number) => void = (a) => {};\n"
        "const g = async <T>(a: T): Promise<T> => a;\n"
        "const window = () => 1;\nlet h = x => x;\nvar old = () => 1;\nconst n = 3;\n"
    )
    assert js(spark, source) == [("f", "function"), ("g", "function"), ("h", "function")]


def test_multiline_parameters_and_control_words(spark):
    source = (
        "class A {\n  constructor(\n    private a: X,\n    b = f(),\n  ) {\n    if (a) {\n"
        "    }\n    while (b) {\n    }\n    go(function () {\n    });\n  }\n  async *gen() {\n  }\n"
        "  abstract nobody(): void;\n}\n"
    )
    assert [n for n, _ in js(spark, source)] == ["A", "constructor", "gen"]


def test_static_imports_only(spark):
    source = (
        "import a from \"x\";\nimport {\n  b,\n  c\n} from 'y';\nimport 'z';\n"
        "const d = import('no');\nconst e = require('no');\nexport * from 'no';\n"
    )
    assert js(spark, source) == [("x", "js"), ("y", "js"), ("z", "js")]


@pytest.mark.parametrize(
    "raw, directory, expected",
    [("./u", "a/b", "a/b/u"), ("../u", "a/b", "a/u"), ("../../u", "a/b", "u"),
     ("../../../u", "a/b", "u"), ("./u", "", "u"), ("../u", "a", "u"), ("./u.", "a", "a/u"),
     ("..", "a", ".."), ("../a/../u", "p/q/r", "p/a/u")],
)
def test_relative_paths(spark, raw, directory, expected):
    df = spark.createDataFrame([(raw, directory)], "r string, d string")
    assert df.select(javascript.relative_path(F.col("r"), F.col("d"))).first()[0] == expected


def test_rule_classes_use_their_own_windows(spark):
    expr = javascript.js_rule_facts(F.col("content"), F.col("ext"), F.col("dir"))
    source = "@Controller()\nclass A {}\n" + "// pad\n" * 70 + "class B { x() { return <p/> } }\nclass c {}\n"
    assert facts_of(spark, expr, source, ".ts") == [
        ("A", "nestjs_controller"), ("B", "react_component"), ("c", "class"),
    ]


def test_rule_noise_meets_lower_case_only(spark):
    expr = javascript.js_rule_facts(F.col("content"), F.col("ext"), F.col("dir"))
    source = "function Promise() {}\nfunction Console() {}\nfunction fetch() {}\n"
    assert facts_of(spark, expr, source, ".ts") == [("Promise", "function")]


# ---------------------------------------------------------------------- Python


def python(spark, content):
    files = spark.createDataFrame(
        [("r", "m.py", "", "m.py", ".py", content)],
        "repo string, file_id string, dir string, name string, ext string, content string",
    )
    rows = parsed.python_facts(files).orderBy("stage", "pos").collect()
    return [(r["name"], r["type"]) for r in rows]


def test_python_order_and_types(spark):
    source = (
        "if x:\n    class A(m.BaseModel): pass\nclass B(BaseModel, y): pass\n"
        "@app.task\ndef one(): pass\n@task\nasync def two(): pass\n@task()\ndef three(): pass\n"
        "@router.delete\ndef test_four(): pass\ndef Test_five(): lambda: 0\n"
    )
    assert python(spark, source) == [
        ("A", "class"), ("B", "pydantic_model"), ("one", "function"), ("two", "async_function"),
        ("three", "function"), ("test_four", "fastapi_endpoint"), ("Test_five", "test"),
    ]


def test_python_fallback_on_any_parse_failure(spark):
    assert python(spark, "def f(:\n  pass\nclass x: pass\nclass Élan: pass\ndef _g(): pass") == [
        ("Élan", "class"), ("f", "function"),
    ]
    assert python(spark, "def f(): pass\n\0") == [("f", "function")]
    deep = "(" * 500 + ")" * 500 + "\ndef f(): pass\n"
    assert python(spark, deep) == [("f", "function")]
    assert python(spark, "") == []


def test_rust_and_ruby_quirks(spark):
    rust = "impl<T> A for T {}\nimpl B {}\nuse self::x;\nuse  a ::b;\n"
    assert facts_of(spark, rules.language_facts("rust", F.col("content")), rust) == [
        ("B", "implements"), ("a ", "module"),
    ]
    ruby = "include Foo\ndef self.bar\nend\n"
    assert facts_of(spark, rules.language_facts("ruby", F.col("content")), ruby) == [
        ("bar", "method"), ("Foo", "includes"),
    ]
