import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import classify, nested, paths, prompting, safety, text


def test_tokens(column):
    rows = [("",), ("test",), ("x" * 21,), ("a😀",), (None,)]
    assert column(rows, "t string", prompting.estimate_tokens(F.col("t"))) == [0, 1, 6, 1, 0]
    assert column([("a😀",)], "t string", prompting.utf16_length(F.col("t"))) == [3]
    counted = prompting.estimate_tokens(F.col("t"), F.col("p"), F.col("c"), F.col("n"))
    assert column([("abc", 10, 5, 99), ("abc", 10, None, 99), ("abc", None, None, None)], "t string, p int, c int, n int", counted) == [15, 99, 1]


def test_render_is_literal_and_not_rescanned(column):
    template = "{{a}} and {{a}} then {{b}} {{c}} {{{a}}}"
    got = column([(template, "$& \\1 {{b}}", "v")], "t string, a string, b string", prompting.render(F.col("t"), {"a": F.col("a"), "b": F.col("b")}))
    assert got == ["$& \\1 {{b}} and $& \\1 {{b}} then v {{c}} {$& \\1 {{b}}}"]


def test_cache_key_names_missing_parts(column):
    import hashlib

    key = prompting.cache_key(F.col("p"), F.lit("explain"), F.lit(None), F.lit("x"), F.lit(None))
    assert column([("a.js",)], "p string", key) == [hashlib.md5(b"a.js-explain-undefined-x-undefined").hexdigest()]


@pytest.mark.parametrize(
    "size, shown",
    [(0, "0 Bytes"), (1, "1 Bytes"), (1023, "1023 Bytes"), (1024, "1 KB"), (1536, "1.5 KB"), (1_048_576, "1 MB"), (1_234_567, "1.18 MB"),
     (10 * 1024**3, "10 GB"), (5 * 1024**4, "5 TB"), (100 * 1024, "100 KB")],
)
def test_format_bytes(column, size, shown):
    assert column([(size,)], "n long", text.format_bytes(F.col("n"))) == [shown]


def test_small_text_functions(column):
    t = F.col("t")
    assert column([("myFileName2X",)], "t string", text.kebab(t)) == ["my-file-name2-x"]
    assert column([("abc def",), ("",)], "t string", text.capitalize_first(t)) == ["Abc def", ""]
    assert column([("abcdef",), ("abc",)], "t string", text.truncate(t, 5)) == ["ab...", "abc"]
    assert column([("""<a href="x">'&</a>""",)], "t string", text.escape_html(t)) == ["&lt;a href=&quot;x&quot;&gt;&#039;&amp;&lt;/a&gt;"]
    assert column([("a.b*c[d]\\",)], "t string", text.escape_regex(t)) == ["a\\.b\\*c\\[d\\]\\\\"]
    assert column([("\u00a0 <b>x</b>\n",)], "t string", text.strip_tags(t)) == ["x"]
    assert column([("a\r\nb\rc\n",)], "t string", text.unix_newlines(t)) == ["a\nb\nc"]
    assert column([("",), (None,), ("x",)], "t string", text.coalesce_body(t)) == ["No explanation available."] * 2 + ["x"]
    assert column([("graph TD",), ("  ",), ("hello",)], "t string", text.is_valid_diagram(t)) == [True, False, False]
    assert column([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "t array<string>", text.human_list(t)) == ["", "a", "a and b", "a, b, and c"]


def test_classification(column):
    both = F.col("p"), F.col("t")
    rows = [("src/UserController.js", ""), ("a/x.js", "class A"), ("a/x.js", "def f"), ("a/x.js", "protocol P"), ("a/x.js", ""), ("main.go", "class A")]
    assert column(rows, "p string, t string", classify.component_type(*both)) == ["Controller", "Class", "Function", "Interface", "Component", "Main"]
    entries = [("index", ""), ("App.tsx", ""), ("x.rs", "fn main ()"), ("x.c", "int  main("), ("x.js", "app.listen(1)"), ("x.js", "domain(1)"), ("x.js", "nothing")]
    assert column(entries, "p string, t string", classify.is_entry_point(*both)) == [True, True, True, True, True, False, False]
    kinds = [("fetchAll", ""), ("saveX", ""), ("onProcess", ""), ("checkIt", ""), ("formatX", ""), ("boo", "boo() { await x }"), ("boo", "boo = (a) => a"), ("boo", "x")]
    assert column(kinds, "p string, t string", classify.function_type(*both)) == [
        "getter", "setter", "handler", "validator", "converter", "async-function", "arrow-function", "function",
    ]
    purposes = [("api/x.js", "def f"), ("api/x.js", "text"), ("lib/main_loop.py", "def f")]
    assert column(purposes, "p string, t string", classify.purpose(*both)) == [
        "Handles external API communications", "Contains code for x module", "Application entry point and main initialization",
    ]


def test_safety(column):
    t = F.col("t")
    assert column([("db01.example.org",), ("host 1234",), ("my.local",), ("a" * 32,), ("root",)], "t string", safety.is_safe_connection(t)) == [True] + [False] * 4
    assert column([("a=1&password = x1, token=abc",)], "t string", safety.sanitize_connection(t)) == ["Database Connection"]
    assert column([("https://x.org/keys/1",), ("https://x.org/admin",), ("https://x.org?token=9&b=1",)], "t string", safety.sanitize_endpoint(t)) == [
        "https://x.org/***/1", "API Endpoint", "https://x.org?***=***&b=1",
    ]
    assert column([('say "key"\nmonkey',)], "t string", safety.display_name(t)) == ['say \\"***\\" monkey']
    assert column([("lodash",), ("a b",), ("if",), ("x;",), ("..",), ("",), ("y" * 100,)], "t string", safety.is_valid_package(t)) == [True] + [False] * 6


def test_path_labels(column):
    label = paths.path_labels(F.col("t"), "Report")
    assert column([("Report: a/b.js, c\\d.py",), ("Other",)], "t string", label) == ["Report: b.js, d.py", "Other"]


def test_merge_maps_and_structs(spark, column):
    merged = nested.merge_maps(F.col("a"), F.col("b"))
    assert column([({"x": "1", "y": "2"}, {"y": "3", "z": "4"}), (None, {"y": "3"})], "a map<string,string>, b map<string,string>", merged) == [
        {"x": "1", "y": "3", "z": "4"}, {"y": "3"},
    ]
    df = spark.createDataFrame(
        [((1, (2, [1, 2])), ((None, [9]), "n"))], "l struct<a:int,b:struct<c:int,d:array<int>>>, r struct<b:struct<c:int,d:array<int>>,e:string>"
    )
    out = df.select(nested.deep_merge(F.col("l"), F.col("r"), df.schema["l"].dataType, df.schema["r"].dataType).alias("m")).first().m
    assert (out.a, out.b.c, out.b.d, out.e) == (1, 2, [9], "n")


def merged(left, right, top=True):
    """What merging two JSON values of any shape gives."""
    if right is ABSENT or (top and isinstance(left, dict) and not isinstance(right, dict | list)):
        return left
    if isinstance(right, dict):
        left = left if isinstance(left, dict) else {}
        return {k: merged(left.get(k, ABSENT), right.get(k, ABSENT), False) for k in {**left, **right}}
    return right


ABSENT = object()


def some_json(chance, depth=4):
    kind = chance.random()
    if depth and kind < 0.6:
        return {chance.choice("abcd"): some_json(chance, depth - 1) for _ in range(chance.randint(0, 4))}
    return chance.choice([None, 0, 7, -1.5, "", "text", True, False, [], [1, {"a": 2}], ["x"]])


def test_merge_variants_of_any_shape(spark):
    chance = random.Random(6)
    pairs = [(n, some_json(chance), some_json(chance)) for n in range(400)]
    rows = [(n, json.dumps(a), json.dumps(b)) for n, a, b in pairs] + [(-1, None, "{}"), (-2, "[1]", None), (-3, None, None)]
    df = spark.createDataFrame(rows, "n int, a string, b string").select("n", F.to_json(nested.merge_variants(F.parse_json("a"), F.parse_json("b"))).alias("m"))
    got = {r.n: r.m for r in df.collect()}
    assert (got[-1], got[-2], got[-3]) == ("{}", "[1]", None)
    for n, a, b in pairs:
        assert json.loads(got[n]) == merged(a, b)


def test_merge_variants_tells_what_is_too_deep(spark):
    deep = '{"a":' * 5 + '{"x":1}' + "}" * 5
    df = spark.createDataFrame([(deep, deep.replace("x", "y"))], "a string, b string").select(F.parse_json("a").alias("a"), F.parse_json("b").alias("b"))
    assert '"x":1,"y":1' in df.select(F.to_json(nested.merge_variants(F.col("a"), F.col("b"), levels=6))).first()[0]
    with pytest.raises(Exception, match="deeper than 3 levels"):
        df.select(F.to_json(nested.merge_variants(F.col("a"), F.col("b"), levels=3))).collect()


def test_folded_paths(column):
    given = ["a/./b", "a//b/", "a/../b", "../a", "a/../../b", ".", "", "a/b/../../c", "/x", "a/.../b"]
    assert column([(p,) for p in given], "p string", paths.folded(F.col("p"))) == ["a/b", "a/b", "b", None, None, "", "", "c", "x", "a/.../b"]
