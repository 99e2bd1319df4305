"""Spark's spelling of every pattern against Python's regex engine on random code-like texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import fixed
from corpusloom.functions.dialect import any_of, java, re2
from corpusloom.operators.extract import all_matches

TOKENS = (
    "function def func fn sub public static const let x get_item main run import from require include use as os "
    "mysql db database connection client session api http https:// example.com foo.io a9.org.net localhost .internal "
    "host= server= password = token= key secret admin root 127.0.0.1 12345 ( ) { } [ ] => -> = : ; , ' \" . / \\ # < > @ & ? * "
    "./x @scope/kit lodash/fp ```mermaid ```markdown ``` <table> </table> <TABLE id=1> é à \u00a0 \u2003 \r \x0b ſ k 9abc _z "
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa if __name__ == '__main__' app.listen express() console.log start"
).split(" ")

SNIPPETS = [
    "function ", "def ", "const f = (a, b) => ", "let g: function (", "public static function h (", "name(a) {", "x9(", ") {",
    "import a, b from 'pkg/sub'", "import \"fmt\"", "import (\n \"a\"\n)", "from os import ", "require('./x')", "require \"y\"", "include_once('z')",
    "#include <stdio.h>", "use std::io;", "import java.util.List;", "host=db01.example.org;", "dbname = x", "mysql://user@server/db", "connect to the_server ",
    "session of db", "api_url = 'https://a.example.com'", "base-url: \"http://xyz.example\"", "```mermaid\ngraph\n```", "```markdown # x ```", "<table><td></table>",
]


def python_regex(pattern: str) -> re.Pattern:
    spelled = re.sub(r"\\x\{([0-9A-F]{4})\}", lambda m: "\\u" + m[1], re2(pattern)).replace(r"\z", r"\Z")
    return re.compile(spelled, re.ASCII)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    parts = TOKENS + SNIPPETS * 3
    made = ["".join(rng.choice(parts) + rng.choice(["", " ", "", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    made += ["", "a", "\n", "import", "function f(", "f(){", "9abc(){", "foo.comx.org", "xhttp://foo.com/", "éapi api"]
    return spark.createDataFrame(list(enumerate(made)), "id int, text string").cache()


EXTRACTED = (
    [(p, 1) for p in fixed.FUNCTION_PATTERNS]
    + [(p, g) for p, n in fixed.DEPENDENCY_PATTERNS for g in range(n + 1)]
    + [(p, 0) for p in fixed.DATABASE_PATTERNS + fixed.API_PATTERNS]
    + fixed.DB_CONNECTION_PATTERNS
    + fixed.API_CONNECTION_PATTERNS
    + [(p, 1) for p in (fixed.DIAGRAM_BLOCK, fixed.MARKDOWN_BLOCK)]
    + [(fixed.HTML_TABLE, 0)]
)


def test_extraction_patterns(texts):
    columns = [all_matches(F.col("text"), p, g).alias(f"c{i}") for i, (p, g) in enumerate(EXTRACTED)]
    regexes = [python_regex(p) for p, _ in EXTRACTED]
    hits = [0] * len(EXTRACTED)
    for row in texts.select("text", *columns).collect():
        for i, (_, group) in enumerate(EXTRACTED):
            expected = [m[group] or "" for m in regexes[i].finditer(row.text)]
            assert row[f"c{i}"] == expected, (EXTRACTED[i], row.text)
            hits[i] += len(expected)
    assert sum(h > 0 for h in hits) > len(hits) * 0.8


def test_predicates(texts):
    lists = [
        fixed.ENTRY_PATTERNS, fixed.INVALID_PACKAGE, fixed.UNSAFE_FUNCTION, fixed.UNSAFE_DEPENDENCY,
        fixed.UNSAFE_CONNECTION, fixed.UNSAFE_ENDPOINT,
    ]
    words = texts.select(F.explode(F.split("text", "[ \n]")).alias("text")).union(texts.select("text")).distinct()
    columns = [F.col("text").rlike(any_of(ps, java)).alias(f"c{i}") for i, ps in enumerate(lists)]
    regexes = [[python_regex(p) for p in ps] for ps in lists]
    for row in words.select("text", *columns).collect():
        for i, alternatives in enumerate(regexes):
            assert row[f"c{i}"] == any(r.search(row.text) for r in alternatives), (i, row.text)


def test_end_anchor_ignores_no_newline(column):
    assert column([("if",), ("if\n",)], "t string", F.col("t").rlike(java("^(?:if|else)$"))) == [True, False]


def test_word_edges_are_ascii(column):
    assert column([("éapi",), ("xapi",)], "t string", F.col("t").rlike(java(fixed.API_PATTERNS[0]))) == [True, False]
