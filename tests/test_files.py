import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from corpusloom.functions import paths
from corpusloom.operators import corpus
from corpusloom.sources import files as source


@pytest.fixture
def tree(tmp_path):
    def put(name, content=b"x = 1\n"):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)

    put("file1.js", b'console.log("test");')
    put("src/file2.py")
    put("src/Big.JAVA", b"a" * 3000)
    put("src/blog/post.js")
    put("notes.txt")
    put("debug.log")
    put("node_modules/pkg/a.js")
    put(".git/b.js")
    put("corpusloom-output.js")
    put("src/bad.go", b"ok \xff\xfe end")
    put("my dir/sp ace.ts")
    put("pkg/__init__.py")
    put("_private/deep/_x.js")
    put("_private/y.js")
    put("pkg/_[id].js")
    put(".hidden/_z.js")
    put(".gitignore", b"# rules\n_private/\n\n!_private/y.js\n")
    return str(tmp_path)


def names(df):
    return sorted(r.relative_path for r in df.select("relative_path").collect())


SCANNED = [
    "file1.js", "my dir/sp ace.ts", "pkg/_[id].js", "pkg/__init__.py",
    "src/Big.JAVA", "src/bad.go", "src/blog/post.js", "src/file2.py",
]
EXCLUDE = ["node_modules", ".git", "*.log"]


def test_scan_directory(spark, tree):
    found = source.scan_files(spark, tree, excludes=EXCLUDE)
    assert names(found) == SCANNED
    row = found.filter("relative_path = 'file1.js'").first()
    assert row.file_size == 20 and row.content == 'console.log("test");'


def test_default_excludes_are_substrings_of_the_path(spark, tree):
    assert "src/blog/post.js" not in names(source.scan_files(spark, tree))
    listed = spark.createDataFrame([("src/blog/x.js",), ("src/log/x.js",), ("a.test.js",)], "relative_path string")
    assert names(corpus.include_files(listed)) == []
    assert names(corpus.include_files(listed, match="segment")) == ["src/blog/x.js"]


def test_size_limit_drops_large_files(spark, tree):
    small = source.scan_files(spark, tree, excludes=EXCLUDE, max_mb=0.002)
    assert "src/Big.JAVA" not in names(small) and "file1.js" in names(small)
    assert source.count_files(spark, tree, excludes=EXCLUDE) == len(SCANNED)


def test_rules_are_applied_before_contents_are_read(spark, tree, monkeypatch):
    listed = source.list_files(spark, [tree], F.col("length") <= 2000)
    assert "src/Big.JAVA" not in names(listed) and "src/file2.py" in names(listed)
    read = source.storage.read_bytes
    monkeypatch.setattr(source.storage, "read_bytes", lambda path: read(path) if path.endswith(".gitignore") else 1 / 0)
    assert source.count_files(spark, tree, excludes=EXCLUDE) == len(SCANNED)


def test_single_file_and_force(spark, tree):
    assert names(source.scan_files(spark, f"{tree}/notes.txt")) == []
    assert names(source.scan_files(spark, f"{tree}/notes.txt", force=True)) == ["notes.txt"]
    assert names(source.scan_files(spark, f"{tree}/corpusloom-output.js", force=True)) == []


def test_several_paths_keep_duplicates_and_ids_differ(spark, tree):
    both = source.scan_files(spark, [f"{tree}/src", f"{tree}/src/file2.py"], excludes=EXCLUDE)
    assert names(both) == ["Big.JAVA", "bad.go", "blog/post.js", "file2.py", "file2.py"]
    assert both.select("file_id").distinct().count() == 5


def test_missing_path(spark, tree):
    with pytest.raises(AnalysisException):
        source.scan_files(spark, f"{tree}/none").count()
    assert source.count_files(spark, f"{tree}/none") == 0


def test_bad_bytes_are_replaced(spark, tree):
    row = source.scan_files(spark, tree, excludes=EXCLUDE).filter("relative_path = 'src/bad.go'").first()
    assert row.content == "ok \ufffd\ufffd end"


def test_ignore_rules_last_match_wins(spark, tree):
    kept = source.scan_files(spark, tree, excludes=EXCLUDE, ignore_rules=["src/*", "!src/*.py", "/file1.js", "_*"], ignore_files=False)
    assert names(kept) == ["my dir/sp ace.ts", "src/file2.py"]
    rules = source.load_ignore_rules(f"{tree}/.gitignore")
    assert rules == ["_private/", "!_private/y.js"]
    assert names(source.scan_files(spark, tree, excludes=EXCLUDE, ignore_rules=rules, ignore_files=False)) == SCANNED
    assert names(source.scan_files(spark, tree, excludes=EXCLUDE, ignore_files=False)) == ["_private/deep/_x.js", "_private/y.js", *SCANNED]


def test_path_order(spark, tree):
    ordered = source.scan_files(spark, tree, excludes=EXCLUDE, in_order=True)
    rows = sorted((r.file_id, r.relative_path) for r in ordered.select("file_id", "relative_path").collect())
    assert [r[0] for r in rows] == list(range(len(SCANNED))) and [r[1] for r in rows] == names(ordered)


def test_languages(spark):
    rows = [("a.js",), ("a.TSX",), ("a.xyz",), ("Makefile",), (".bashrc",), ("x.py",)]
    found = corpus.detect_language(spark.createDataFrame(rows, "relative_path string"))
    assert {r.relative_path: r.language for r in found.collect()} == {
        "a.js": "javascript", "a.TSX": "typescript", "a.xyz": "plaintext", "Makefile": "plaintext", ".bashrc": "plaintext", "x.py": "python",
    }
    assert corpus.languages(spark).count() == 97


@pytest.mark.parametrize(
    "path, base, directory, suffix, stem",
    [
        ("a/b/c.tar.GZ", "c.tar.GZ", "a/b", ".gz", "c.tar"),
        ("c.js", "c.js", ".", ".js", "c"),
        (".bashrc", ".bashrc", ".", "", ".bashrc"),
        ("a/..", "..", "a", "", ".."),
        ("a.", "a.", ".", ".", "a"),
        ("/x.py", "x.py", "/", ".py", "x"),
        ("a/b/", "b", "a", "", "b"),
        ("a//b.c", "b.c", "a/", ".c", "b"),
    ],
)
def test_path_parts(column, path, base, directory, suffix, stem):
    p = F.col("p")
    parts = F.array(paths.basename(p), paths.dirname(p), paths.extension(p), paths.stem(p))
    assert column([(path,)], "p string", parts) == [[base, directory, suffix, stem]]


def test_wildcards_all_apply_and_escape(column):
    p = F.col("p")
    rows = [("d/a.log",), ("d/alog",), ("x.env.local",), ("d.log/a.js",)]
    assert column(rows, "p string", paths.exclude_glob(p, ["x", "*.log", "y", "*.env.*"])) == [True, False, True, False]


def put(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def test_ignore_files_apply_below_their_folder(spark, tmp_path):
    listed = ["a.js", "keep/a.js", "keep/b.js", "out/x.js", "sub/a.js", "sub/out/x.js", "sub/deep/c.js", "sub/deep/d.js", ".hidden/e.js", "lone.js"]
    put(tmp_path, dict.fromkeys(listed, "x"))
    put(tmp_path, {".gitignore": "# comment\nout/\n/lone.js\n\n", "keep/.gitignore": "a.js\n", "sub/.gitignore": "deep/*\n!deep/d.js\n!out/\n", ".hidden/.gitignore": "*\n"})
    assert names(source.scan_files(spark, str(tmp_path), project="p")) == ["a.js", "keep/b.js", "sub/a.js", "sub/deep/d.js", "sub/out/x.js"]
    assert source.scan_files(spark, str(tmp_path), project="p", ignore_files=False).count() == len(listed) - 1


def test_nothing_below_an_ignored_folder_comes_back(spark, tmp_path):
    put(tmp_path, dict.fromkeys(["build/keep.js", "build/in/deep.js", "x/y/z.js", "x/y.js", "x/w.js", "big/a.js", "big/b.js", "c.js"], "x" * 2000))
    put(tmp_path, {".gitignore": "build/\n!build/keep.js\n!build/in/\nbig/*\n!big/b.js\n", "build/.gitignore": "!*\n", "x/.gitignore": "y/\n", "x/y/.gitignore": "!z.js\n"})
    kept = ["big/b.js", "c.js", "x/w.js", "x/y.js"]
    assert names(source.scan_files(spark, str(tmp_path))) == kept
    assert source.count_files(spark, str(tmp_path)) == len(kept)
    skipped = source.skipped_files(spark, str(tmp_path), max_mb=0.001).collect()
    assert sorted(r.path.removeprefix(f"file:{tmp_path}/") for r in skipped) == kept
    rules = ["build/", "!build/keep.js", "!build/in/", "big/*", "!big/b.js", "y/", "!z.js"]
    assert names(source.scan_files(spark, str(tmp_path), ignore_files=False, ignore_rules=rules)) == kept
    everything = source.scan_files(spark, str(tmp_path), ignore_files=False).select("relative_path")
    assert names(corpus.apply_ignore_rules(everything, rules)) == kept


@pytest.mark.parametrize(
    ("rule", "yes", "no"),
    [
        ("*.log", ["a.log", "x/a.log", "a.log/"], ["a.logs", "log"]),
        ("out/", ["out/", "x/out/"], ["out", "outer/"]),
        ("/a.js", ["a.js"], ["x/a.js"]),
        ("x/*", ["x/a", "x/a/"], ["x/", "x/a/b"]),
        ("x/*.js", ["x/a.js"], ["x/y/a.js", "z/x/a.js"]),
        ("**/foo", ["foo", "a/b/foo/"], ["food"]),
        ("abc/**", ["abc/x", "abc/x/y/"], ["abc/", "abc"]),
        ("a/**/b", ["a/b", "a/x/y/b"], ["ab", "a/xb"]),
        ("f?o[0-9]", ["foo1", "x/fzo9"], ["f/o1", "fooa"]),
        ("[!a]b", ["cb"], ["ab", "/b"]),
        (r"\#x", ["#x"], ["x"]),
        (r"!\!x", ["!x"], ["x"]),
        ("a+b(c)", ["a+b(c)"], ["aab(c)"]),
        ("a:b", ["a:b", "x/a:b/"], ["a"]),
    ],
)
def test_ignore_patterns_mean_the_same_in_java_and_python(column, rule, yes, no):
    pattern, ignored = paths.ignore_pattern(rule)
    assert ignored != rule.startswith("!")
    import re

    assert [bool(re.fullmatch(pattern, p, re.S)) for p in yes + no] == [True] * len(yes) + [False] * len(no)
    assert column([(p,) for p in yes + no], "p string", F.col("p").rlike(rf"(?s)\A(?:{pattern})\z")) == [True] * len(yes) + [False] * len(no)


def test_files_left_out_for_their_size_are_told(spark, tmp_path):
    put(tmp_path, {"big.js": "x" * 3000, "small.js": "x", "big.txt.bin": "x" * 3000})
    found = source.skipped_files(spark, str(tmp_path), max_mb=0.001).collect()
    assert [(r.path.rsplit("/", 1)[-1], r.size) for r in found] == [("big.js", 3000)]


@pytest.mark.parametrize("limit", [20_000, 1])
def test_any_number_of_ignore_files_can_be_scanned(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(source, "LISTED", limit)
    put(tmp_path, {".gitignore": "*.tmp.js\nlost/\n"})
    for k in range(12):
        put(tmp_path / f"repo{k}", dict.fromkeys(["a.js", "b.js", "c.tmp.js", "_d.js", "in/a.js", "in/e.tmp.js", "lost/x.js"], "x"))
        put(tmp_path / f"repo{k}", {".gitignore": "/a.js\n!c.tmp.js\n_d.js\n" if k % 2 else "b.js\n!b.js\n*\n!in/\n!in/*\n", "in/.gitignore": "a.js\n!e.tmp.js\n" if k % 3 else "# none\n"})
    found = names(source.scan_files(spark, str(tmp_path), project="p", excludes=[], ignore_rules=["b.js"]))
    expected = []
    for k in range(12):
        kept = {"c.tmp.js", "in/a.js"} if k % 2 else {"in/a.js", "in/e.tmp.js"}
        kept = (kept - {"in/a.js"} | {"in/e.tmp.js"}) if k % 3 else kept
        expected += [f"repo{k}/{name}" for name in kept]
    assert found == sorted(expected)


def test_names_with_colons_and_links(spark, tmp_path):
    put(tmp_path, {"a:b.js": "colon", "file:/c.js": "scheme", "x:y/z.js": "folder", "100%.js": "percent", "deep/in/d.js": "d"})
    (tmp_path / "deep" / "back").symlink_to(tmp_path / "deep")
    (tmp_path / "other").symlink_to(tmp_path / "x:y")
    (tmp_path / "broken.js").symlink_to(tmp_path / "none.js")
    found = source.scan_files(spark, str(tmp_path)).select("relative_path", "content").collect()
    assert sorted(map(tuple, found)) == [("100%.js", "percent"), ("a:b.js", "colon"), ("deep/in/d.js", "d"), ("file:/c.js", "scheme"), ("other/z.js", "folder"), ("x:y/z.js", "folder")]
    assert source.storage.read_bytes(str(tmp_path / "a:b.js")) == source.storage.read_bytes(f"file:{tmp_path}/a:b.js") == b"colon"
    assert names(source.scan_files(spark, str(tmp_path / "x:y"))) == ["z.js"]


@pytest.mark.parametrize(
    ("path", "parts"),
    [
        ("/x/a:b", ("file", "", "/x/a:b")), ("a:b", ("file", "", "a:b")), ("file:/x:y", ("file", "", "/x:y")), ("file:///x", ("file", "", "/x")),
        ("s3a://bucket/a:b/c", ("s3a", "bucket", "/a:b/c")), ("hdfs://host:9000/x", ("hdfs", "host:9000", "/x")), ("gs://b", ("gs", "b", "/")),
    ],
)
def test_schemes(path, parts):
    assert source.storage.split(path) == parts


def test_a_large_tree_sends_the_driver_counts_only(spark, tmp_path, monkeypatch):
    for k in range(200):
        folder = tmp_path / f"p{k % 10}" / f"d{k}"
        folder.mkdir(parents=True)
        for n in range(500):
            (folder / f"f{n}.js").touch()
    brought = []
    for kind, name in ((type(spark.range(1)), "collect"), (type(spark.range(1)), "toPandas")):
        whole = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda self, whole=whole: (lambda rows: (brought.append(len(rows)), rows)[1])(whole(self)))
    assert source.count_files(spark, str(tmp_path)) == 100_000
    listed = source.list_files(spark, [str(tmp_path)])
    assert listed.select("path").distinct().count() == 100_000
    assert sum(brought) <= 20 and "LocalTableScan" not in listed.filter("number = 0")._jdf.queryExecution().executedPlan().toString().split("Union")[-1]
