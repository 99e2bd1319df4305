"""The dependency graph of each project, from the records of ``extract_structure``.

Results are rows with explicit order keys, never one collected value per project: a text
such as the diagram is written by sorting its lines at the sink.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, paths, safety, text
from ..functions.fixed import IMPORT_EXTENSIONS, IMPORT_INDEX, MAX_FUNCTIONS_DRAWN
from ..session import materialize
from . import extract
from .corpus import primary_language
from .scale import lookup_join, ordinal


def component_names(records: DataFrame) -> DataFrame:
    return records.select("project", "name").distinct()


def dependency_rows(records: DataFrame) -> DataFrame:
    return records.select("project", "file_id", F.posexplode("dependencies").alias("pos", "dependency"))


def classify_dependencies(records: DataFrame) -> DataFrame:
    """Each dependency of each file, internal when a file of the project has that name."""
    names = component_names(records).select("project", F.col("name").alias("dependency"), F.lit(True).alias("_known"))
    joined = lookup_join(dependency_rows(records), names, ["project", "dependency"], "file_id")
    return joined.withColumn("is_internal", F.coalesce("_known", F.lit(False))).drop("_known")


def internal_dependencies(records: DataFrame) -> DataFrame:
    """Distinct dependencies that are file names of the project."""
    names = component_names(records).withColumnRenamed("name", "dependency")
    return dependency_rows(records).select("project", "dependency").distinct().intersect(names)


def external_dependencies(records: DataFrame) -> DataFrame:
    """Distinct dependencies that are not file names of the project."""
    names = component_names(records).withColumnRenamed("name", "dependency")
    return dependency_rows(records).select("project", "dependency").distinct().subtract(names)


def project_dependencies(records: DataFrame, classified: DataFrame | None = None) -> DataFrame:
    """Distinct dependencies per project, numbered in first-seen order within their kind.

    Repeats are dropped before the join, so a dependency of every file is one row there.
    ``classified``, the kept rows of ``classify_dependencies``, saves that join.
    """
    first = F.min(F.struct("file_id", "pos")).alias("first")
    place = [F.col("first.file_id").alias("first_file_id"), F.col("first.pos").alias("first_pos")]
    if classified is None:
        seen = dependency_rows(records).groupBy("project", "dependency").agg(first).select("project", "dependency", *place)
        names = component_names(records).select("project", F.col("name").alias("dependency"), F.lit("internal").alias("kind"))
        kinds = seen.join(names, ["project", "dependency"], "left").withColumn("kind", F.coalesce("kind", F.lit("external")))
    else:
        kind = F.when(F.bool_or("is_internal"), "internal").otherwise("external").alias("kind")
        kinds = classified.groupBy("project", "dependency").agg(first, kind).select("project", "dependency", *place, "kind")
    return ordinal(kinds, ["project", "kind"], "first_file_id", total="n_unique", within="first_pos")


def project_connections(records: DataFrame) -> DataFrame:
    """Distinct connections per project by name, with where each was first seen."""
    kinds = F.array(
        *[
            F.struct(F.lit(label).alias("type"), F.col(column).alias("names"))
            for label, column in (("Database", "db_connections"), ("API", "api_connections"))
        ]
    )
    rows = records.select("project", "file_id", F.inline(kinds)).select("project", "file_id", "type", F.posexplode("names").alias("pos", "name"))
    return (
        rows.groupBy("project", "type", "name")
        .agg(F.min(F.struct("file_id", "pos")).alias("first"))
        .select("project", "type", "name", F.col("first.file_id").alias("first_file_id"), F.col("first.pos").alias("first_pos"))
    )


def component_counts(records: DataFrame, classified: DataFrame | None = None) -> DataFrame:
    """Functions, internal and external dependencies of each component."""
    classified = classify_dependencies(records) if classified is None else classified
    per_file = classified.groupBy("project", "file_id").agg(
        F.count_if("is_internal").alias("internal_deps"), F.count_if(~F.col("is_internal")).alias("external_deps")
    )
    return (
        records.select("project", "file_id", "name", "type", F.col("n_functions").alias("functions"))
        .join(per_file, ["project", "file_id"], "left")
        .fillna(0, ["internal_deps", "external_deps"])
    )


def project_metrics(records: DataFrame) -> DataFrame:
    """Components, functions, entry points and connections of each project."""
    totals = records.groupBy("project").agg(
        F.count("*").alias("components"),
        F.sum("n_functions").alias("total_functions"),
        F.count_if("is_entry").alias("entry_points"),
    )
    links = project_connections(records).groupBy("project").agg(
        F.count_if(F.col("type") == "Database").alias("db_connections"), F.count_if(F.col("type") == "API").alias("api_connections")
    )
    return totals.join(links, "project", "left").fillna(0, ["db_connections", "api_connections"])


def index_components(records: DataFrame) -> DataFrame:
    """(project, idx, file_id, name, type) with components numbered from 1."""
    numbered = ordinal(records.select("project", "file_id", "name", "type"), ["project"], "file_id")
    return numbered.withColumn("idx", F.col("ord") + 1).drop("ord")


def index_entries(records: DataFrame) -> DataFrame:
    """Entry points numbered from 1 in file order."""
    entries = records.filter("is_entry").select("project", "file_id", "name", F.col("relative_path").alias("file"))
    return ordinal(entries, ["project"], "file_id").withColumn("idx", F.col("ord") + 1).drop("ord")


def indexes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Component and entry numbers, computed once: every part of the graph refers to them."""
    return materialize(index_components(records)), materialize(index_entries(records))


def component_edges(records: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Edges between component numbers; a name held by several files means the last one."""
    components = index_components(records) if components is None else components
    targets = components.groupBy("project", F.col("name").alias("dependency")).agg(F.max("idx").alias("dst"))
    linked = lookup_join(dependency_rows(records), targets, ["project", "dependency"], "file_id", "inner")
    own = components.select("project", "file_id", F.col("idx").alias("src"))
    return linked.join(own, ["project", "file_id"]).filter("src != dst").select("project", "src", "dst", "pos", "dependency")


def import_targets(files: DataFrame) -> DataFrame:
    """(project, target, file_id, target_path): the file that each importable path of a project means.

    A file can be named by its whole path, without its extension, and by its folder when it is the
    folder's index file. Of several candidates the whole path comes first, then the extensions in
    their order, then index files; of equal paths the first file.
    """
    path = F.col("relative_path")
    places = [F.struct(F.lit(0).alias("rank"), path.alias("target"))]
    for n, ext in enumerate(IMPORT_EXTENSIONS):
        bare = F.when(path.endswith(ext), path.substr(F.lit(1), F.length(path) - len(ext)))
        folder = F.when(bare == IMPORT_INDEX, "").otherwise(F.regexp_extract(bare, f"(?s)\\A(.*)/{IMPORT_INDEX}\\z", 1))
        is_index = (bare == IMPORT_INDEX) | bare.endswith(f"/{IMPORT_INDEX}")
        places.append(F.struct(F.lit(1 + n).alias("rank"), bare.alias("target")))
        places.append(F.struct(F.lit(1 + len(IMPORT_EXTENSIONS) + n).alias("rank"), F.when(is_index, folder).alias("target")))
    named = files.select("project", "file_id", "relative_path", F.inline(F.filter(F.array(*places), lambda p: p["target"].isNotNull())))
    best = F.min(F.struct("rank", "file_id", "relative_path")).alias("best")
    return named.groupBy("project", "target").agg(best).select("project", "target", "best.file_id", F.col("best.relative_path").alias("target_path"))


def resolved_imports(files: DataFrame) -> DataFrame:
    """(project, file_id, pos, specifier, target_id, target_path) of every relative import.

    ``files`` needs (project, file_id, relative_path, content). The specifier is folded against the importing
    file's folder and looked up among the project's files by path, not by name. An import of nothing
    known, or of a place outside the project, has no target.
    """
    texts = files.select("project", "file_id", "relative_path", F.posexplode(extract.relative_imports(F.col("content"))).alias("pos", "specifier"))
    folder = paths.dirname(F.col("relative_path"))
    rows = materialize(texts.select("project", "file_id", "pos", "specifier", paths.folded(F.concat_ws("/", folder, "specifier")).alias("target")))
    targets = import_targets(files.select("project", "file_id", "relative_path")).withColumnRenamed("file_id", "target_id")
    return lookup_join(rows, targets, ["project", "target"], "file_id").drop("target")


def start_edges(records: DataFrame, components: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """START to every entry point, and to Main components that no entry point names."""
    components = index_components(records) if components is None else components
    entries = index_entries(records) if entries is None else entries
    names = entries.select("project", "name").distinct().withColumn("_entry", F.lit(True))
    mains = components.filter(classify.is_main_type(F.col("type")))
    loose = lookup_join(mains, names, ["project", "name"], "file_id").filter(F.col("_entry").isNull())
    return entries.select("project", F.lit("entry").alias("target"), "idx", "name").unionByName(
        loose.select("project", F.lit("component").alias("target"), "idx", "name")
    )


def nodes(records: DataFrame) -> DataFrame:
    """Graph nodes: START, entries, components, drawn functions, the rest of them, END."""
    components, entries = indexes(records)
    shape = classify.node_shape(F.col("type"))
    ends = records.select("project").distinct().select(
        "project",
        F.inline(F.array(*[F.struct(F.lit(i).alias("node_id"), F.lit("END" if i == "END" else "START").alias("kind"), F.lit(t).alias("label")) for i, t in (("START", "Start"), ("END", "End"))])),
        F.lit("ENTRY").alias("shape"),
    )
    entry_nodes = entries.select(
        "project", F.concat(F.lit("ENTRY"), "idx").alias("node_id"), F.lit("ENTRY").alias("kind"),
        F.concat(safety.display_name(F.col("name")), F.lit(" (entry point)")).alias("label"), F.lit("ENTRY").alias("shape"),
    )
    component_nodes = components.select(
        "project", F.concat(F.lit("COMP"), "idx").alias("node_id"), F.lit("COMPONENT").alias("kind"),
        _component_label().alias("label"), shape["shape"].alias("shape"),
    )
    function_nodes = _function_rows(records, components).select(
        "project", F.concat(F.lit("FUNC"), "idx", F.lit("_"), "slot").alias("node_id"), F.lit("FUNCTION").alias("kind"),
        "label", F.lit("DEFAULT").alias("shape"),
    )
    return ends.unionByName(entry_nodes).unionByName(component_nodes).unionByName(function_nodes)


def edges(records: DataFrame) -> DataFrame:
    """All graph edges as (project, src, dst, kind)."""
    components, entries = indexes(records)
    comp = F.concat(F.lit("COMP"), F.col("idx"))
    starts = start_edges(records, components, entries).select(
        "project", F.lit("START").alias("src"),
        F.concat(F.when(F.col("target") == "entry", "ENTRY").otherwise("COMP"), "idx").alias("dst"), F.lit("start").alias("kind"),
    )
    deps = component_edges(records, components).select(
        "project", F.concat(F.lit("COMP"), "src").alias("src"), F.concat(F.lit("COMP"), "dst").alias("dst"), F.lit("dependency").alias("kind")
    )
    functions = _function_rows(records, components).select(
        "project", comp.alias("src"), F.concat(F.lit("FUNC"), "idx", F.lit("_"), "slot").alias("dst"), F.lit("function").alias("kind")
    )
    ends = components.select("project", comp.alias("src"), F.lit("END").alias("dst"), F.lit("end").alias("kind"))
    return starts.unionByName(deps).unionByName(functions).unionByName(ends)


def _component_label() -> Column:
    return F.concat(safety.display_name(F.col("name")), F.lit(" - "), text.literal_replace(F.col("type"), '"', '\\"'))


def _function_rows(records: DataFrame, components: DataFrame) -> DataFrame:
    """The first functions of each component and one row for the remainder."""
    shown = F.transform(
        F.slice("functions", 1, MAX_FUNCTIONS_DRAWN),
        lambda f, i: F.struct((i + 1).cast("string").alias("slot"), F.concat(safety.display_name(f["name"]), F.lit("()")).alias("label")),
    )
    extra = F.col("n_functions") - MAX_FUNCTIONS_DRAWN
    more = F.array(F.struct(F.lit("MORE").alias("slot"), F.concat(extra.cast("string"), F.lit(" more funcs")).alias("label")))
    drawn = records.select("project", "file_id", F.when(extra > 0, F.concat(shown, more)).otherwise(shown).alias("_drawn")).filter(F.size("_drawn") > 0)
    return components.join(drawn, ["project", "file_id"]).select("project", "idx", F.posexplode("_drawn").alias("slot_no", "_f")).select(
        "project", "idx", "slot_no", "_f.slot", "_f.label"
    )


def graph_lines(records: DataFrame) -> DataFrame:
    """The diagram as lines; (section, i, j, k) is their order within a project."""
    components, entries = indexes(records)
    comp = F.concat(F.lit("    COMP"), F.col("idx"))
    shape = classify.node_shape(F.col("type"))

    def rows(df: DataFrame, section: int, line: Column, i="idx", j=0, k=0) -> DataFrame:
        def key(value):
            return F.col(value).cast("long") if isinstance(value, str) else F.lit(value).cast("long")

        return df.select("project", F.lit(section).alias("section"), key(i).alias("i"), key(j).alias("j"), key(k).alias("k"), line.alias("line"))

    projects = records.select("project").distinct()
    starts = start_edges(records, components, entries).filter("target = 'component'")
    parts = [
        rows(projects, 0, F.lit("flowchart TD"), 0),
        rows(projects, 1, F.lit('    START[("Start")]'), 0),
        rows(
            entries, 2,
            F.concat(F.lit("    ENTRY"), "idx", F.lit('[("'), safety.display_name(F.col("name")), F.lit(' (entry point)")]')),
        ),
        rows(entries, 2, F.concat(F.lit("    START --> ENTRY"), "idx"), j=1),
        rows(components, 3, F.concat(comp, shape["open"], _component_label(), shape["close"])),
        rows(starts, 3, F.concat(F.lit("    START --> COMP"), "idx"), j=1),
        rows(
            component_edges(records, components), 3, F.concat(F.lit("COMP"), "src", F.lit(" --> COMP"), "dst"), "src", 2, "pos"
        ),
        rows(
            _function_rows(records, components), 3,
            F.concat(comp, F.lit(" --> FUNC"), "idx", F.lit("_"), "slot", F.lit('["'), "label", F.lit('"]')), j=3, k="slot_no",
        ),
        rows(projects, 4, F.lit('    END[("End")]'), 0),
        rows(components, 5, F.concat(comp, F.lit(" --> END"))),
    ]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines


def component_summary(records: DataFrame) -> DataFrame:
    """Numbered text line for each component."""
    numbered = ordinal(component_counts(records), ["project"], "file_id").withColumn("idx", F.col("ord") + 1)
    line = F.format_string(
        "%d. **%s** (%s) - %d functions, %d internal deps, %d external deps",
        "idx", "name", "type", "functions", "internal_deps", "external_deps",
    )
    return numbered.select("project", "idx", line.alias("line"))


def dependency_summary(records: DataFrame, per_part: int = 1000) -> DataFrame:
    """Count and list of dependencies per project and kind.

    A list longer than ``per_part`` goes on in further parts, so no value grows without
    bound; putting the parts together in order gives the whole text.
    """
    listed = project_dependencies(records).withColumn("shown", text.plain_label(F.col("dependency")))
    tag = F.concat(F.lit("<code>"), "shown", F.lit("</code>"))
    parts = (
        listed.withColumn("part", F.floor(F.col("ord") / per_part).cast("long"))
        .groupBy("project", "kind", "part")
        .agg(F.max("n_unique").alias("n_unique"), F.array_sort(F.collect_list(F.struct("ord", tag.alias("tag")))).alias("tags"))
        .withColumn("body", F.array_join("tags.tag", ", "))
    )
    kinds = records.select("project").distinct().select("project", F.explode(F.array(F.lit("external"), F.lit("internal"))).alias("kind"))
    heading = F.concat(F.lit("**"), F.initcap("kind"), F.lit(" Dependencies"))
    counted = F.concat(heading, F.lit(" ("), F.col("n_unique").cast("string"), F.lit(" unique):** "), "body")
    return (
        kinds.join(parts, ["project", "kind"], "left")
        .select(
            "project", "kind", F.coalesce("part", F.lit(0)).cast("long").alias("part"),
            F.when(F.col("n_unique").isNull(), F.concat(heading, F.lit(":** None detected")))
            .when(F.col("part") == 0, counted)
            .otherwise(F.concat(F.lit(", "), "body"))
            .alias("text"),
        )
    )


#: What ``architecture_report`` reads of the records, to be named to ``plans.structure.structure``.
REPORT_COLUMNS = ("language", "name", "type", "n_functions", "dependencies", "is_entry", "db_connections", "api_connections")


def architecture_report(records: DataFrame) -> DataFrame:
    """The component report as ordered rows: title, component table, badges, metrics."""
    classified = materialize(classify_dependencies(records))

    def cells(*values: Column) -> Column:
        return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), v.cast("string"), F.lit("</td>")) for v in values], F.lit("</tr>"))

    def rows(df: DataFrame, section: str, no: int, ord_: Column, html: Column) -> DataFrame:
        return df.select("project", F.lit(no).alias("section_no"), F.lit(section).alias("section"), ord_.cast("long").alias("ord"), html.alias("html"))

    title = rows(
        primary_language(records), "overview", 0, F.lit(0),
        F.concat(F.lit("<h1>Project structure ("), F.upper("language"), F.lit(")</h1>")),
    )
    components = ordinal(materialize(component_counts(records, classified)), ["project"], "file_id")
    table = rows(
        components, "components", 1, F.col("ord"),
        cells(
            text.escape_html(F.col("name")), F.col("type"), F.col("functions"),
            F.concat(F.col("internal_deps").cast("string"), F.lit(" int")), F.concat(F.col("external_deps").cast("string"), F.lit(" ext")),
        ),
    )
    deps = project_dependencies(records, classified)
    badges = rows(
        deps, "dependencies", 2, F.col("ord") * 2 + F.when(F.col("kind") == "external", 0).otherwise(1),
        F.concat(F.lit('<span class="'), "kind", F.lit('"><code>'), text.plain_label(F.col("dependency")), F.lit("</code></span>")),
    )
    measures = ["entry_points", "db_connections", "api_connections", "total_functions", "components"]
    metrics = rows(
        project_metrics(records).select(
            "project", F.posexplode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("v")) for m in measures])).alias("no", "f")
        ),
        "metrics", 3, F.col("no"), cells(F.col("f.m"), F.col("f.v")),
    )
    return title.unionByName(table).unionByName(badges).unionByName(metrics)
