"""The structure job: extract once from the texts, then work on narrow records."""

from pyspark.sql import DataFrame

from ..operators import corpus, extract, graph
from ..session import materialize


def structure(files: DataFrame, *columns: str, **dependency_options) -> DataFrame:
    """Structure records of all files, computed once in the shared folder.

    Extraction reads every text with some thirty patterns, by far the dearest step, and the
    graph operators read their input more than once. Name the columns that are needed and
    the patterns of the others are never run.
    """
    records = extract.extract_structure(corpus.detect_language(files), **dependency_options)
    return materialize(records.select("project", "file_id", *columns) if columns else records)


def project_metrics(files: DataFrame) -> DataFrame:
    """Metrics per project, straight from the files."""
    return graph.project_metrics(structure(files, "n_functions", "is_entry", "db_connections", "api_connections"))


def analyze(files: DataFrame) -> dict[str, DataFrame]:
    """Everything the structure report shows, from one extraction."""
    records = structure(files)
    return {
        "records": records,
        "metrics": graph.project_metrics(records),
        "dependencies": graph.project_dependencies(records),
        "connections": graph.project_connections(records),
        "nodes": graph.nodes(records),
        "edges": graph.edges(records),
        "diagram": graph.graph_lines(records),
        "report": graph.architecture_report(records),
    }
