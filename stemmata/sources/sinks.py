"""Outputs: CSV, SQLite, N-Triples, JSON-LD, NDJSON, TSV and a report."""

from __future__ import annotations

import json
import sqlite3

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lod


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Sorted, with a header, booleans as True and False."""
    cols = [F.initcap(F.col(c).cast("string")).alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes]
    df.orderBy(*order).select(*cols).write.mode("overwrite").csv(path, header=True)


def write_sqlite(authors: DataFrame, works: DataFrame, path: str, name: str = "author_name_latin") -> None:
    """Tables authors and works, dropped and made anew; rows arrive partition by partition.

    One writer on the driver, as SQLite has; meant for an index of authors, not for texts.
    """
    with sqlite3.connect(path) as db:
        for table, df, key in (("authors", authors, ["author_id"]), ("works", works, ["author_id", "work_id"])):
            cols = df.columns
            db.execute(f"drop table if exists {table}")
            db.execute(f"create table {table} ({', '.join(cols)}, primary key ({', '.join(key)}))")
            marks = ", ".join("?" * len(cols))
            rows = (tuple(";".join(v) if isinstance(v, list) else v for v in r) for r in df.toLocalIterator(prefetchPartitions=True))
            db.executemany(f"insert into {table} values ({marks})", rows)
        db.execute("create index works_author on works (author_id)")
        db.execute(f"create index authors_name on authors ({name})")


def write_ntriples(triples: DataFrame, path: str, comment: str | None = None) -> None:
    """Lines of all triples; a comment goes into the first part file."""
    lines = lod.ntriples(triples)
    if comment:
        lines = triples.sparkSession.createDataFrame([(f"# {comment}",)], "line string").coalesce(1).unionByName(lines)
    lines.write.mode("overwrite").text(path)


def write_json(documents: DataFrame, path: str) -> None:
    """One JSON object of (author_id, node) documents, keyed by author; they stream to the driver in order."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("{")
        for i, r in enumerate(documents.orderBy("author_id").toLocalIterator(prefetchPartitions=True)):
            f.write((",\n" if i else "\n") + json.dumps(r["author_id"]) + ": " + r["node"])
        f.write("\n}\n")


def write_jsonld(nodes: DataFrame, path: str, context: dict, head: list[dict] = ()) -> None:
    """One document: the nodes of ``head`` (source and scheme), then authors, which stream to the driver in order."""
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"@context": ' + json.dumps(context) + ', "@graph": [\n')
        f.write(",\n".join(json.dumps(n, ensure_ascii=False) for n in head))
        for i, r in enumerate(nodes.orderBy("author_id").toLocalIterator()):
            f.write((",\n" if i or head else "") + r["node"])
        f.write("\n]}\n")


def ndjson(events: DataFrame):
    """Lines of an event stream (seq, t, payload), in order, as they become available."""
    for r in events.orderBy("seq").toLocalIterator(prefetchPartitions=True):
        yield json.dumps({"t": r["t"], **json.loads(r["payload"])}, ensure_ascii=False)


def write_tsv(lines: DataFrame, path: str, preamble: list[str], header: list[str]) -> None:
    """``# `` preamble, header, then the lines of ``Compare.tsv_rows`` in their order."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("".join(f"# {p}\n" for p in preamble) + "\t".join(header) + "\n")
        for r in lines.toLocalIterator():
            f.write(r["line"] + "\n")


def report_text(rows: DataFrame) -> str:
    """The coverage report (measure, n, whole, share) as Markdown."""
    out = ["# Coverage", "", "| measure | n | share |", "|---|---|---|"]
    out += [f"| {r['measure']} | {r['n']} | {r['share'] or ''} |" for r in rows.orderBy("measure").collect()]
    return "\n".join(out) + "\n"
