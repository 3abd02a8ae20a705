"""Sources and sinks: files to rows, rows to files."""

from __future__ import annotations

from html.parser import HTMLParser
from itertools import zip_longest

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def text_files(spark: SparkSession, *folders: str, glob: str = "*.md") -> DataFrame:
    """path, text of whole files below the folders, without dot files and dot folders."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(list(folders), wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(~F.col("path").rlike(r"/\.[^/]+"))


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Typed rows; bad lines are kept in _corrupt, or fail the read if strict."""
    reader = spark.read.schema(schema if strict else f"{schema}, _corrupt string").option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return (reader if strict else reader.option("columnNameOfCorruptRecord", "_corrupt")).json(path)


def export_json_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """kind, line: all tables as JSON lines, nulls kept, ordered by kind and line."""
    out = None
    for kind in sorted(tables):
        t = tables[kind]
        part = t.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*sorted(t.columns)), {"ignoreNullFields": "false"}).alias("line"))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("kind", "line")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("errorifexists").text(path)


_MAGIC = {"pdf": b"%PDF-", "zip": b"PK\x03\x04", "png": b"\x89PNG", "gif": b"GIF8", "jpeg": b"\xff\xd8\xff"}


def sniff(content):
    """Kind of binary content by its first bytes; text if it is UTF-8 without NUL."""
    c = F.lit(None).cast("string")
    for kind, magic in reversed(list(_MAGIC.items())):
        c = F.when(F.substring(content, 1, len(magic)) == F.lit(magic), kind).otherwise(c)
    text = F.is_valid_utf8(content.cast("string")) & ~F.contains(content, F.lit(b"\x00"))
    return F.coalesce(c, F.when(text, "text"), F.lit("unknown"))


class _Markdown(HTMLParser):
    """Headings, paragraphs, list items and tables; scripts, styles, navigation and footers are left out."""

    SKIP = {"script", "style", "nav", "footer"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.now: list[str] = []
        self.lead, self.skip, self.row, self.rows = "", 0, None, None

    def flush(self):
        text = " ".join("".join(self.now).split())
        if text:
            self.out.append(self.lead + text)
        self.now, self.lead = [], ""

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif tag in ("h1", "h2", "h3"):
            self.flush()
            self.lead = "#" * int(tag[1]) + " "
        elif tag in ("p", "div", "section", "body", "title", "ul", "ol", "br"):
            self.flush()
        elif tag == "li":
            self.flush()
            self.lead = "- "
        elif tag == "table":
            self.flush()
            self.rows = []
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th"):
            self.now = []

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th") and self.row is not None:
            self.row.append(" ".join("".join(self.now).split()).replace("|", "\\|"))
            self.now = []
        elif tag == "tr" and self.rows is not None and self.row is not None:
            self.rows.append(self.row)
            self.row = None
        elif tag == "table" and self.rows is not None:
            self.out += _table(self.rows)
            self.rows = None
        elif tag in ("h1", "h2", "h3", "p", "li", "div", "title"):
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.now.append(data)


def _table(rows: list[list[str]]) -> list[str]:
    """A pipe table as one block: its columns are made equally long, a rule stands below the first row."""
    columns = [(head, "---", *rest) for head, *rest in zip_longest(*rows, fillvalue="")]
    return ["\n".join("| " + " | ".join(line) + " |" for line in zip(*columns))] if columns else []


def to_markdown(html: str) -> str:
    p = _Markdown()
    p.feed(html)
    p.flush()
    return "\n\n".join(p.out)


@F.pandas_udf(StringType())
def html_to_markdown(html: pd.Series) -> pd.Series:
    """Parsing HTML has no built-in."""
    return html.map(lambda h: None if h is None else to_markdown(h))


def to_html(markdown: str) -> str:
    """Headings, list items, quotes and paragraphs of Markdown as HTML, escaped."""
    import html
    import re

    out, listed = [], False
    for line in markdown.split("\n"):
        text = html.escape(line.strip())
        item = re.match(r"[-*] +(.*)", text)
        if listed and not item:
            out.append("</ul>")
            listed = False
        if m := re.match(r"(#{1,6}) +(.*)", text):
            out.append(f"<h{len(m[1])}>{m[2]}</h{len(m[1])}>")
        elif item:
            out += ([] if listed else ["<ul>"]) + [f"<li>{item[1]}</li>"]
            listed = True
        elif text:
            out.append(f"<p>{text}</p>")
    return "\n".join(out + (["</ul>"] if listed else []))


def json_ld(rows: DataFrame, key: str, kind: str, *fields: str) -> DataFrame:
    """id, line: one JSON-LD object a key (the least row of a repeated key), empty fields left out."""
    value = F.to_json(F.struct(F.concat(F.lit("urn:"), F.col(key).cast("string")).alias("@id"), F.lit(kind).alias("@type"), *[F.when(F.col(f).cast("string") != "", F.col(f)).alias(f) for f in fields]))
    return rows.select(F.col(key).alias("id"), value.alias("line")).groupBy("id").agg(F.min("line").alias("line"))


def state_lines(artifacts: DataFrame, parts: DataFrame, notes: DataFrame, header: dict[str, str]) -> DataFrame:
    """source, place, line: the current state as JSON lines: a header, then each artifact, its parts and its newest note.

    artifacts: source and more; parts: source, at and more; notes: source, revision and more. Keys of a line are sorted; places number the lines of a source; the header's source is null.
    Parts and notes of no artifact are left out."""
    spark = artifacts.sparkSession

    def line(df: DataFrame, kind: str, rank: int, order: Column) -> DataFrame:
        fields = [F.lit(kind).alias("type") if c == "type" else F.col(c) for c in sorted([*df.columns, "type"])]
        return df.select("source", F.struct(F.lit(rank).alias("kind"), order.cast("long").alias("at")).alias("o"), F.to_json(F.struct(*fields)).alias("line"))

    known = artifacts.select("source").distinct()
    newest = notes.withColumn("_k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("revision")))).where("_k = 1").drop("_k")
    rows = line(artifacts, "artifact", 0, F.lit(0)).unionByName(line(parts.join(known, "source", "left_semi"), "part", 1, F.col("at"))).unionByName(line(newest.join(known, "source", "left_semi"), "note", 2, F.col("revision")))
    rows = rows.select("source", F.row_number().over(Window.partitionBy("source").orderBy("o")).cast("long").alias("place"), "line")
    first = spark.range(1).select(F.lit(None).cast(dict(artifacts.dtypes)["source"]).alias("source"), F.lit(0).cast("long").alias("place"), F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted((header | {"type": "header"}).items())])).alias("line"))
    return first.unionByName(rows)


def write_state(lines: DataFrame, path: str) -> None:
    """Lines in order over the part files, which the committed writer shows all at once or not at all."""
    order = [F.col("source").asc_nulls_first(), F.col("place")]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("errorifexists").text(path)
