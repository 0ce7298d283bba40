"""Corpus, vector and artefact files; result sinks."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import base_id
from ..functions.text import FORMAT_EXT, artefact_name, decoded_lines
from .storage import open_fs, publish

CORPUS_CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in
                                  ("id", "title", "abstract", "authors", "categories")])


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet",
                schema: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """Paper corpus as Parquet, or CSV with a header and a given schema.
    CSV follows RFC 4180: fields may span lines, a quote inside a field is
    doubled (as the usual data-frame CSV writers do). A file whose fields may
    span lines is one task; with ``multi_line=False`` (every record on a line
    of its own) large files are split."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "csv":
        return spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"') \
            .schema(schema or CORPUS_CSV_SCHEMA).csv(path)
    raise ValueError(fmt)


def write_corpus_csv(df: DataFrame, dest: str) -> str:
    """Corpus as RFC 4180 CSV with a header (the form :func:`read_corpus` reads)."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(dest)
    return dest


def read_json_document(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A JSON file holding one document (or an array of records)."""
    r = spark.read.option("multiLine", True)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def read_citation_edges(spark: SparkSession, path) -> DataFrame:
    """Adjacency JSON objects ``{paper: [cited, ...], ...}`` (gzip read
    natively) -> distinct edges ``(src, dst)``.

    A file may hold one object over all its text or an object per line, and a
    paper may occur repeatedly. The text is cut behind every ``]``, so a piece
    is one paper's list: an uncompressed object is read by many tasks, and no
    row holds more than one list. Ids must not contain ``]``.
    """
    pieces = spark.read.option("lineSep", "]").text(path)
    entry = F.regexp_extract("value", r'(?s)("(?:[^"\\]|\\.)*"\s*:\s*\[.*)', 1)
    m = pieces.select(entry.alias("e")).where("e <> ''")
    m = m.select(F.explode(F.from_json(F.concat(F.lit("{"), "e", F.lit("]}")), "map<string, array<string>>")).alias("src", "dsts"))
    return m.select("src", F.explode("dsts").alias("dst")).distinct()


# Cited papers in one entry of a written object; a longer list goes on in a further entry of the same paper.
LIST_LENGTH = 1000


def write_citation_objects(edges: DataFrame, dest: str, src: str = "src", dst: str = "dst",
                           partitions: int | None = None) -> str:
    """Edges as one large adjacency object per file, a paper's citations in
    its entry (in several for a hub, so no row grows with its fan-out)."""
    e = edges.select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"))
    e = (e.repartition(partitions, "src") if partitions else e.repartition("src")).sortWithinPartitions("src")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paper, cited, mark = None, [], "{"

        def entry() -> str:
            return f"{mark}{json.dumps(paper)}: {json.dumps(cited)}"

        for b in batches:
            out = []
            for s, d in zip(b["src"], b["dst"], strict=True):
                if paper is not None and (s != paper or len(cited) >= LIST_LENGTH):
                    out.append(entry())
                    cited, mark = [], ", "
                paper = s
                cited.append(d)
            yield pd.DataFrame({"value": out}, dtype=object)
        yield pd.DataFrame({"value": ([entry()] if paper is not None else [mark]) + ["}"]}, dtype=object)

    e.mapInPandas(run, "value string").write.mode("overwrite").text(dest)
    return dest


def write_json_documents(df: DataFrame, dest: str) -> str:
    """Rows as whole JSON documents: every file is one array of records (the
    form :func:`read_json_document` reads)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mark = "["
        for b in batches:
            out = []
            for r in b["value"]:
                out.append(mark + r)
                mark = ", "
            yield pd.DataFrame({"value": out}, dtype=object)
        yield pd.DataFrame({"value": [("[" if mark == "[" else "") + "]"]}, dtype=object)

    df.select(F.to_json(F.struct("*")).alias("value")).mapInPandas(run, "value string").write.mode("overwrite").text(dest)
    return dest


def write_citation_lines(edges: DataFrame, dest: str, src: str = "src", dst: str = "dst") -> str:
    """Edges as gzip NDJSON adjacency objects, one ``{src: [dst]}`` per edge:
    no grouping, so a citing paper with a huge fan-out never becomes one row."""
    line = F.to_json(F.create_map(F.col(src).cast("string"), F.array(F.col(dst).cast("string"))))
    edges.select(line.alias("value")).write.mode("overwrite").option("compression", "gzip").text(dest)
    return dest


EMBEDDING_COLUMNS = ("title_emb", "summary_emb", "authors_emb")


def read_embeddings(spark: SparkSession, path: str, key: str = "id", columns=None) -> DataFrame:
    """The key and vector columns (all array columns by default) of a
    stored embedding table; vectors are keyed, never positional."""
    df = spark.read.parquet(path)
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    lost = [c for c in (key, *columns) if c not in df.columns]
    if lost or not columns:
        raise ValueError(f"{path} has no column {', '.join(lost) or 'of vectors'}")
    return df.select(key, *columns)


METADATA_LIST_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("authors", T.StringType()),
    T.StructField("authors_parsed", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("title", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
])


def read_metadata_list(spark: SparkSession, path: str) -> DataFrame:
    """Metadata list (NDJSON, gzip allowed); ``categories`` is a list whose
    first element holds a space-separated string."""
    return spark.read.schema(METADATA_LIST_SCHEMA).json(path)


def write_embeddings(df: DataFrame, dest: str, key: str = "id") -> str:
    """``(id, title_emb, summary_emb, authors_emb)`` as Parquet."""
    df.select(F.col(key).alias("id"), *EMBEDDING_COLUMNS).write.mode("overwrite").parquet(dest)
    return dest


def write_wide_csv(df: DataFrame, dest: str) -> str:
    """Wide embedding table as CSV with a header (no index column)."""
    df.write.mode("overwrite").option("header", True).csv(dest)
    return dest


def read_wide_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S7 for the wide table of S18: CSV with a header, typed by ``schema``."""
    return spark.read.option("header", True).schema(schema).csv(path)


def read_artefacts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Binary artefacts ``(path, id, format, content)``; id and format from
    the file name ``<versioned id>.<ext>``."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext_to_fmt = F.create_map(*[x for k, v in FORMAT_EXT.items() for x in (F.lit(v), F.lit(k))])
    ext = F.regexp_extract(name, r"\.(pdf|html|tar\.gz)$", 1)
    vid = F.regexp_replace(name, r"\.(pdf|html|tar\.gz)$", "")
    return df.select("path", vid.alias("id"), base_id(vid).alias("base_id"),
                     F.element_at(ext_to_fmt, ext).alias("format"), "content")


def write_artefacts(df: DataFrame, dest: str) -> str:
    """Artefacts as Parquet ``(id, format, content, path)`` with the file
    name ``<id>.<ext>`` the reference would have written. Stored in one folder
    per format, so a request for some formats reads only their folders."""
    out = df.select("id", "format", "content",
                    F.concat(F.lit(dest.rstrip("/") + "/"), artefact_name("id", "format")).alias("path"))
    out.write.mode("overwrite").partitionBy("format").parquet(dest)
    return dest


def export_artefact_files(df: DataFrame, out_dir: str) -> DataFrame:
    """One file per (id, format) in ``out_dir`` (a folder that all
    executors see, on any file system), written by the tasks; returns ``(id,
    format, path)`` of the files. Nothing passes through the driver. An id
    with a slash (``math/0309136``) makes a folder."""
    out_dir = out_dir.rstrip("/")
    rows = df.select("id", "format", "content", artefact_name("id", "format").alias("name")).where("content is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, top = open_fs(out_dir)
        for b in batches:
            b = b[b["name"].notna()]
            for name, content in zip(b["name"], b["content"], strict=True):
                path = f"{top}/{name}"
                files.create_dir(path.rpartition("/")[0], recursive=True)
                publish(files, path, bytes(content))
            yield pd.DataFrame({"id": b["id"], "format": b["format"], "path": out_dir + "/" + b["name"]})

    return rows.mapInPandas(run, "id string, format string, path string")


def html_lines(df: DataFrame, content: str = "content") -> DataFrame:
    """P19 on HTML artefacts: decoded lines."""
    return df.withColumn("html", decoded_lines(content))


# --- P28: first .tex member of a source archive, as lines ----------------------

def _tex_lines(blob) -> list[str] | None:
    if blob is None:
        return None
    try:
        with tarfile.open(fileobj=io.BytesIO(bytes(blob)), mode="r:*") as tar:
            for m in tar.getmembers():
                if m.isfile() and m.name.endswith(".tex"):
                    f = tar.extractfile(m)
                    return f.read().decode("utf-8", errors="replace").splitlines() if f else []
            return []
    except (tarfile.TarError, EOFError, OSError):
        return None


def source_lines(df: DataFrame, key: str = "id", content: str = "content", out: str = "source") -> DataFrame:
    """``(key, out)`` with the lines of the first ``.tex`` member of each
    archive; ``[]`` when the archive has none, NULL when it is not a readable
    archive.

    Archive parsing has no SQL form, so it runs in ``mapInPandas``; only the
    key and the archive pass through Python. Join the result on ``key``.
    """
    rows = df.select(key, F.col(content).alias("_blob"))
    schema = T.StructType([rows.schema[key], T.StructField(out, T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 64):               # unpacked lines are handed on in small lots
                part = pdf.iloc[a:a + 64]
                yield pd.DataFrame({key: part[key], out: pd.Series([_tex_lines(b) for b in part["_blob"]],
                                                                   dtype=object, index=part.index)})
    return rows.mapInPandas(run, schema)
