"""Filter the corpus and fetch the requested formats per paper.

``fetch_batch`` returns one lazy DataFrame; Catalyst plans the whole chain
(scan -> filter -> project -> artefact join), reading only the columns the
request needs. The reference's two steps (list ids, then seek each id) are one
filtered scan here; explicit id lists go through ``operators.lookup`` (J1, J2).
Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import rfc2822_iso
from ..functions.text import decoded_lines, head_bytes, normalise_formats, snippet
from ..operators import filters
from ..operators.lookup import small_side
from ..operators.dedup import dedup_by_key
from ..session import materialize
from ..sources.files import export_artefact_files, source_lines
from ..sources.snapshot import POSITION

BINARY_FORMATS = ("pdf", "html", "source")


def select_papers(papers: DataFrame, regex_id=None, start_date=None, end_date=None, categories=None,
                  author=None, title=None) -> DataFrame:
    """F8 + F3 in one pass over the index: rows passing the filters and the
    (possibly versioned) id pattern, matched at the start of the id, with a
    ``versioned_id`` column. In an index that keeps duplicates (has ``_pos``)
    only the last record of an id counts: the filters test that record, and an
    id whose newest record fails them is not returned for an older one. Which
    record is the last comes from a narrow scan (id and position); the filters
    reach the other scan."""
    sel = filters.versioned_ids(papers, regex_id, keep_columns=True)
    if POSITION in sel.columns:
        sel = dedup_by_key(sel, "base_id", POSITION, keep="last")
    return sel.where(filters.paper_predicate(None, start_date, end_date, categories, author, title))


def filter_ids(papers: DataFrame, regex_id=None, start_date=None, end_date=None, categories=None,
               author=None, title=None) -> DataFrame:
    """``(base_id, versioned_id)`` of the papers :func:`select_papers` returns."""
    return select_papers(papers.select(*[c for c in papers.columns if c != "metadata"]), regex_id,
                         start_date, end_date, categories, author, title).select("base_id", "versioned_id")


def _metadata(sel: DataFrame) -> Column:
    """Full record with ``id`` = versioned id (P8) and ``published`` (P2) from the
    first version's date; a compact index gives a struct of its columns."""
    if "metadata" in sel.columns:
        first = F.get(F.col("metadata.versions"), 0).getField("created")
        md = F.col("metadata").withField("published", F.coalesce(rfc2822_iso(first), F.lit("")))
    else:
        md = F.struct(*[F.col(c) for c in sel.columns if c not in ("versioned_id", POSITION)])
    return md.withField("id", F.col("versioned_id"))


def fetch_batch(papers: DataFrame, regex_id=None, start_date=None, end_date=None, category=None,
                author=None, title=None, formats="metadata", artefacts: DataFrame | None = None,
                output_dir: str | None = None) -> DataFrame:
    """One row per matching versioned id.

    The index is filtered in one pass (no self-join: the rows that pass the
    filters already hold the requested fields). ``formats == ['metadata']``:
    the metadata rows themselves. Otherwise ``id`` plus one column per
    requested format: ``metadata`` struct, ``abstract`` text, ``pdf`` bytes,
    ``html`` / ``source`` lines (NULL when the artefact is missing). With
    ``output_dir`` the selected artefacts are written there as files before
    this returns, and ``<fmt>_path`` names them (NULL where there is none).
    """
    fmts = normalise_formats(formats)
    unknown = [f for f in fmts if f not in ("metadata", "abstract", *BINARY_FORMATS)]
    if unknown:
        raise ValueError(f"unknown formats {unknown}")
    sel = select_papers(papers, regex_id, start_date, end_date, category, author, title)
    if fmts == ["metadata"]:
        return sel.select(_metadata(sel).alias("m")).select("m.*")

    cols = [F.col("versioned_id").alias("id")]
    if "metadata" in fmts:
        cols.append(_metadata(sel).alias("metadata"))
    if "abstract" in fmts:
        cols.append(F.col("abstract"))
    out = sel.select(*cols)
    binaries = [f for f in fmts if f in BINARY_FORMATS]
    if binaries:
        if artefacts is None:
            raise ValueError(f"formats {binaries} need an artefacts table (see sources.files.read_artefacts)")
        # only the selected papers' artefacts move: a semi join on the stored id
        # list (broadcast when its size is checked small) runs before the pivot,
        # so the shuffle carries their blobs, not the whole artefact store
        out = materialize(out, "selected")                 # read by the semi join and by the last join
        wanted = small_side(out.select("id").distinct())
        chosen = artefacts.where(F.col("format").isin(binaries)).join(wanted, on="id", how="left_semi")
        if output_dir:
            chosen = materialize(chosen, "artefacts")
            paths = materialize(export_artefact_files(chosen, output_dir), "paths")
            out = out.join(paths.groupBy("id").pivot("format", binaries).agg(F.first("path"))
                           .select("id", *[F.col(f).alias(f"{f}_path") for f in binaries]), on="id", how="left")
        arts = chosen.groupBy("id").pivot("format", binaries).agg(F.first("content"))
        if "source" in binaries:
            lines = source_lines(chosen.where("format = 'source'"))
            arts = arts.drop("source").join(lines, on="id", how="left")
        out = out.join(arts, on="id", how="left")
        if "html" in binaries:
            out = out.withColumn("html", decoded_lines("html"))
        out = out.select(*[c for c in out.columns if not c.endswith("_path")], *[c for c in out.columns if c.endswith("_path")])
    return out


def snippets(fetched: DataFrame, keep=()) -> DataFrame:
    """Printer columns: title, joined authors, first 3 abstract lines (P17, P18),
    first 50 PDF bytes (P29), when present; ``keep`` columns pass through."""
    cols = [F.col("id"), *[F.col(c) for c in keep]]
    names = set(fetched.columns)
    if "metadata" in names:
        cols += [F.col("metadata.title").alias("title"), F.col("metadata.authors").alias("authors"),
                 snippet(F.col("metadata.abstract"), 3).alias("abstract_head")]
    if "abstract" in names:
        cols.append(snippet("abstract", 3).alias("abstract_head"))
    if "pdf" in names:
        cols.append(head_bytes("pdf", 50).alias("pdf_head"))
    if "html" in names:
        cols.append(F.slice("html", 1, 3).alias("html_head"))
    if "source" in names:
        cols.append(F.slice("source", 1, 3).alias("source_head"))
    return fetched.select(*cols)
