"""Command-line job (``spark-submit quire/job.py ...``): filter the paper index and
fetch the requested formats, writing the result table to ``--output-dir``.

Flags follow the batch script of the reference: ``--id --start --end
--category --formats --output-dir --verbose``, plus ``--index`` (Parquet
index) or ``--snapshot`` (NDJSON; the index is built next to it when absent),
``--feed`` (staged Atom pages, used when there is no finished index) and
``--artefacts`` (folder of staged pdf/html/tar.gz files, exported to
``--output-dir`` when their formats are asked for).
"""

from __future__ import annotations

import argparse
import os
import sys


def parse(argv=None):
    ap = argparse.ArgumentParser(description="Filter papers and fetch formats")
    ap.add_argument("--id", dest="regex_id", default=None, help="id pattern, e.g. '^2104\\.\\d+'")
    ap.add_argument("--start", default=None, help="YYYY-MM-DD")
    ap.add_argument("--end", default=None, help="YYYY-MM-DD")
    ap.add_argument("--category", nargs="*", default=None)
    ap.add_argument("--author", default=None)
    ap.add_argument("--title", default=None)
    ap.add_argument("--formats", nargs="*", default=["metadata"])
    ap.add_argument("--index", default=None)
    ap.add_argument("--snapshot", default=None)
    ap.add_argument("--feed", default=None)
    ap.add_argument("--artefacts", default=None)
    ap.add_argument("--output-dir", required=True)
    ap.add_argument("--master", default=None)
    ap.add_argument("--verbose", action="store_true")
    return ap.parse_args(argv)


def main(argv=None) -> int:
    a = parse(argv)
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from quire.plans.fetch import fetch_batch, snippets
    from quire.session import get_session, stored_stages
    from quire.sources import feeds, files, snapshot

    spark = get_session(a.master, app="quire-fetch")
    index = a.index or (a.snapshot.rstrip("/") + ".index" if a.snapshot else None)
    if index is None and a.feed is None:
        raise SystemExit("--index, --snapshot or --feed is required")
    if a.snapshot:
        snapshot.build_index(spark, a.snapshot, index, overwrite=False)   # no-op when finished
    papers = feeds.open_papers(spark, index, a.feed)
    arts = files.read_artefacts(spark, a.artefacts) if a.artefacts else None
    dest = os.path.join(a.output_dir, "results")
    with stored_stages(spark):
        fetch_batch(papers, a.regex_id, a.start, a.end, a.category, a.author, a.title, a.formats,
                    artefacts=arts, output_dir=a.output_dir).write.mode("overwrite").parquet(dest)
    if a.verbose:
        snippets(spark.read.parquet(dest)).show(20, truncate=80)
    print(dest)
    return 0


if __name__ == "__main__":
    sys.exit(main())
