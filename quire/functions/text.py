"""Text and presentation expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Line boundaries of Python's str.splitlines(): CRLF, or one of LF, CR, VT, FF,
# FS, GS, RS, NEL, LINE SEPARATOR, PARAGRAPH SEPARATOR.
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
# Characters Python's str.isspace() accepts (what str.strip() removes), as a
# regex class both Java and RE2 read.
PY_SPACE = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# The same characters as a literal set, for trim(BOTH chars FROM s).
PY_SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
                  "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# URL template per artefact format ({} = versioned id).
FORMAT_URLS = {
    "abstract": "https://arxiv.org/abs/{}",
    "pdf": "https://arxiv.org/pdf/{}.pdf",
    "html": "https://arxiv.org/abs/{}",
    "source": "https://arxiv.org/e-print/{}",
}
# File extension per artefact format.
FORMAT_EXT = {"pdf": "pdf", "html": "html", "source": "tar.gz"}
# Format aliases.
FORMAT_ALIASES = {"latex": "source", "tex": "source"}
# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_if_null(c) -> Column:
    """NULL -> ``''``, anything else cast to string."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def strip(c) -> Column:
    """Surrounding whitespace removed (Python ``str.strip()``)."""
    return F.trim(_col(c), F.lit(PY_SPACE_CHARS))


def lines(c) -> Column:
    """Python ``splitlines()``: split on every line boundary, one trailing
    empty piece dropped, ``''`` -> ``[]``; NULL stays NULL."""
    s = _col(c)
    parts = F.split(s, LINE_BREAK, -1)
    return (F.when(s == "", F.array().cast("array<string>"))
            .when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1))
            .otherwise(parts))


def decoded_lines(content) -> Column:
    """P19 on bytes: UTF-8 decode, then :func:`lines`."""
    return lines(F.decode(_col(content), "UTF-8"))


def snippet(c, n: int = 3) -> Column:
    """The first ``n`` lines joined with newlines. The text is split into
    ``n + 1`` pieces at most, so a long text is not cut into all its lines."""
    s = _col(c)
    head = F.slice(F.split(s, LINE_BREAK, n + 1), 1, n)
    # a text that ends in a line break has no line after it
    last = (F.size(head) > 1) & (F.element_at(head, -1) == "") & (F.size(F.split(s, LINE_BREAK, n + 1)) <= n)
    return F.array_join(F.when(last, F.slice(head, 1, F.size(head) - 1)).otherwise(head), "\n")


def join_authors(author_list) -> Column:
    """An author list joined with ``', '``."""
    return F.array_join(_col(author_list), ", ")


def vector_size(v) -> Column:
    """P25: vector length."""
    return F.size(_col(v)).cast("bigint")


def vector_head(v, k: int = 3, digits: int = 6) -> Column:
    """P25: first ``k`` values as text."""
    return F.array_join(F.transform(F.slice(_col(v), 1, k),
                                    lambda x: F.format_number(x.cast("double"), digits)), ", ")


def normalise_formats(formats) -> list[str]:
    """P20: string -> list, aliases -> ``source``, duplicates removed (order kept)."""
    if isinstance(formats, str):
        formats = [formats]
    out: list[str] = []
    for f in formats:
        f = FORMAT_ALIASES.get(f, f)
        if f not in out:
            out.append(f)
    return out


def format_url(vid, fmt: str) -> Column:
    """Download URL of an artefact."""
    tpl = FORMAT_URLS[fmt]
    pre, post = tpl.split("{}")
    return F.concat(F.lit(pre), _col(vid), F.lit(post))


def format_ext_map() -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in FORMAT_EXT.items()))


def artefact_name(vid, fmt) -> Column:
    """``<id>.<ext>``; NULL for a format without a file."""
    return F.concat(_col(vid), F.lit("."), F.element_at(format_ext_map(), _col(fmt)))


def head_bytes(content, n: int = 50) -> Column:
    """First ``n`` bytes of a binary column."""
    return F.substring(_col(content), 1, n)


def natural_order(path) -> Column:
    """A text that sorts paths with every run of digits as a number, so
    ``part-100000`` comes after ``part-99999`` and ``snap-10`` after ``snap-2``."""
    padded = F.regexp_replace(path, "([0-9]+)", "00000000000000000000$1")
    return F.regexp_replace(padded, "[0-9]*([0-9]{20})", "$1")
