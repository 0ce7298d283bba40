"""Category expressions (P9-P12): token list, primary token, archive, group remap."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PY_SPACE

# --- fixed values (must equal the reference's for the same labels) ---------
# Archives that are all mapped to the group "ph".
PH_ARCHIVES = ["astro-ph", "cond-mat", "gr-qc", "hep-ex", "hep-lat", "hep-ph", "hep-th", "nlin",
               "nucl-ex", "nucl-th", "physics", "quant-ph", "math-ph", "acc-phys", "adap-org",
               "ao-sci", "atom-ph", "bayes-an", "chao-dyn", "chem-ph", "comp-gas", "mtrl-th",
               "patt-sol", "plasm-ph", "solv-int", "supr-con"]
# Archives mapped to "math".
MATH_ARCHIVES = ["alg-geom", "dg-ga", "q-alg"]
# Archives mapped to "cs".
CS_ARCHIVES = ["cmp-lg"]
# Archives mapped to "q-fin" (kept as the reference has it).
QFIN_ARCHIVES = ["funct-an"]
# Top-level archive vocabulary (defined, unused by the reference's pipeline).
ARCHIVES = ["cs", "econ", "eess", "math", "stat", "q-bio", "q-fin",
            "astro-ph", "cond-mat", "gr-qc", "hep-ex", "hep-lat", "hep-ph", "hep-th", "nlin",
            "nucl-ex", "nucl-th", "physics", "quant-ph", "math-ph"]
# ---------------------------------------------------------------------------

CATEGORY_GROUPS = {
    **{a: "ph" for a in PH_ARCHIVES},
    **{a: "math" for a in MATH_ARCHIVES},
    **{a: "cs" for a in CS_ARCHIVES},
    **{a: "q-fin" for a in QFIN_ARCHIVES},
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def category_tokens(c) -> Column:
    """Whitespace tokens of a space-separated category string (Python ``split()``):
    no empty tokens, leading/trailing blanks ignored."""
    return F.array_remove(F.split(_col(c), PY_SPACE + "+"), "")


def primary_category(c) -> Column:
    """First category token, NULL when there is none."""
    return F.get(category_tokens(c), 0)


def main_category(c) -> Column:
    """P10: text before the first ``.`` (``cs.LG`` -> ``cs``)."""
    return F.split(_col(c), r"[.]").getItem(0)


def category_group_map() -> Column:
    """31-entry literal map; a fixed constant, so inlining it is free at any scale."""
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in CATEGORY_GROUPS.items()))


def category_group(c) -> Column:
    """Remap an archive to its group; others unchanged."""
    x = _col(c)
    return F.coalesce(F.element_at(category_group_map(), x), x)


def is_archive(c) -> Column:
    """Membership in the top-level archive vocabulary."""
    return _col(c).isin(ARCHIVES)


def normalised_category(c) -> Column:
    """P9 -> P10 -> P11, the label used by the classifier."""
    return category_group(main_category(primary_category(c)))
