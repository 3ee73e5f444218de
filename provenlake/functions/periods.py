"""Relations of period tags: which periods of a candidate match a claim's, most exact first."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUARTER_OF = {m: str(i // 3 + 1) for i, m in enumerate("january february march april may june july august september october november december".split())}


def _kind(tags: Column, kind: str) -> Column:
    return F.filter(tags, lambda t: t.startswith(kind + ":"))


def calendar_quarter(month: Column) -> Column:
    """quarter:calendar:q:year of month:year-name."""
    name = F.split_part(month, F.lit("-"), F.lit(2))
    year = F.regexp_extract(month, r"^month:(\d+)-", 1)
    return F.concat(F.lit("quarter:calendar:"), F.try_element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(_QUARTER_OF.items()))), name), F.lit(":"), year)


def matching_dates(claim: Column, candidate: Column) -> Column:
    """Tags of the candidate that match: equal quarters, months within a claimed calendar quarter, equal months, calendar
    quarters around a claimed month, equal fiscal years, fiscal quarters within a claimed fiscal year, equal years. The first
    relation that holds decides; each is passed over where it gives nothing."""
    cq, cm, cf, cy = (_kind(claim, k) for k in ("quarter", "month", "fiscal_year", "year"))
    dq, dm = _kind(candidate, "quarter"), _kind(candidate, "month")
    steps = [
        F.array_intersect(cq, candidate),
        F.filter(dm, lambda m: F.array_contains(cq, calendar_quarter(m))),
        F.array_intersect(cm, candidate),
        F.filter(dq, lambda q: F.array_contains(F.transform(cm, calendar_quarter), q)),
        F.array_intersect(cf, candidate),
        F.filter(dq, lambda q: q.startswith("quarter:fiscal:") & F.array_contains(cf, F.concat(F.lit("fiscal_year:"), F.split_part(q, F.lit(":"), F.lit(4))))),
        F.array_intersect(cy, candidate),
    ]
    return F.array_sort(F.coalesce(*(F.when(F.size(s) > 0, s) for s in steps), F.array().cast("array<string>")))
