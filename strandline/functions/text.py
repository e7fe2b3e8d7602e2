"""Column functions on names, paths and sets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def module_of(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def top_segment(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def is_dunder(name: Column) -> Column:
    return F.substring_index(name, ".", -1).rlike("^__.+__$")


def role_target(raw: Column) -> Column:
    """The target of a role: ``title <t>`` names t, ``~`` and leading dots fall away, ``!x`` is no reference."""
    inner = F.regexp_extract(raw, r"<([^<>]+)>\s*$", 1)
    bare = F.when(inner != "", inner).otherwise(raw)
    return F.when(F.startswith(F.trim(raw), F.lit("!")), F.lit(None)).otherwise(F.regexp_replace(F.trim(bare), r"^[~.]+", ""))


def k_grams(tokens: Column, k: int = 4) -> Column:
    """Distinct hashes of runs of k tokens; fewer tokens have none.

    ``tokens`` is bound once: within the inner function it would be made again for
    every run.
    """
    grams = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(F.concat_ws("\x1f", *(F.get(w, i + j) for j in range(k)))))
    none = F.array().cast("array<bigint>")
    return F.coalesce(F.get(F.transform(F.array(tokens), lambda w: F.when(F.size(w) >= k, F.array_distinct(grams(w))).otherwise(none)), F.lit(0)), none)


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / F.nullif(F.size(a) + F.size(b) - common, F.lit(0))


def under(path: Column, prefix: str) -> Column:
    """Whether ``path`` is ``prefix`` or lies in it, by whole components."""
    p = prefix.rstrip("/")
    return (path == p) | F.startswith(path, F.lit(p + "/"))


def absolute(path: Column, root: str) -> Column:
    """``path`` with forward slashes and without ``./``; a relative one is taken from ``root`` if there is any."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"(^|/)(\./)+", "$1")
    return F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p)) if root else p


def label_tokens(label: Column, least: int = 3) -> Column:
    """Lower-case parts of a label between ``-_.:`` and white space, of at least ``least`` letters, each once."""
    return F.filter(F.array_distinct(F.split(F.lower(label), r"[-_.:\s]+")), lambda t: F.length(t) >= least)


def is_dotted(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)*$")


def prefixes_of(name: Column) -> Column:
    """The dotted prefixes of a name, the longest first, the name itself left out."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.size(parts) - 1, F.lit(1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).otherwise(F.array().cast("array<string>"))
