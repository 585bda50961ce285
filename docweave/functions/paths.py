"""Columns over index paths, ``/<provider>/<relative path>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path parts that mark backups and scratch folders.
BACKUP_MARKERS = ("/_changes_backup/", "/trash/", "/tmp/", "/temp/")


def _bare(path: Column) -> Column:
    return F.ltrim(F.trim(F.coalesce(path, F.lit(""))), F.lit("/"))


def provider(path: Column) -> Column:
    """First segment, null for a blank path."""
    return F.nullif(F.split_part(_bare(path), F.lit("/"), F.lit(1)), F.lit(""))


def relative_path(path: Column) -> Column:
    """What follows the first segment, empty if nothing does."""
    return F.regexp_extract(_bare(path), r"^[^/]*/(?s:(.*))$", 1)


def scope(prefix: str | None) -> str | None:
    """A path scope as given by a caller: with a leading slash, without a trailing one; blank means none."""
    cleaned = (prefix or "").strip().replace("\\", "/").strip("/")
    return f"/{cleaned}" if cleaned else None


def in_scope(path: Column, prefix: str | None) -> Column:
    wanted = scope(prefix)
    return F.lit(True) if wanted is None else (path == wanted) | path.startswith(f"{wanted}/")


def has_hidden_segment(path: Column) -> Column:
    """Any segment begins with an underscore."""
    return F.coalesce(F.replace(path, F.lit("\\"), F.lit("/")).rlike("(^|/)_"), F.lit(False))


def in_ignored_folder(path: Column) -> Column:
    """Any folder, but not the file name, begins with an underscore or a dot."""
    return F.coalesce(F.replace(path, F.lit("\\"), F.lit("/")).rlike(r"(^|/)\s*[_.][^/]*/+[^/]"), F.lit(False))


def is_backup(path: Column) -> Column:
    lowered = F.lower(F.coalesce(path, F.lit("")))
    found = [F.contains(lowered, F.lit(m)) for m in BACKUP_MARKERS]
    return found[0] | found[1] | found[2] | found[3]


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def extension(declared: Column, name: Column) -> Column:
    """Lower-case extension without its dot, from the column or else from the name."""
    given = F.nullif(F.ltrim(F.lower(F.trim(declared)), F.lit(".")), F.lit(""))
    return F.coalesce(given, F.nullif(F.lower(F.regexp_extract(name, r".\.([^./]+)$", 1)), F.lit("")))


def glob_pattern(glob: str) -> str:
    """A shell pattern (``*``, ``?``, ``[...]``) as a regular expression over the whole string."""
    out = []
    i = 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = close
        else:
            out.append("\\" + c if c in r"\.^$+{}[]|()" else c)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def matches_globs(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Any include pattern (all, if none is given) and no exclude pattern."""
    kept = F.lit(not include)
    for g in include:
        kept = kept | path.rlike(glob_pattern(g))
    for g in exclude:
        kept = kept & ~path.rlike(glob_pattern(g))
    return kept
