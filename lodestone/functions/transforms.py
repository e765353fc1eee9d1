"""Field transforms: text to text, as Columns. An absent value is the text ``<nil>`` to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import WHITE


def _blind(c: Column, p: dict) -> Column:
    mode, count = str(p.get("mode", "keep_first")), int(p.get("count", 4))
    mask = F.lit((str(p.get("mask_char") or "*"))[:1])
    n = F.char_length(c)
    if mode in ("keep_first", "keep_last"):
        kept = F.concat(F.left(c, F.lit(count)), F.repeat(mask, n - count)) if mode == "keep_first" else F.concat(F.repeat(mask, n - count), F.right(c, F.lit(count)))
        return F.when(F.lit(count) >= n, F.repeat(mask, n)).otherwise(kept)
    if mode == "mask_all":
        return F.repeat(mask, n)
    if mode == "keep_domain":
        domain = F.substring_index(c, "@", -1)
        local = F.left(c, n - F.char_length(domain) - 1)
        size = F.char_length(local)
        kept = F.when(size <= count, F.repeat(mask, size)).otherwise(F.concat(F.left(c, F.lit(count)), F.repeat(mask, size - count)))
        return F.when(F.instr(c, "@") > 0, F.when(size > 0, F.concat(kept, F.lit("@"), domain)).otherwise(_trim(c, {}))).otherwise(_trim(c, {}))
    raise ValueError(f"unknown blind_string mode {mode!r}")


def _trim(c: Column, _: dict) -> Column:
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def _replace(c: Column, p: dict) -> Column:
    if not isinstance(p.get("old"), str) or not isinstance(p.get("new"), str):
        raise ValueError("replace needs 'old' and 'new'")
    return F.replace(c, F.lit(p["old"]), F.lit(p["new"]))


def _title(c: Column, _: dict) -> Column:
    """Capitalises the first letter of each word and lowers the rest; words end at all but letters, digits, ``_`` and marks between letters (``'``, ``.``)."""
    end = "\ue000 "
    cut = F.regexp_replace(c, r"([^\p{L}\p{M}\p{N}'’.:·_ ]|(?<![\p{L}\p{M}\p{N}])['’.:·])", f"$1{end}")
    return F.replace(F.initcap(cut), F.lit(end), F.lit(""))


#: Name: (category, description, function of a Column and the parameters).
REGISTRY: dict[str, tuple[str, str, Callable[[Column, dict], Column]]] = {
    "trim": ("string", "Removes white space at both ends", _trim),
    "ltrim": ("string", "Removes leading blanks, tabs and line ends", lambda c, _: F.regexp_replace(c, r"^[ \t\n\r]+", "")),
    "rtrim": ("string", "Removes trailing blanks, tabs and line ends", lambda c, _: F.regexp_replace(c, r"[ \t\n\r]+\z", "")),
    "upper": ("string", "Upper case", lambda c, _: F.upper(c)),
    "lower": ("string", "Lower case", lambda c, _: F.lower(c)),
    "title": ("string", "Title case by words", _title),
    "replace": ("string", "Replaces all occurrences of 'old' by 'new'", _replace),
    "blind_string": ("string", "Masks all but a first or last part, the domain, or all", _blind),
}


def apply_transform(c: Column, name: str, params: dict | None = None) -> Column:
    """The transformed text of a Column."""
    if name not in REGISTRY:
        raise ValueError(f"unknown transform {name!r}")
    return REGISTRY[name][2](F.coalesce(c.cast("string"), F.lit("<nil>")), params or {})


def describe() -> list[tuple[str, str, str]]:
    """(name, category, description) of all transforms, by name."""
    return sorted((k, v[0], v[1]) for k, v in REGISTRY.items())
