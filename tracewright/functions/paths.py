"""Repository paths, imports and URLs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source suffixes, and the suffixes that an import may leave out, in order of preference.
SOURCE_SUFFIXES = (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts")
LEFT_OUT = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
INDEX = (".ts", ".tsx", ".js", ".jsx")
# What a commit id and a branch name look like.
OBJECT_ID = "^[0-9a-f]{40}(?:[0-9a-f]{24})?$"
BRANCH = r"^(?!/|.*(?:\.\.|//|@\{|\\|\s))[^~^:?*\[]+(?<![/.])$"


def parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot; empty for none, for dot files and for a trailing dot."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def without_suffix(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def module_key(path: Column) -> Column:
    """First segment, or repository-root for a path without one."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("repository-root")


def normalise(path: Column) -> Column:
    """path without `.`, `..` and empty segments; null if it leaves the root."""
    empty = F.array().cast("array<string>")
    keep = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    step = lambda out, s: F.when(s != "..", F.concat(out, F.array(s))).when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1)) != ".."), F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(s)))
    parts = F.aggregate(keep, empty, step)
    return F.when(path.startswith("/") | (F.get(parts, F.lit(0)) == ".."), F.lit(None)).otherwise(F.when(F.size(parts) == 0, ".").otherwise(F.array_join(parts, "/")))


def import_base(source: Column, specifier: Column) -> Column:
    return normalise(F.when(specifier.startswith("/") | (parent(source) == ""), specifier).otherwise(F.concat_ws("/", parent(source), specifier)))


def import_candidates(source: Column, specifier: Column) -> Column:
    """Paths that a relative import may mean, best first; empty if it leaves the root."""
    return base_candidates(import_base(source, specifier), suffix(import_base(source, specifier)))


def base_candidates(base: Column, end: Column) -> Column:
    """import_candidates() of an import's base and the suffix of that; both are used often, so that columns made before spare most of the work."""
    root = base == "."
    index = F.array(*(F.when(root, F.lit(f"index{e}")).otherwise(F.concat(base, F.lit(f"/index{e}"))) for e in INDEX))
    typed = F.array(base, *(F.concat(without_suffix(base), F.lit(e)) for e in (".ts", ".tsx")))
    bare = F.concat(F.array(base), F.when(root, F.array().cast("array<string>")).otherwise(F.array(*(F.concat(base, F.lit(e)) for e in LEFT_OUT))), index)
    return F.when(base.isNull(), F.array().cast("array<string>")).when(end.isin(".js", ".jsx"), typed).when(end == "", bare).otherwise(F.array(base))


def import_class(specifier: Column, resolved: Column) -> Column:
    """resolved, asset (relative, with a suffix that is no source's), unresolved (other relative) or external."""
    end = suffix(specifier)
    relative = specifier.startswith(".")
    return F.when(relative & resolved.isNotNull(), "resolved").when(relative & (end != "") & ~end.isin(*SOURCE_SUFFIXES), "asset").when(relative, "unresolved").otherwise("external")


def language(path: Column) -> Column:
    end = suffix(path)
    return F.when(end.isin(".tsx"), "tsx").when(end.isin(".ts", ".mts", ".cts"), "typescript").when(end.isin(".js", ".jsx", ".mjs", ".cjs"), "javascript")


def is_source(path: Column, mode: Column) -> Column:
    """A supported suffix, and no symbolic link."""
    return suffix(path).isin(*SOURCE_SUFFIXES) & (mode != "120000")


def valid_object_id(sha: Column) -> Column:
    return F.coalesce(sha.rlike(OBJECT_ID), F.lit(False))


def valid_ref(name: Column) -> Column:
    return F.coalesce((F.length(name) <= 255) & name.rlike(BRANCH), F.lit(False))


def normalised_repository(url: Column, host: str) -> Column:
    """https://host/owner/name.git of a credential-free repository URL, or null."""
    exact = rf"^https://{host.replace('.', '[.]')}/+([^/?#;:@\s]+)/+([^/?#;:@\s]+?)(?:\.git)?/*$"
    owner, name = F.regexp_extract(url, exact, 1), F.regexp_extract(url, exact, 2)
    return F.when((owner != "") & ~owner.isin(".", "..") & ~name.isin(".", ".."), F.concat(F.lit(f"https://{host}/"), owner, F.lit("/"), name, F.lit(".git")))


def import_specifiers(source: Column) -> Column:
    """Specifiers of import statements, side-effect imports, require() and import() in a source text, in order.

    One pass from left to right takes whole comments, imports, strings and template strings, so that what stands inside a comment or a string is
    never an import. export ... from is none either. A regular expression literal that holds a quote or // is read as code.
    """
    quoted = r"""(?:"([^"\\\n]+)"|'([^'\\\n]+)')"""
    called = r"""(?:"([^"\\\n]+)"|'([^'\\\n]+)'|`([^`\\$]+)`)"""
    pieces = (
        r"/\*(?s:.*?)\*/", r"//[^\n]*",
        r"(?<![\w$.])import\s*(?:[\w$*{}\s,]+?\s*\bfrom\s*)?" + quoted,
        r"(?<![\w$.])(?:require|import)\s*\(\s*" + called,
        r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'", r"`(?s:\\.|[^`\\])*`",
    )
    text, pattern = F.coalesce(source, F.lit("")), F.lit("|".join(pieces))
    taken = [F.regexp_extract_all(text, pattern, F.lit(g)) for g in range(1, 6)]
    # A match fills one of the groups, or none where it is no import; the others are empty.
    joined = taken[0]
    for more in taken[1:]:
        joined = F.zip_with(joined, more, lambda x, y: F.concat(x, y))
    return F.filter(joined, lambda x: x != "")
