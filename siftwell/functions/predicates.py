"""Path and content predicates as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of files that are text, whatever their bytes look like.
KNOWN_TEXT = (
    "rs", "ts", "tsx", "js", "jsx", "py", "go", "rb", "java", "c", "h", "cpp", "cc", "hpp", "cs", "swift", "kt", "scala", "php", "html", "css", "scss",
    "less", "json", "toml", "yaml", "yml", "md", "txt", "sh", "bash", "zsh", "fish", "vim", "lua", "r", "sql", "xml", "svg", "tf", "hcl", "nix", "ex",
    "exs", "erl", "hrl", "ml", "mli", "hs", "clj", "cljs", "lisp", "el", "dart", "zig", "v", "proto", "graphql", "gql",
)
HEAD = 512
SAMPLE = 8192


def glob_regex(glob: str) -> str:
    """A gitignore-style glob as a pattern over whole relative paths.

    Without a slash it matches a name at any depth; `**` crosses directories, `*` and `?`
    don't; a match of a directory covers what lies below.
    """
    anchored = "/" in glob.rstrip("/")
    body, i, glob = "", 0, glob.strip("/")
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            body, i = body + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            body, i = body + ".*", i + 2
            continue
        if c == "*":
            body += "[^/]*"
        elif c == "?":
            body += "[^/]"
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            body += f"[{'^' + inner[1:] if inner[0] in '!^' else inner}]"
            i = end
        elif c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            body += "(?:" + "|".join(glob_regex(p)[len("^(?:.*/)?") : -len("(?:/.*)?$")] for p in glob[i + 1 : end].split(",")) + ")"
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            body += re.escape(glob[i])
        else:
            body += re.escape(c)
        i += 1
    return f"^{'' if anchored else '(?:.*/)?'}{body}(?:/.*)?$"


def passes_globs(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Some include matches (or there is none) and no exclude does."""
    out = F.lit(True)
    if include:
        out = path.rlike("|".join(map(glob_regex, include)))
    for g in exclude:
        out = out & ~path.rlike(glob_regex(g))
    return out


def passes_types(ext: Column, types: list[str]) -> Column:
    return ext.isin(list(types)) if types else F.lit(True)


def is_hidden(path: Column) -> Column:
    """Some component of the relative path starts with a dot."""
    return path.rlike(r"(?:^|/)\.[^/]")


def below(path: Column, prefix: str | None) -> Column:
    """The path is the prefix or lies below it, by whole components."""
    prefix = (prefix or "").strip("/")
    if prefix in ("", "."):
        return F.lit(True)
    return (path == prefix) | path.startswith(prefix + "/")


def extension(path: Column) -> Column:
    """The text after the last dot of the name; null if there is none, or only a leading one."""
    found = F.regexp_extract(path, r"(?:^|/)[^/]+\.([^./]*)$", 1)
    return F.when(path.rlike(r"(?:^|/)[^/]+\.[^./]*$"), found)


def is_binary(content: Column) -> Column:
    """A NUL among the first bytes, or more than 30 % control bytes in the first sample.
    Tab, line feed and carriage return are no control bytes; DEL is."""
    head = F.substring(content, 1, HEAD)
    sample = F.decode(F.substring(content, 1, SAMPLE), "ISO-8859-1")
    rest = F.length(F.regexp_replace(sample, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
    return (F.instr(F.decode(head, "ISO-8859-1"), "\0") > 0) | ((F.length(sample) - rest) * 10 > F.length(sample) * 3)


def is_text(content: Column, ext: Column) -> Column:
    return F.coalesce(ext.isin(*KNOWN_TEXT), F.lit(False)) | ~is_binary(content)
