"""Scalar expressions: identities, hashes, token estimates, paths, previews. All are built-in Spark expressions."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS_PER_BYTE = 0.75

# File extensions of the supported languages.
LANGUAGES = {
    ".py": "python",
    ".ts": "typescript",
    ".tsx": "tsx",
    ".js": "javascript",
    ".jsx": "jsx",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".c": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".cs": "c_sharp",
    ".rb": "ruby",
    ".php": "php",
    ".swift": "swift",
    ".kt": "kotlin",
    ".kts": "kotlin",
}
# Extensions that a path drops to become a module name.
MODULE_EXTENSIONS = ("py", "ts", "tsx", "js", "jsx", "java", "cs", "go", "rs", "c", "cpp", "h", "hpp")
# Directories that a file walk does not enter.
PRUNED = ("node_modules", "__pycache__", ".git", "venv", ".venv", "dist", "build")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def below(rows: Column, field: str, bound: Column) -> Column:
    """How many of the ``rows``, in the order of a ``field``, have it below ``bound``, by bisection; ``rows`` and ``bound`` should be bound by ``let``."""
    most, bits = 30, F.ceil(F.log2(F.size(rows) + 1)).cast("int")
    steps = F.slice(F.lit([1 << k for k in reversed(range(most))]), most + 1 - bits, bits)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(rows, at + step - 1)[field] < bound, at + step).otherwise(at))


def hash8(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 8)


def normalized_signature(signature: Column) -> Column:
    """White space around parentheses and commas is not significant; order of parameters is."""
    s = F.regexp_replace(signature, r"(?U)^\s+|\s+$", "")
    for pattern, to in ((r"(?U)\s+", " "), (r"(?U)\s*\(\s*", "("), (r"(?U)\s*\)\s*", ")"), (r"(?U)\s*,\s*", ", ")):
        s = F.regexp_replace(s, pattern, to)
    return s


def module_of(path: Column) -> Column:
    return F.translate(F.regexp_replace(path, rf"\.({'|'.join(MODULE_EXTENSIONS)})$", ""), "/\\", "..")


def symbol_id(path: Column, name: Column, kind: Column, line: Column) -> Column:
    return F.concat_ws(":", path, name, kind, line.cast("string"))


def symbol_key(module_path: Column, path: Column, container: Column, name: Column, kind: Column) -> Column:
    prefix = F.coalesce(F.nullif(module_path, F.lit("")), module_of(path))
    return F.concat(F.concat_ws(".", prefix, F.nullif(container, F.lit("")), name), F.lit(":"), kind)


def symbol_key_exact(key: Column, signature: Column) -> Column:
    return F.concat(key, F.lit(":"), hash8(normalized_signature(signature)))


def edge_id(kind: Column, path: Column, line: Column, column: Column, ref_text: Column, source: Column) -> Column:
    """The target is no part of an edge's identity, so resolving an edge keeps its id."""
    return F.sha2(F.concat_ws("|", kind, path, line.cast("string"), column.cast("string"), ref_text, source), 256)


def normalized_content(content: Column) -> Column:
    """Line ends to LF, one trailing LF dropped, each line right-trimmed."""
    text = F.regexp_replace(F.regexp_replace(content, r"\r\n?", "\n"), r"\n\z", "")
    return F.regexp_replace(text, r"(?Um)[\s&&[^\n]]+$", "")


def content_hash(content: Column) -> Column:
    return F.sha2(normalized_content(content), 256)


def content_lines(content: Column) -> Column:
    """Number of lines; a trailing line end begins no further one."""
    ends = F.regexp_count(content, F.lit(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"))
    closed = content.rlike(r"[\n\r\x0b\x0c\x1c-\x1e\x85  ]\z")
    return F.when(content == "", 0).otherwise(ends + F.when(closed, 0).otherwise(1)).cast("int")


def chunk_id(is_symbol: Column, key_exact: Column, path: Column, line: Column, content: Column) -> Column:
    window = F.concat_ws(":", path, F.lit("window"), line.cast("string"), hash8(normalized_content(content)))
    return F.when(is_symbol & (F.coalesce(key_exact, F.lit("")) != ""), key_exact).otherwise(window)


def file_tokens(size: Column) -> Column:
    return F.ceil(size.cast("double") * F.lit(TOKENS_PER_BYTE)).cast("long")


def text_tokens(text: Column) -> Column:
    return F.ceil(F.length(text).cast("double") * F.lit(TOKENS_PER_BYTE)).cast("long")


def batch_tokens(text: Column, ratio: float = 4.0) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text).cast("double") / F.lit(ratio))).cast("long")


def tokens_saved(naive: Column, actual: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), naive - actual)


def preview(content: Column, size: int = 200) -> Column:
    return F.when(F.length(content) > size, F.concat(F.left(content, F.lit(size)), F.lit("..."))).otherwise(content)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.[^.]*$", 0)


def language_of(path: Column) -> Column:
    """Language by the last dot of the path, case-sensitive; null if none is supported."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return known[extension(path)]


def excluded(path: Column, globs: list[str]) -> Column:
    """Shell globs whose star also crosses slashes."""
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(re.sub(r"\\Z$|\\z$", r"\\z", f"^{fnmatch.translate(g)}"))
    return out


def severity(status: Column) -> Column:
    return F.when(status == "error", 2).when(status == "warn", 1).otherwise(0)


def human_tokens(n: Column) -> Column:
    """1234 as ~1.2k, 2500000 as ~2.5M."""
    return (
        F.when(n >= 1_000_000, F.format_string("~%.1fM", n / 1_000_000.0))
        .when(n >= 1000, F.format_string("~%.1fk", n / 1000.0))
        .otherwise(F.format_string("~%d", n.cast("long")))
    )


def collapsed(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; ``..`` at the root is dropped."""
    step = lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def progress_bar(done: Column, total: Column, width: int = 20) -> Column:
    n = F.when(total > 0, F.floor(done * width / total)).otherwise(0).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("#"), n), F.repeat(F.lit("-"), F.lit(width) - n), F.lit("]"))


def status_word(code: Column) -> Column:
    """Version-control status letters; others give null."""
    c = F.left(code, F.lit(1))
    return F.when(c == "R", "renamed").when(c == "A", "added").when(c == "D", "deleted").when(c == "M", "modified")


def without_comments(json: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(json, r"(?s)/\*.*?\*/", ""), r"(?m)//.*$", "")


def char_codes(text: Column, size: int = 512, vocabulary: int = 30000) -> Column:
    """Fallback tokens: code points of the first characters, modulo the vocabulary."""
    chars = F.filter(F.split(F.left(text, F.lit(size)), ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.ascii(c) % vocabulary)
