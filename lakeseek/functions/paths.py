"""Paths: two glob dialects compiled to regular expressions, parts of paths, languages, MIME classes, formatters."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories never entered.
SKIP_DIRS = (".git", ".svn", ".hg", ".venv", "venv", "node_modules", ".lakeseek", "__pycache__", ".pytest_cache", ".ruff_cache", ".mypy_cache", ".tox", ".githooks", "storage")
# What is left out by default.
DEFAULT_EXCLUDES = tuple(
    "*.pyc *.pyo *.so *.dylib *.dll *.exe *.egg-info/* *.egg *.whl *.dist-info/* .DS_Store Thumbs.db .gitignore .gitattributes .gitmodules .gitkeep "
    ".env .env.* *.env .envrc secrets.* credentials.* *.md *.txt *.rst docs/* *.json *.toml *.ini *.cfg *.conf .editorconfig *.lock package-lock.json "
    "yarn.lock poetry.lock Cargo.lock Gemfile.lock dist/* build/* out/* target/* *.min.js *.min.css *.map coverage/* .coverage htmlcov/* "
    ".phpunit.result.cache vendor/* third_party/* LICENSE* LICENCE* COPYING* Makefile Dockerfile *.dockerfile *.log logs/* *.tmp *.temp *.old *.bak "
    "*.backup *.orig *.swp *~ *.csv *.tsv *.sqlt *.dat *.xml *.png *.jpg *.jpeg *.gif *.bmp *.ico *.svg *.webp *.tiff *.tif *.psd *.ai *.eps *.woff "
    "*.woff2 *.ttf *.otf *.eot *.mp3 *.mp4 *.wav *.avi *.mov *.webm *.zip *.tar *.gz *.rar *.7z *.sqlite *.sqlite3 *.db *.sql *.dump *.pth py.typed".split()
)
# Language by extension.
LANGUAGES = {
    "python": ".py .pyi .pyx", "javascript": ".js .mjs .cjs .jsx", "typescript": ".ts .tsx .mts .cts", "html": ".html .htm", "css": ".css", "scss": ".scss",
    "sass": ".sass", "less": ".less", "c": ".c .h", "cpp": ".cpp .cxx .cc .hpp .hxx", "rust": ".rs", "go": ".go", "zig": ".zig", "java": ".java",
    "kotlin": ".kt .kts", "scala": ".scala", "clojure": ".clj .cljs", "groovy": ".groovy", "csharp": ".cs", "fsharp": ".fs", "vb": ".vb", "ruby": ".rb",
    "php": ".php", "perl": ".pl .pm", "lua": ".lua", "r": ".r .R", "shell": ".sh .bash .zsh .fish", "powershell": ".ps1 .psm1", "haskell": ".hs .lhs",
    "ocaml": ".ml .mli", "elixir": ".ex .exs", "erlang": ".erl .hrl", "sql": ".sql", "graphql": ".graphql .gql", "swift": ".swift", "objective-c": ".m",
    "objective-cpp": ".mm", "vim": ".vim", "elisp": ".el", "racket": ".rkt", "nim": ".nim", "d": ".d", "dart": ".dart", "v": ".v", "assembly": ".asm .s .S",
    "wasm": ".wasm .wat",
}
EXTENSIONS = {e: lang for lang, es in LANGUAGES.items() for e in es.split()}
# MIME types that are text, and types that never are.
TEXT_TYPES = tuple(
    "application/javascript application/json application/xml application/x-sh application/x-shellscript application/x-perl application/x-ruby "
    "application/x-python application/x-php application/x-httpd-php application/x-awk application/x-ndjson application/sql application/x-empty inode/x-empty".split()
)
BLOCKED_TYPES = tuple(
    "application/x-sqlite3 application/x-executable application/x-sharedlib application/x-mach-binary application/x-dosexec application/octet-stream "
    "application/gzip application/x-tar application/zip application/x-bzip2 application/x-7z-compressed application/x-rar application/pdf "
    "application/x-object application/x-archive".split()
)
# Extensions worth a look before indexing.
REVIEW_EXTENSIONS = tuple(".log .log_save .old .bak .backup .tmp .dump .sql .sqlt .csv .tsv .dat .out .err .trace .prof".split())
REVIEW_SIZE = 500 * 1024


def _classes(pattern: str, star: str, one: str, classes: bool) -> str:
    """Body of a regular expression for a glob; with `classes`, [..] and [!..] are character sets."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            while i + 1 < len(pattern) and pattern[i + 1] == "*" and classes:
                i += 1
            out.append(star)
        elif c == "?":
            out.append(one)
        elif c == "[" and classes and (m := re.match(r"\[(!?)(\]?[^\]]*)\]", pattern[i:])):
            inner = m[2].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{'^' if m[1] else ''}{chr(92) + inner if inner[:1] in ('^', ']') else inner}]")
            i += m.end() - 1
        else:
            out.append(re.sub(r"([\\.^$|+(){}\[\]*?])", r"\\\1", c))
        i += 1
    return "".join(out)


def glob_regex(pattern: str) -> str:
    """Shell pattern in which * and ? cross slashes, as an anchored regular expression."""
    return f"(?s)^{_classes(pattern, '.*', '.', True)}$"


def deep_glob_regex(pattern: str) -> str:
    """Pattern with **: "**/" is any directories or none, * and ? stay within one; sets are literal."""
    if "**" not in pattern:
        return glob_regex(pattern)
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append(_classes(pattern[i], "[^/]*", "[^/]", False))
            i += 1
    return f"^{''.join(out)}$"


def _any(column: Column, regexes: list[str]) -> Column:
    """One regular expression for all: a search per row, not one per pattern."""
    if not regexes:
        return F.lit(False)
    return column.rlike("(?s)" + "|".join(f"(?:{r.removeprefix('(?s)')})" for r in regexes))


def is_simple_pattern(pattern: str) -> bool:
    """A pattern that a prefix or suffix comparison can answer: one star at an end, nothing else special."""
    return pattern.count("*") == 1 and not re.search(r"[?\[\]]", pattern) and (pattern.startswith("*") or pattern.endswith("*"))


def simple_match(path: Column, pattern: str) -> Column:
    """A simple pattern as a comparison that file formats can push down."""
    if not is_simple_pattern(pattern):
        raise ValueError(f"{pattern!r} is no simple pattern")
    return path.endswith(pattern[1:]) if pattern.startswith("*") else path.startswith(pattern[:-1])


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def last_two(path: Column) -> Column:
    return F.substring_index(path, "/", -2)


def relative(path: Column, root: str) -> Column:
    """Below the root without it, else unchanged."""
    head = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(head)), F.substring(path, len(head) + 1, 1 << 30)).otherwise(path)


def excluded(relative_path: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """Does a pattern match the name, the relative path, or the path below any directory."""
    name = basename(relative_path)
    found = [_any(x, [glob_regex(p) for p in patterns]) for x in (name, relative_path)]
    below = _any(relative_path, [glob_regex(f"**/{p}") for p in patterns])
    return functools.reduce(operator.or_, [*found, below])


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Search filter: a pattern matches the path, the path without its leading slash, or the name."""
    regexes = [deep_glob_regex(p) for p in patterns]
    bare = F.regexp_replace(path, "^/+", "")
    return functools.reduce(operator.or_, (_any(x, regexes) for x in (path, bare, basename(path))), F.lit(False))


def in_skipped_dir(relative_path: Column, skip: tuple[str, ...] = SKIP_DIRS) -> Column:
    parts = F.split(relative_path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.arrays_overlap(dirs, F.array(*map(F.lit, skip)))


def suffix(path: Column) -> Column:
    """Last suffix with its dot; leading dots of a name begin none."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*?(\.[^.]+)$", 1)


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    ext = suffix(path)
    return F.coalesce(F.try_element_at(table, F.lower(ext)), F.try_element_at(table, ext))


def is_text_mime(mime: Column) -> Column:
    """Ordered rules: blocked types, media, text/*, the allow list; anything else is binary."""
    head = F.substring_index(mime, "/", 1)
    return (
        F.when(mime.isin(*BLOCKED_TYPES), False).when(head.isin("image", "audio", "video", "font"), False).when(head == "text", True).when(mime.isin(*TEXT_TYPES), True).otherwise(False)
    )


def mime_category(mime: Column) -> Column:
    return F.coalesce(F.nullif(F.substring_index(mime, "/", 1), F.lit("")), F.lit("text"))


def mime_of(content: Column) -> Column:
    """A MIME type from leading bytes: a few signatures, else text unless there is a NUL byte."""
    head = F.hex(F.substring(content, 1, 16))
    # Signatures of common binary formats.
    signs = [
        ("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("25504446", "application/pdf"), ("504B0304", "application/zip"),
        ("1F8B", "application/gzip"), ("7F454C46", "application/x-executable"), ("53514C69746520666F726D6174", "application/x-sqlite3"), ("425A68", "application/x-bzip2"),
        ("377ABCAF271C", "application/x-7z-compressed"), ("4F676753", "audio/ogg"), ("4D5A", "application/x-dosexec"),
    ]
    out = F.when(F.octet_length(content) == 0, "inode/x-empty")
    for sign, mime in signs:
        out = out.when(head.startswith(sign), mime)
    return out.when(F.instr(F.decode(content, "ISO-8859-1"), "\0") > 0, "application/octet-stream").when(head.startswith("2321"), "text/x-script").otherwise("text/plain")


def review_reason(path: Column, size: Column) -> Column:
    """Why a file should be looked at, or null."""
    name, ext = F.lower(basename(path)), F.lower(suffix(path))
    odd = functools.reduce(operator.or_, (F.contains(name, F.lit(x)) for x in (".log", "_log", "-log", ".old", ".bak")))
    large = (size > REVIEW_SIZE) & ext.isin(".txt", ".text", "")
    return (
        F.when(ext.isin(*REVIEW_EXTENSIONS), F.concat(F.lit("extension '"), ext, F.lit("'")))
        .when(odd, "filename suggests log/backup")
        .when(large, F.concat(F.lit("large file ("), size_text(size), F.lit(") without code extension")))
    )


def size_text(size: Column, unit: str = "B") -> Column:
    """1023B, 1.0KB, 1.5MB; with unit " bytes" the long form."""
    kb, mb = F.format_string("%.1fKB", size / 1024.0), F.format_string("%.1fMB", size / 1048576.0)
    if unit != "B":
        kb, mb = F.format_string("%.1f KB", size / 1024.0), F.format_string("%.1f MB", size / 1048576.0)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(unit))).when(size < 1048576, kb).otherwise(mb)


def duration_text(ms: Column) -> Column:
    return F.when(ms >= 60_000, F.format_string("%.1f min", ms / 60000.0)).when(ms >= 1000, F.format_string("%.1fs", ms / 1000.0)).otherwise(F.concat(ms.cast("string"), F.lit("ms")))


def age_text(seconds: Column) -> Column:
    return (
        F.when(seconds.isNull(), "N/A").when(seconds < 60, "just now").when(seconds < 3600, F.format_string("%dm ago", F.floor(seconds / 60)))
        .when(seconds < 86400, F.format_string("%dh ago", F.floor(seconds / 3600))).otherwise(F.format_string("%dd ago", F.floor(seconds / 86400)))
    )


def chunk_ref(ref: str) -> tuple[str | None, int | None]:
    """"path:2" -> (path, 2); "42" -> (None, 42), a chunk id; "path" -> (path, None)."""
    if ref.isdigit():
        return None, int(ref)
    m = re.match(r"^(.+):(\d+)$", ref)
    return (m[1], int(m[2])) if m else (ref, None)
