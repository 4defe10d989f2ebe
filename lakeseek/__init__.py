"""Hybrid retrieval and corpus processing over Spark DataFrames."""

from .engine import Engine
from .functions.paths import is_simple_pattern, is_text_mime, language
from .functions.text import content_hash
from .operators.chunking import chunk_lines, chunk_syntax, line_windows
from .operators.providers import MODELS, Model, embed, models_table, resolve_dimensions, resolve_model
from .operators.search import Options, SearchError, path_filter, search
from .session import session
from .sources.store import Store
from .sources.tree import ignore_patterns, scan

__all__ = [
    "MODELS", "Engine", "Model", "Options", "SearchError", "Store", "chunk_lines", "chunk_syntax", "content_hash", "embed", "ignore_patterns", "is_simple_pattern", "is_text_mime",
    "language", "line_windows", "models_table", "path_filter", "resolve_dimensions", "resolve_model", "scan", "search", "session",
]
