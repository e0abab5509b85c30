"""Identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too common in code to tell anything.
STOPWORDS = [
    "the", "and", "for", "from", "with", "this", "that", "get", "set", "new", "has", "not", "but", "are", "was", "let", "var", "const", "function", "return", "import", "export",
    "default", "class", "type", "interface", "string", "number", "boolean", "void", "null", "undefined", "true", "false", "index", "src", "lib", "test", "tests", "spec",
]


def split_identifier(name: Column) -> Column:
    """Lower-case words of an identifier or path: camel case and acronyms split, letters only, three at least, without stopwords."""
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.transform(F.split(spaced, r"[\s_\-./\\:#]+"), lambda w: F.regexp_replace(F.lower(w), "[^a-z]", ""))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS))


def slug(text: Column, size: int = 30) -> Column:
    """Lower case, runs of other characters as one ``-``, none at the ends, cut to ``size``."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, size)
