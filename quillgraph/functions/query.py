"""What a query's wording says: its identifiers and the words whose closeness counts.  A query is one value, so this is no column work."""

from __future__ import annotations

import re

# Words that identify nothing.
STOP_WORDS = set("the and for with from that this have are was not all but how".split())
# What a whole project is called in a question.
WHOLE_PROJECT = ("everywhere", "all files", "project-wide", "entire project")
_PARTS = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}(?=[A-Z][a-z]|\b)|[a-z_]\w{2,}")
_WHOLE = re.compile(r"[a-zA-Z_]\w{2,}")
_LONG = re.compile(r"\b[a-zA-Z]{4,}\b")


def identifiers(query: str) -> list[str]:
    """The names and parts of names in a query, each once, in order of first appearance; stop words are left out."""
    found = sorted([(m.start(), -len(m.group()), m.group()) for p in (_PARTS, _WHOLE) for m in p.finditer(query)])
    return [w for w in dict.fromkeys(x for *_, x in found) if w.lower() not in STOP_WORDS]


def proximity_terms(query: str) -> list[str]:
    """The query's identifiers and its words of four letters or more, in lower case, each once."""
    words = [*identifiers(query), *_LONG.findall(query)]
    return [w for w in dict.fromkeys(x.lower() for x in words) if w not in STOP_WORDS]


def wants_everything(query: str) -> bool:
    """Whether a question says that it is about the whole project."""
    return any(x in query.lower() for x in WHOLE_PROJECT)
