"""JSON inside pages and responses: walks over objects of any shape, and fields with defaults.

The walks need recursion into unknown shapes, so they are Arrow-batched Python functions; text that is no
JSON gives nothing.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kithgraph.functions import urls


def _objects(node):
    """All objects, parents before children, in document order."""
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            yield x
            todo.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            todo.extend(reversed(x))


def _parsed(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return None


def jsonld_names(html: Column, kind: str = "Person") -> Column:
    """Names of the objects of a type in a page's linked data, each once whatever its case, in order."""

    @F.pandas_udf("array<string>")
    def names_of(bodies: pd.Series) -> pd.Series:
        def one(texts):
            out: dict[str, str] = {}
            for text in [] if texts is None else texts:
                for x in _objects(_parsed(text)):
                    kinds, name = x.get("@type", ""), x.get("name")
                    if kind in (kinds if isinstance(kinds, list) else [kinds]) and isinstance(name, str) and name.strip():
                        out.setdefault(name.strip().lower(), name.strip())
            return list(out.values())

        return bodies.map(one)

    return names_of(urls.jsonld_bodies(html))


def harvested(text: Column, key: str, *fields: str) -> Column:
    """Objects that have ``key`` and all ``fields``, wherever they are nested; of one key's value the first object counts."""

    @F.pandas_udf("array<map<string,string>>")
    def found(texts: pd.Series) -> pd.Series:
        def one(raw):
            out: dict[str, dict[str, str]] = {}
            for x in _objects(_parsed(raw)):
                if all(isinstance(x.get(f), (str, int, float)) for f in (key, *fields)):
                    out.setdefault(str(x[key]), {f: str(x[f]) for f in (key, *fields)})
            return list(out.values())

        return texts.map(one)

    return found(text)


def field(text: Column, path: str, default: str = "") -> Column:
    """A nested value, or the default where any step is absent or the text is no JSON."""
    return F.coalesce(F.get_json_object(text, path), F.lit(default))


def merged(old: Column, new: Column) -> Column:
    """A shallow merge of two maps; where both have a key, the new value holds. A null map is empty."""
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
