"""Licence scan: a positional index of each template's rarest words.

The words of a text are looked up in the index, the places of a template's two rarest words
are intersected by relative position, and the mandatory key phrase is verified in place.
One projection per row: no join, no shuffle, no Python.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """``words`` is the notice; ``key`` the phrase within it that must stand word for word."""

    label: str
    words: str
    key: str
    base: bool = False


# The phrases of the base scan and short public licence notices.
TEMPLATES = [
    Template("mit", "under the mit license", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", "cc by nc", base=True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "permission is hereby granted free of charge"),
    Template("mit", "spdx license identifier mit", "spdx license identifier mit"),
    Template("apache-2", "spdx license identifier apache 2 0", "identifier apache 2 0"),
    Template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl-3", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose",
             "permission to use copy modify and or distribute this software"),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             "free and unencumbered software"),
    Template("cc0", "cc0 1 0 universal", "cc0 1 0 universal"),
    Template("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("proprietary", "all rights reserved", "all rights reserved"),
]


def rarest(template: Template, templates: list[Template]) -> tuple[tuple[str, int], tuple[str, int]]:
    """The two words of the key with the highest IDF over the templates, with their places.

    A word's place is its first one in the key. Ties go to the longer, then the earlier word.
    """
    seen = Counter(w for t in templates for w in set(t.words.split()))
    words, key = template.words.split(), template.key.split()
    at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
    order = sorted(set(key), key=lambda w: (-math.log(len(templates) / seen[w]), -len(w), key.index(w)))
    one, two = order[0], order[1]
    return (one, at + key.index(one)), (two, at + key.index(two))


def _phrase(words: str, start: str, offset: int, n: int) -> str:
    return f"concat_ws(' ', slice({words}, {start} + {offset + 1}, {n}))"


def scan_licenses(df: DataFrame, text: str = "text", templates: list[Template] | None = None) -> DataFrame:
    """Adds ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``,
    ``score`` and ``places`` (label, start) to each row.

    ``score`` is the largest share of a found template's words that stand in place, 0 without
    one. A null or empty text has no words, no labels and score 0. Repeated rows are scanned
    each for themselves. Columns of the input with those names are replaced. Ties between templates
    keep all their labels; an empty table gives no rows.
    """
    templates = TEMPLATES if templates is None else templates
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
    df = df.drop(*[c for c in added if c != text])
    index = {t: rarest(t, templates) for t in templates}
    looked_up = sorted({w for pair in index.values() for w, _ in pair})
    in_index = ", ".join(f"'{w}'" for w in looked_up)
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    df = df.withColumn("_line", F.trim(F.regexp_replace(lowered, SEPARATORS, " ")))
    df = df.withColumn("_words", F.split("_line", " "))
    df = df.withColumn(
        "_hits",
        F.expr(f"filter(transform(_words, (w, i) -> if(w IN ({in_index}), struct(w, i), null)), x -> x IS NOT NULL)"),
    )
    found = []
    for t in templates:
        (one, p), (two, q) = index[t]
        words, key = t.words.split(), t.key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        starts = (
            f"array_intersect(transform(filter(_hits, x -> x.w = '{one}'), x -> x.i - {p}),"
            f" transform(filter(_hits, x -> x.w = '{two}'), x -> x.i - {q}))"
        )
        # Words of the notice before the key may lie in front of the text.
        share = " + ".join(f"int(coalesce(get(_words, s + {i}), '') = '{w}')" for i, w in enumerate(words))
        found.append(
            f"transform(filter({starts}, s -> s + {at} >= 0 AND {_phrase('_words', 's', at, len(key))} = '{t.key}'),"
            f" s -> struct('{t.label}' AS label, {str(t.base).lower()} AS base, s AS start,"
            f" ({share}) / {float(len(words))}D AS share))"
        )
    none = "cast(array() AS array<struct<label: string, base: boolean, start: int, share: double>>)"
    df = df.withColumn("_found", F.expr(f"if(size(_hits) = 0, {none}, concat({', '.join(found)}))"))
    df = df.withColumn("_base", F.expr("filter(_found, x -> x.base)"))

    def labels(places: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.col(f"{places}.label"))), ",")

    return df.withColumns(
        {
            "n_words": F.expr("if(_line = '', 0L, bigint(size(_words)))"),
            "n_base": F.size("_base").cast("long"),
            "first_word": F.array_min("_base.start").cast("long"),
            "last_word": F.array_max("_base.start").cast("long"),
            "base_labels": labels("_base"),
            "labels": labels("_found"),
            "score": F.coalesce(F.array_max("_found.share"), F.lit(0.0)),
            "places": F.expr("transform(_found, x -> struct(x.label, x.start))"),
        }
    ).drop("_line", "_words", "_hits", "_found", "_base")
