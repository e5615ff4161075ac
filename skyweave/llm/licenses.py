"""License scan with DataFrame functions only.

Base: places where a phrase's words stand consecutively. Method: an exact set-similarity join of text blocks with
license templates by containment, |block and template| / |template| >= CONTAINMENT. A block is a line; a line of at most
WIDE characters that such a line follows is taken together with up to two of those that follow, as notices are wrapped.
Template tokens are ordered by their frequency over all lines of the corpus, rarest first, in blocks and templates alike.
A block can reach the threshold only if it has `need` template tokens at all (length) and holds one of a template's
first |T| - need + 1 tokens (prefix) such that, from there on, both still have enough tokens for `need` with it
(position); blocks that pass are intersected with the whole template. Templates are a fixed list, so they are literals:
the join needs no shuffle; only the few dozen frequencies are aggregated.

Null text counts as empty: no words, no labels, score 0, null first and last word. Every row is scanned by itself, so
repeated rows and null ids are no special case; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = {
    "apache license": "apache",
    "cc by": "cc-by",
    "gnu general public license": "gpl",
    "mit license": "mit",
}
#: Opening words of well-known license notices and their labels.
TEMPLATES = [
    ("all-rights-reserved", "all rights reserved"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("apache-short", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution international license"),
    ("cc-by-short", "licensed under cc by"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
]
CONTAINMENT = 0.8
WIDE = 100
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def needed(size: int) -> int:
    """Smallest overlap that reaches the threshold."""
    return -(-size * round(CONTAINMENT * 100) // 100)


def _lower() -> Column:
    return F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)


def _spaced(text: Column) -> Column:
    """The words, each with a space of its own on both sides."""
    words = F.trim(F.regexp_replace(text, BETWEEN, "  "))
    return F.when(words != "", F.concat(F.lit(" "), words, F.lit(" "))).otherwise("")


def _words(spaced: Column) -> Column:
    return ((F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def _held(line: Column, vocabulary: list[str]) -> Column:
    return F.array_intersect(F.split(F.regexp_replace(line, BETWEEN, " "), " "), F.array(*map(F.lit, vocabulary)))


def _lines(vocabulary: list[str]) -> Column:
    """Of each line of the text the template words it holds, and whether it may be part of a wrapped notice."""
    return F.transform(F.split(_lower(), "\n"), lambda x: F.struct(_held(x, vocabulary).alias("words"), (F.length(x) <= WIDE).alias("narrow")))


def _blocks(lines: Column, ordered: list[str], least: int) -> Column:
    """Blocks of at least `least` template words (a length filter), each in the order of `ordered`."""
    none = F.array().cast("array<string>")
    after = lambda k: F.slice(lines, 1 + k, 1 << 30)
    more = F.zip_with(after(1), after(2), lambda b, c: F.when(b.narrow, F.concat(b.words, F.when(c.narrow, c.words).otherwise(none))).otherwise(none))
    blocks = F.zip_with(lines, more, lambda a, m: F.when(a.narrow & m.isNotNull(), F.concat(a.words, m)).otherwise(a.words))
    blocks = F.filter(blocks, lambda b: F.size(b) >= least)
    in_order = F.transform(blocks, lambda b: F.array_intersect(F.array(*map(F.lit, ordered)), b))
    return F.filter(in_order, lambda b: F.size(b) >= least)


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Of each template word the number of lines of the corpus that hold it."""
    words = docs.select(F.explode(F.flatten(F.transform(F.split(_lower(), "\n"), lambda x: _held(x, vocabulary)))).alias("word"))
    return {r["word"]: r["n"] for r in words.groupBy("word").agg(F.count("*").alias("n")).collect()}


def _containment(tokens: list[str]) -> Column:
    """Largest overlap of a block with a template (tokens rarest first) among those the filters let through."""
    size = len(tokens)
    need = needed(size)

    def passes(block: Column) -> Column:
        at = [(F.array_position(block, t) > 0) & (1 + F.least(F.lit(size - p - 1), F.size(block) - F.array_position(block, t)) >= need) for p, t in enumerate(tokens[: size - need + 1])]
        ok = at[0]
        for x in at[1:]:
            ok = ok | x
        return (F.size(block) >= need) & ok

    overlaps = F.transform(F.filter("blocks", passes), lambda b: F.size(F.array_intersect(b, F.array(*map(F.lit, tokens)))))
    best = F.coalesce(F.array_max(overlaps), F.lit(0))
    return F.when(best >= need, best / F.lit(size)).otherwise(0.0)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    templates = [(label, sorted(set(text.split()))) for label, text in TEMPLATES]
    vocabulary = sorted({w for _, words in templates for w in words})
    seen = frequencies(docs, vocabulary)
    rarity = lambda w: (seen.get(w, 0), w)
    least = min(needed(len(words)) for _, words in templates)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _lower().alias("low"), _lines(vocabulary).alias("lines"))
    rows = rows.select("doc_id", "low", _blocks(F.col("lines"), sorted(vocabulary, key=rarity), least).alias("blocks"))
    rows = rows.select("doc_id", _spaced(F.col("low")).alias("s"), *(_containment(sorted(words, key=rarity)).alias(f"t{k}") for k, (_, words) in enumerate(templates)))
    marks = {p: " " + "  ".join(p.split()) + " " for p in PHRASES}
    s = F.col("s")
    rows = rows.select("*", _words(s).alias("n_words"), *(((F.octet_length(s) - F.octet_length(F.replace(s, F.lit(m), F.lit("")))) / len(m)).cast("long").alias(f"c{k}") for k, m in enumerate(marks.values())))
    starts = [F.when(F.col(f"c{k}") > 0, _words(F.substring_index("s", m, 1))) for k, m in enumerate(marks.values())]
    ends = [F.when(F.col(f"c{k}") > 0, F.col("n_words") - _words(F.substring_index("s", m, -1)) - len(p.split())) for k, (p, m) in enumerate(marks.items())]
    n_base = sum((F.col(f"c{k}") for k in range(1, len(marks))), F.col("c0"))
    base = [F.when(F.col(f"c{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]
    own = [F.when(F.col(f"t{k}") > 0, F.lit(label.removesuffix("-short"))) for k, (label, _) in enumerate(templates)]
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")
    return rows.select(
        "doc_id", "n_words", n_base.alias("n_base"), F.least(*starts).alias("first_word"), F.greatest(*ends).alias("last_word"), text(base).alias("base_labels"), text(base + own).alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.greatest(*(F.col(f"t{k}") for k in range(len(templates))))).alias("score"),
    )


def oracle_sql() -> str:
    """The same rows in DuckDB, by plain intersection with every template."""
    between = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    lists = [(label, sorted(set(t.split()))) for label, t in TEMPLATES]
    best = ", ".join(f"coalesce(list_max(list_transform(blocks, lambda b: len(list_intersect(b, {words!r})))), 0) AS o{k}" for k, (_, words) in enumerate(lists))
    share = ", ".join(f"CASE WHEN o{k} >= {needed(len(w))} THEN o{k} / {len(w)}.0::DOUBLE ELSE 0 END AS t{k}" for k, (_, w) in enumerate(lists))
    marks = [" " + "  ".join(p.split()) + " " for p in PHRASES]
    cuts = ", ".join(f"string_split(s, '{m}') AS p{k}" for k, m in enumerate(marks))
    words = lambda x: f"((length({x}) - length(replace({x}, ' ', ''))) // 2)"
    n = "(" + " + ".join(f"len(p{k}) - 1" for k in range(len(marks))) + ")"
    first = ", ".join(f"CASE WHEN len(p{k}) > 1 THEN {words(f'p{k}[1]')} END" for k in range(len(marks)))
    last = ", ".join(f"CASE WHEN len(p{k}) > 1 THEN {words('s')} - {words(f'p{k}[-1]')} - {len(p.split())} END" for k, p in enumerate(PHRASES))
    base = ", ".join(f"CASE WHEN len(p{k}) > 1 THEN '{label}' END" for k, label in enumerate(PHRASES.values()))
    own = ", ".join(f"CASE WHEN t{k} > 0 THEN '{label.removesuffix('-short')}' END" for k, (label, _) in enumerate(lists))
    joined = lambda x: f"array_to_string(list_sort(list_distinct(list_filter([{x}], lambda v: v IS NOT NULL))), ',')"
    return f"""
WITH l AS (SELECT doc_id, trim(regexp_replace({low}, '{between}', '  ', 'g'), ' ') AS w,
  list_transform(string_split({low}, chr(10)), lambda x: {{'words': string_split(regexp_replace(x, '{between}', ' ', 'g'), ' '), 'narrow': length(x) <= {WIDE}}}) AS lines FROM documents),
a AS (SELECT doc_id, w, list_transform(range(1, len(lines) + 1), lambda i: list_distinct(CASE WHEN lines[i].narrow AND lines[i + 1].narrow
  THEN lines[i].words || lines[i + 1].words || CASE WHEN lines[i + 2].narrow THEN lines[i + 2].words ELSE [] END ELSE lines[i].words END)) AS blocks FROM l),
b AS (SELECT doc_id, CASE WHEN w = '' THEN '' ELSE ' ' || w || ' ' END AS s, {best} FROM a),
c AS (SELECT doc_id, s, {cuts}, {share} FROM b)
SELECT doc_id, {words('s')}::BIGINT AS n_words, {n}::BIGINT AS n_base, least({first})::BIGINT AS first_word, greatest({last})::BIGINT AS last_word,
  {joined(base)} AS base_labels, {joined(base + ', ' + own)} AS labels,
  CASE WHEN {n} > 0 THEN 1.0::DOUBLE ELSE greatest({', '.join(f't{k}' for k in range(len(lists)))})::DOUBLE END AS score FROM c"""
