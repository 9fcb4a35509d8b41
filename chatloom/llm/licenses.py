"""License scan by MinHash bands over overlapping windows, in DataFrame operations alone.

A text is cut into windows that overlap so far that every run as long as a template lies inside one of them. Window and
template share the bands of their MinHash signatures with a probability that `collision` gives and the settings hold
above `SURE`; a shared band makes a candidate, and the exact share of the template's shingles in the window decides.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from chatloom.llm.common import KEY, UPPER, Query, pinned, table, text_key
from chatloom.llm.decontaminate import WORD, grams, words
from chatloom.session import materialise

# Public license notices, as they stand in texts and file headers.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Unless required by applicable law or agreed to in writing, software distributed under the License is "
    "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the Software.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
SHINGLE = 3
BANDS = 24
ROWS = 1
# Share of a template's shingles that a window must hold.
CONTAINED = 0.8
SURE = 0.9999


def collision(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Probability that two sets of this Jaccard similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def least_similarity(length: int, contained: float = CONTAINED, shingle: int = SHINGLE) -> float:
    """Least Jaccard similarity of a template of `length` words and a window that holds `contained` of its shingles."""
    own, span = length - shingle + 1, length + stride(length) - shingle + 1
    held = max(1, -(-own * contained // 1))
    return held / (own + span - held)


def stride(length: int) -> int:
    return max(1, length // 2)


def _permuted(x: Column, seed: int) -> Column:
    return F.xxhash64(x, F.lit(seed))


def _bands(shingles: Column, bands: int, rows: int) -> Column:
    """One hash per band; each row of a band is the least value of one permutation."""
    def low(seed: int) -> Column:
        return F.array_min(F.transform(shingles, lambda x: _permuted(x, seed)))

    return F.array(*(F.xxhash64(F.lit(b), *(low(b * rows + r) for r in range(rows))) for b in range(bands)))


def scan_licenses(
    docs: DataFrame,
    templates: Mapping[str, str] | DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    bands: int = BANDS,
    rows: int = ROWS,
    contained: float = CONTAINED,
) -> DataFrame:
    """One row per row of `docs`: `id_col`, licenses (sorted names), containment (the highest share found, else null).

    `templates` is a mapping or a table (name, text); templates of fewer than three words can't be scanned for and raise
    an error, as do settings whose collision probability is below `SURE` for a template. Null, empty and wordless texts
    hold no license; equal texts get equal results; rows with repeated or null ids each keep a row.
    """
    spark = docs.sparkSession
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame(sorted((templates or NOTICES).items()), "name string, text string")
    cut = pinned(templates.select(F.col("name").alias("_name"), F.col("text").alias("_text")), "_name", _w=words(F.col("_text")))
    cut = pinned(cut, "_name", _h=F.transform("_w", lambda w: F.xxhash64(w)), _t=F.size("_w"))
    cut = pinned(cut, "_name", "_t", _s=F.array_distinct(grams(F.col("_h"), F.col("_t"), SHINGLE)))
    cut = materialise(cut, "license-templates")
    # One number per length of template, not per template.
    lengths = sorted(r[0] for r in cut.select("_t").distinct().collect())
    for n in lengths:
        if n < SHINGLE:
            raise ValueError(f"a template needs at least {SHINGLE} words")
        if collision(least_similarity(n, contained), bands, rows) < SURE:
            raise ValueError(f"{bands} bands of {rows} rows are too few for templates of {n} words")
    marks = cut.select("_name", "_t", "_s", F.posexplode(_bands(F.col("_s"), bands, rows)).alias("_b", "_band"))
    marks = materialise(marks, "license-bands")
    # A band can only be shared where the window holds a shingle that is least in the template under some permutation.
    lows = [
        F.array_min(F.transform("_s", lambda x, j=j: F.struct(_permuted(x, j).alias("p"), x.alias("x"))))["x"]
        for j in range(bands * rows)
    ]
    lows = materialise(cut.select(F.explode(F.array_distinct(F.array(*lows))).alias("_x")).distinct(), "license-lows")

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumns(
        dict(zip(KEY, text_key(F.col("_text"))))
    )

    def shingled(df: DataFrame) -> DataFrame:
        df = pinned(df, *KEY, _h=F.transform(words(F.col("_text")), lambda w: F.xxhash64(w)))
        return pinned(df, *KEY, _n=F.size("_h"), _s=grams(F.col("_h"), F.size("_h"), SHINGLE))

    # written first: its size is known then, and where it is small the scan below filters in place
    met = shingled(texts).select(*KEY, F.explode("_s").alias("_x")).join(lows, "_x", "left_semi").select(*KEY).distinct()
    met = materialise(met, "license-met")
    near = texts.select(*KEY, "_text").join(met, KEY, "left_semi").groupBy(*KEY).agg(F.first("_text").alias("_text"))
    near = materialise(shingled(near), "license-near")
    # where the shingles are that a band can be shared by: the same reduction, window by window
    at = near.select(*KEY, F.posexplode("_s").alias("_p", "_x")).join(lows, "_x", "left_semi")
    near = near.join(at.groupBy(*KEY).agg(F.collect_list("_p").alias("_at")), KEY)
    near = materialise(near, "license-places")

    found = None
    for n in lengths:
        step = stride(n)
        span = n + step - SHINGLE + 1
        # window m holds the shingles m * step to m * step + span - 1
        holding = F.array_distinct(F.flatten(F.transform("_at", lambda p: F.sequence(
            F.greatest(F.lit(0), F.ceil((p - span + 1) / step)).cast("int"), F.floor(p / step).cast("int")))))
        windows = near.select(*KEY, F.explode(F.transform(
            holding, lambda m: F.array_distinct(F.slice("_s", m * step + 1, span)))).alias("_win"))
        banded = windows.select(*KEY, "_win", F.posexplode(_bands(F.col("_win"), bands, rows)).alias("_b", "_band"))
        own = marks.where(F.col("_t") == n)
        share = F.size(F.array_intersect("_win", "_s")) / F.size("_s")
        hits = banded.join(own, ["_b", "_band"]).select(*KEY, "_name", share.alias("_share")).where(F.col("_share") >= contained)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], "_k1 long, _k2 long, _name string, _share double")
    best = found.groupBy(*KEY).agg(
        F.array_sort(F.collect_set("_name")).alias("licenses"), F.max("_share").alias("containment")
    )
    return texts.select("_id", *KEY).join(materialise(best, "license-found"), KEY, "left").select(
        F.col("_id").alias(id_col), F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), "containment"
    )


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    """All documents against the public notices."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("licenses").cast("bigint").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"),
        F.round("containment", 6).alias("containment"),
    )


def _sql() -> str:
    """Every window of every text against every template, without bands."""
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}')"
    listed = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(NOTICES.items()))
    shingles = "[array_to_string(w[i:i + {}], ' ') for i in range(1, len(w) - {})]".format(SHINGLE - 1, SHINGLE - 2)
    return f"""
    WITH t AS (SELECT name, len(w) AS t, list_distinct({shingles}) AS ts, greatest(len(w) // 2, 1) AS step
      FROM (SELECT name, {split} AS w FROM (VALUES {listed}) v(name, text))),
    d AS (SELECT rid, doc_id, {shingles} AS s FROM (SELECT row_number() OVER () AS rid, doc_id, {split} AS w FROM documents)),
    win AS (SELECT rid, name, ts, s[i:i + t + step - {SHINGLE}] AS ws
      FROM (SELECT *, unnest(range(1, len(s) + 1, step)) AS i FROM d, t WHERE list_has_any(s, ts))),
    hit AS (SELECT rid, name, len(list_distinct(list_intersect(ws, ts))) / len(ts) AS share FROM win),
    best AS (SELECT rid, list_sort(list(DISTINCT name)) AS names, max(share) AS share FROM hit WHERE share >= {CONTAINED} GROUP BY rid)
    SELECT doc_id, coalesce(len(names), 0)::BIGINT AS n_licenses, coalesce(array_to_string(names, ','), '') AS licenses,
      round(share, 6) AS containment FROM d LEFT JOIN best USING (rid)"""


QUERIES = {"op5_licenses": Query(op5_licenses, _sql())}
