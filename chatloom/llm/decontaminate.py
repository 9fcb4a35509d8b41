"""Benchmark decontamination by winnowing, in DataFrame operations alone.

Every 13-word window has six 8-word grams; both sides keep the least gram hash of each window. A window that a document
shares with the benchmark has the same grams on both sides, so its least gram is kept on both: joining the kept hashes
finds every shared window. Each hit is then extended to the windows around it, which are compared as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chatloom.llm.common import KEY, UPPER, Query, ascii_lower, pinned, quoted, table, text_key, unused
from chatloom.session import materialise

WINDOW = 13
GRAM = 8
# A document is contaminated when at least one word in twenty is hit.
HIT_SHARE = 20
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def grams(hashes: Column, size: Column, n: int) -> Column:
    """Hash of every run of `n` words."""
    each = F.transform(F.sequence(F.lit(1), size - F.lit(n - 1)), lambda i: F.xxhash64(F.slice(hashes, i, n)))
    return F.when(size >= n, each).otherwise(F.array().cast("array<bigint>"))


def least(gram_hashes: Column, size: Column, window: int, n: int) -> Column:
    """The least gram hash of each window, without repeats."""
    starts = F.sequence(F.lit(1), size - F.lit(window - 1))
    kept = F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(gram_hashes, i, window - n + 1))))
    return F.when(size >= window, kept).otherwise(F.array().cast("array<bigint>"))


def _worded(df: DataFrame, *kept: Column) -> DataFrame:
    """`_w` words, `_h` their hashes, `_n` their number."""
    df = pinned(df, *kept, _w=words(F.col("_text")))
    return pinned(df, "*", _h=F.transform("_w", lambda w: F.xxhash64(w)), _n=F.size("_w"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
) -> DataFrame:
    """One row per row of `docs`: `id_col`, n_words, n_hit, n_items, item_ids, contaminated.

    A null, empty or wordless text has no words and is clean; so is every text when the benchmark is empty. A wordless
    item matches nothing; an item without an id counts as the id ''. Rows with the same id or text each keep a row.
    Other columns of either table are not read. Nothing is broadcast by hand: Spark joins the benchmark side by its
    measured size.
    """
    return _verdicts(docs, benchmark, id_col, text_col, item_col, item_text_col, window, gram).drop(*KEY)


def contaminated_keys(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Keys (see `common.text_key`) of the contaminated texts."""
    keyed = docs.select(F.lit(0).alias("_id"), F.col(text_col).alias("_text"))
    found = _verdicts(keyed, benchmark, "_id", "_text", **options)
    return found.where("contaminated").select(*KEY).distinct()


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that are not contaminated, with their columns."""
    bad = materialise(contaminated_keys(docs, benchmark, text_col, **options), "decontaminate-bad")
    own = [unused(docs, n) for n in ("text_1", "text_2")]
    keyed = docs.withColumns(dict(zip(own, text_key(F.col(text_col)))))
    # the text key of a null is a number as well
    return keyed.join(bad, (keyed[own[0]] == bad[KEY[0]]) & (keyed[own[1]] == bad[KEY[1]]), "left_anti").select(*quoted(docs.columns))


def _verdicts(docs, benchmark, id_col, text_col, item_col="item_id", item_text_col="text", window=WINDOW, gram=GRAM):
    items = _worded(
        benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("_item"), F.col(item_text_col).alias("_text")),
        F.col("_item"),
    ).where("_n > 0")
    # Windows of the items: (length, text) -> item, and the hash that must find each.
    length = F.least(F.col("_n"), F.lit(window))
    item_windows = pinned(items, "_item", "_w", "_n", _len=length).select(
        "_item", "_len",
        F.explode(F.transform(
            F.sequence(F.lit(1), F.col("_n") - F.col("_len") + 1), lambda i: F.array_join(F.slice("_w", i, F.col("_len")), " ")
        )).alias("_window"),
    ).distinct()
    item_windows = materialise(item_windows, "decontaminate-windows")
    marks = pinned(items, "*", _g=grams(F.col("_h"), F.col("_n"), gram)).select(F.explode(
        F.when(F.col("_n") >= window, least(F.col("_g"), F.col("_n"), window, gram)).otherwise(F.array(F.xxhash64("_h")))
    ).alias("_mark")).distinct()
    marks = materialise(marks, "decontaminate-marks")
    # At most `window` - 1 numbers: the lengths of the items that are shorter than a window.
    short = sorted(r[0] for r in item_windows.where(F.col("_len") < window).select("_len").distinct().collect())

    def hashed(df: DataFrame) -> DataFrame:
        return pinned(df, "*", _g=grams(F.col("_h"), F.col("_n"), gram))

    def short_grams() -> list[Column]:
        return [grams(F.col("_h"), F.col("_n"), n) for n in short]

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumns(
        dict(zip(KEY, text_key(F.col("_text"))))
    )
    kept = least(F.col("_g"), F.col("_n"), window, gram)
    marked = hashed(_worded(texts, F.col("_id"), *map(F.col, KEY))).select(
        "_id", *KEY, F.col("_n").cast("bigint").alias("n_words"),
        (F.array_distinct(F.concat(kept, *short_grams())) if short else kept).alias("_marks"),
    )
    marked = materialise(marked, "decontaminate-docs")
    met = marked.select(*KEY, F.explode("_marks").alias("_mark")).join(marks, "_mark", "left_semi").select(*KEY).distinct()
    met = materialise(met, "decontaminate-met")

    # Only texts that share a hash are read a second time, each text once. Their keys are written, so Spark knows their size,
    # and where they are few the scan filters in place.
    near = texts.select(*KEY, "_text").join(met, KEY, "left_semi").groupBy(*KEY).agg(F.first("_text").alias("_text"))
    near = materialise(hashed(_worded(near, *map(F.col, KEY))), "decontaminate-near")
    # Where the hits begin: gram hits reach back to every window that holds them, short items begin at their own hit.
    places = [near.select(*KEY, F.lit(window).alias("_len"), F.posexplode("_g").alias("_p", "_mark"))]
    places += [
        near.select(*KEY, F.lit(n).alias("_len"), F.posexplode(g).alias("_p", "_mark")) for n, g in zip(short, short_grams())
    ]
    hits = places[0]
    for more in places[1:]:
        hits = hits.unionByName(more)
    hits = hits.join(marks, "_mark", "left_semi").groupBy(*KEY, "_len").agg(F.collect_list("_p").alias("_ps"))
    back = F.when(F.col("_len") == window, F.lit(window - gram)).otherwise(F.lit(0))
    last = F.col("_n") - F.col("_len") + 1
    # positions count from 0, starts from 1
    reach = F.transform("_ps", lambda p: F.sequence(F.greatest(F.lit(1), p + 1 - back), p + 1))
    starts = F.filter(F.array_distinct(F.flatten(reach)), lambda s: s <= last)
    tried = near.join(hits, KEY).select(*KEY, "_len", F.explode(F.transform(
        starts, lambda s: F.struct(s.alias("s"), F.array_join(F.slice("_w", s, F.col("_len")), " ").alias("window"))
    )).alias("_try")).select(*KEY, "_len", F.col("_try.s").alias("_s"), F.col("_try.window").alias("_window"))
    windows = item_windows.select("_len", "_window").distinct()
    found = materialise(tried.join(windows, ["_len", "_window"], "left_semi"), "decontaminate-found")

    covered = F.flatten(F.collect_list(F.sequence(F.col("_s"), F.col("_s") + F.col("_len") - 1)))
    hit = found.groupBy(*KEY).agg(F.size(F.array_distinct(covered)).cast("bigint").alias("n_hit"))
    named = found.select(*KEY, "_len", "_window").distinct().join(item_windows, ["_len", "_window"]).select(*KEY, "_item").distinct()
    named = named.groupBy(*KEY).agg(F.array_sort(F.collect_list("_item")).alias("item_ids"))
    # one row per text that holds a window, however many copies the text has
    per_text = materialise(hit.join(named, KEY), "decontaminate-texts")
    out = marked.drop("_marks").join(per_text, KEY, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(
        *KEY, F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
        ids.alias("item_ids"),
        ((n_hit > 0) & (n_hit * HIT_SHARE >= F.col("n_words"))).alias("contaminated"),
    )


def op3_winnowing(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


def sql_over(documents: str = "documents", benchmark: str = "benchmark") -> str:
    """DuckDB SQL of `op3_winnowing`: all windows of all texts, compared one by one."""
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {split} AS w FROM {documents}),
    b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, w, least(len(w), {WINDOW}) AS n
      FROM (SELECT item_id, {split} AS w FROM {benchmark}) WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS win
      FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM b)),
    sizes AS (SELECT DISTINCT n FROM bw),
    dw AS (SELECT rid, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
      FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
    hit AS (SELECT rid, s, n, item FROM dw JOIN bw USING (n, win)),
    covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid),
    named AS (SELECT rid, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids
      FROM hit GROUP BY rid)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND coalesce(n_hit, 0) * {HIT_SHARE} >= len(w) AS contaminated
    FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)"""


QUERIES = {"op3_winnowing": Query(op3_winnowing, sql_over())}
