"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words of an item in a row of `window` (or all words of a shorter item) are a window; a document word inside any occurrence
of a window is hit. Documents and items are fingerprinted alike: the least hash of the `gram`-word grams in each stretch of
`window` words. A shared window so always shares a fingerprint; documents that share one are candidates, and hits are
extended there to whole windows, compared by 128 bits of hash. Windows of short items are looked up as they are.

Given results: a null text has no words; such a document, as one without any word, has no hits, and is not contaminated.
Items without words, and null items, have no windows. An item without an id hits words but is not listed; a repeated item id
is listed once. Repeated documents each keep their row, whatever their id. Without documents the result is empty; without
items no document has a hit. Other columns are ignored by `contamination` and kept by `clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import LOWER, UPPER, ascii_lower, discard, materialise, numbered, place_of, small

#: What separates words once A-Z are lower case.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 13, 4
#: Rows up to which a table of fingerprints, windows or candidates (some tens of bytes a row) is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Words as an array: the parts between breaks, without the empty ones at either end."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK)
    lead = (F.get(parts, F.lit(0)) == "").cast("int")
    trail = (F.element_at(parts, -1) == "").cast("int")
    return F.slice(parts, lead + 1, F.greatest(F.size(parts) - lead - trail, F.lit(0)))


def least_of(array: str, span: int, shape: tuple[int, ...]) -> Column:
    """Least of array[i], array[i + span], ... for each i, for as many as `shape` has; the end of the array is ignored."""
    return F.transform(array, lambda x, i: F.least(x, *[F.get(F.col(array), i + span * s) for s in shape]))


def fingerprints(rows: DataFrame, keep: list[str], window: int, gram: int) -> DataFrame:
    """keep, and an array `fp` of the winnowed fingerprints of the column `w` of words; null where there are too few.

    Arrays go through explode_outer() below, and no filter stands on them: the optimizer would push it, and what it infers
    from explode(), through these projections, and compute the whole chain anew for each element.
    """
    grams = F.transform("w", lambda x, i: F.xxhash64(x, *[F.get(F.col("w"), i + j) for j in range(1, gram)]))
    out = rows.select(*keep, F.when(F.size("w") >= window, grams).alias("g"))
    # the least of so many grams, by stretches of growing length that overlap
    have, need = 1, window - gram + 1
    while have < need:
        steps = [have * s for s in (1, 2, 3) if have * s + have <= need]
        if have * (len(steps) + 1) < need and len(steps) < 3:
            steps.append(need - have)
        out = out.select(*keep, least_of("g", 1, tuple(steps)).alias("g"))
        have = max(steps) + have
    # stretches that reach over the end are cut off
    return out.select(*keep, F.array_distinct(F.slice("g", 1, F.greatest(F.size("g") - (need - 1), F.lit(0)))).alias("fp"))


def spans(column: str, m: int) -> Column:
    """(at, m, h1, h2) for each m words in a row of the array of words."""
    return F.when(
        F.size(column) >= m,
        F.transform(
            F.sequence(F.lit(1), F.size(column) - (m - 1)),
            lambda i: F.struct(i.alias("at"), F.lit(m).alias("m"), F.xxhash64(F.slice(column, i, m)).alias("h1"), F.xxhash64(F.lit(7), F.slice(column, i, m)).alias("h2")),
        ),
    )


def text_key(text: Column) -> list[Column]:
    """128 bits of hash of the text, as two longs."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def hits(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(k1, k2, n_hit, n_items, items_sha256) for each distinct text with a hit."""
    item_words = items.select(F.col(item).cast("string").alias("item"), words(F.col(item_text)).alias("w")).where("size(w) > 0")
    made = [item_words := materialise(item_words, "items")]
    lengths = sorted(r[0] for r in item_words.where(F.size("w") < window).select(F.size("w")).distinct().collect())  # below `window`
    every = [*lengths, window]
    sizes = F.least(F.size("w"), F.lit(window))
    listed = F.explode_outer(F.array_distinct(F.transform(F.coalesce(*[F.when(sizes == m, spans("w", m)) for m in every]), lambda x: F.struct(x["m"].alias("m"), x["h1"].alias("h1"), x["h2"].alias("h2")))))
    windows = item_words.select("item", listed.alias("x")).groupBy("x.m", "x.h1", "x.h2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    # many windows have the same items: a window carries a name of its list
    made.append(windows := materialise(windows.withColumn("list", F.xxhash64(F.lit(3), "items")), "windows"))
    marks = fingerprints(item_words, [], window, gram).select(F.explode_outer("fp").alias("fp")).where("fp is not null")
    if lengths:
        marks = marks.union(windows.where(F.col("m") < window).select("h1"))
    made.append(marks := materialise(marks.distinct(), "marks"))
    marks = small(marks, BROADCAST_ROWS)

    read = docs.select(*text_key(F.col(text)), words(F.col(text)).alias("w"))
    own = fingerprints(read, ["k1", "k2"], window, gram)
    rows = own.select("k1", "k2", F.explode_outer("fp").alias("fp"))
    for m in lengths:
        rows = rows.union(read.select("k1", "k2", F.explode_outer(F.transform(spans("w", m), lambda x: x["h1"]))))
    made.append(candidates := materialise(rows.join(marks, "fp", "left_semi").select("k1", "k2").distinct(), "candidates"))
    candidates = small(candidates, BROADCAST_ROWS)

    near = docs.select(*text_key(F.col(text)), F.col(text).alias("text")).join(candidates, ["k1", "k2"], "left_semi")
    near = near.dropDuplicates(["k1", "k2"]).select("k1", "k2", words(F.col("text")).alias("w"))
    found = near.select("k1", "k2", F.explode_outer(F.flatten(F.filter(F.array(*[spans("w", m) for m in every]), lambda x: x.isNotNull()))).alias("x"))
    found = found.select("k1", "k2", "x.*").join(small(windows.select("m", "h1", "h2", "list"), BROADCAST_ROWS), ["m", "h1", "h2"])
    made.append(found := materialise(found.select("k1", "k2", "at", "m", "list"), "hits"))

    # of each hit, the words beyond all earlier ends
    covered = """sum(greatest(0, at + m - greatest(at, coalesce(before, at)))) as n_hit"""
    ends = found.select("k1", "k2", "at", "m").selectExpr("k1", "k2", "at", "m", "max(at + m) over (partition by k1, k2 order by at, m rows between unbounded preceding and 1 preceding) as before")
    n_hit = ends.groupBy("k1", "k2").agg(F.expr(covered))
    lists = windows.groupBy("list").agg(F.first("items").alias("items"))
    named = found.select("k1", "k2", "list").distinct().join(lists, "list").groupBy("k1", "k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    named = named.select("k1", "k2", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    out = materialise(n_hit.join(named, ["k1", "k2"]), "hit_texts")
    for done in made:
        discard(done)
    return out


def contamination(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """One row a document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(docs, items, text, **params)
    parts = F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), BREAK)
    rows = docs.select(F.col(id).alias("id"), *text_key(F.col(text)), parts.alias("p"))
    # a text of breaks alone has two empty parts, an empty text has one
    count = F.greatest(F.size("p") - (F.get("p", F.lit(0)) == "").cast("int") - (F.element_at("p", -1) == "").cast("int"), F.lit(0))
    rows = rows.select("id", "k1", "k2", count.cast("long").alias("n_words")).join(small(found, BROADCAST_ROWS), ["k1", "k2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select(
        F.col("id").alias(id), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, text: str = "text", **params) -> DataFrame:
    """docs without the contaminated ones, all columns as they were."""
    rows, text = numbered(docs), place_of(docs, text)
    found = small(hits(rows, items, text, **params).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("n_hit").alias("_n_hit")), BROADCAST_ROWS)
    k1, k2 = text_key(F.col(text))
    marked = rows.withColumns({"_t1": k1, "_t2": k2}).join(found, (F.col("_t1") == F.col("_k1")) & (F.col("_t2") == F.col("_k2")), "left")
    keep = F.col("_n_hit").isNull() | (20 * F.col("_n_hit") < F.size(words(F.col(text))))
    return marked.where(keep).select(*rows.columns).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), {WINDOW}) AS m FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[s : s + m - 1], ' ') AS t FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM i)),
lengths AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT r, m, s, array_to_string(w[s : s + m - 1], ' ') AS t FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, lengths WHERE len(w) >= m)),
h AS (SELECT DISTINCT r, s, m, t FROM dw SEMI JOIN iw USING (m, t)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS p FROM h) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h JOIN iw USING (m, t)) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN n USING (r)
"""
