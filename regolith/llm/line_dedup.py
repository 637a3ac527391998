"""Cross-site line dedup by distinct-site spread, in DataFrame functions.

A line's key is two 64-bit hashes of its stripped text.  Each task folds the sites of its lines into one
HyperLogLog sketch a key, and the exchange carries these partial sketches, not lines or (line, site)
pairs; they merge by key.  Keys whose estimate is within a factor of two of ``min_sites`` get an
exact distinct count over their own lines alone; above that the estimate decides.  A line on
``min_sites`` sites or more is boilerplate and is removed wherever it stands, except in the document with
the smallest id that has it.

Lines meet keys, a stored table, where they stand: the keys are sent to the lines if their counted
number is at most ``BROADCAST_LIMIT``; beyond, lines join them by shuffle under ``SALTS`` salts, of which
each key has all.  Removal flags come back to documents in line order, so texts are cut in one pass;
documents whose lines all stay are not touched.

Defined results: null and empty texts have no lines and come back as they are; a null site
counts as one site of its own; a null id counts as larger than all others; blank lines are
never removed; rows with equal id and text are treated alike; a very long text is one row and its
lines are rows like others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import stripped
from .textkit import materialize, required

MIN_SITES = 4
BROADCAST_LIMIT = 500_000
SALTS = 32
_LAST = (1 << 63) - 1


def site_lines(docs: DataFrame) -> DataFrame:
    """(rid, th, pos, site, k1, k2) of each non-blank line of (rid, th, site, text)."""
    lines = docs.select("rid", "th", "site", F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("line", stripped(F.col("line"))).where("line <> ''")
    return lines.select("rid", "th", "pos", "site", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(7), "line").alias("k2"))


def meeting(lines: DataFrame, keys: DataFrame, broadcast_limit: int) -> DataFrame:
    """Lines with a stored table's rows of the same key."""
    if keys.count() <= broadcast_limit:
        return lines.join(F.broadcast(keys), ["k1", "k2"])
    keys = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod(F.xxhash64("rid", "pos"), F.lit(SALTS)).cast("int")).join(keys, ["k1", "k2", "salt"])


def boilerplate_keys(lines: DataFrame, min_sites: int, broadcast_limit: int) -> DataFrame:
    """(k1, k2, first) of lines on at least ``min_sites`` sites; ``first`` is their smallest id."""
    spread = lines.groupBy("k1", "k2").agg(F.hll_sketch_agg("site").alias("sketch"), F.min("rid").alias("first"))
    spread = spread.select("k1", "k2", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") * 2 >= min_sites)
    spread = materialize(spread, "spread")
    close = spread.where(F.col("sites") <= 2 * min_sites).select("k1", "k2", "first")
    exact = meeting(lines, close, broadcast_limit).groupBy("k1", "k2").agg(F.count_distinct("site").alias("sites"), F.min("first").alias("first"))
    sure = spread.where(F.col("sites") > 2 * min_sites).select("k1", "k2", "first")
    return sure.unionByName(exact.where(F.col("sites") >= min_sites).select("k1", "k2", "first"))


def marked(lines: DataFrame, keys: DataFrame, broadcast_limit: int) -> DataFrame:
    """Lines that are boilerplate and not in the first document of theirs."""
    return meeting(lines, materialize(keys, "boilerplate"), broadcast_limit).where("rid > first")


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept) a row: its lines that are not blank, how many of them
    went, and the text without them."""
    d = required(docs, id_col, text_col, site_col).toDF("doc_id", "text", "site")
    d = d.select("doc_id", "text", *_keys(F.col("doc_id"), F.col("text")), F.coalesce(F.col("site").cast("string"), F.lit("\0")).alias("site"))
    return _cut(d, min_sites, broadcast_limit).select(
        "doc_id",
        F.coalesce(F.size(F.filter(F.split("text", "\n", -1), lambda x: stripped(x) != "")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.filter("flags", lambda f: f)), F.lit(0)).cast("long").alias("n_removed"),
        "kept",
    )


def _keys(doc_id: Column, text: Column) -> list[Column]:
    return [F.coalesce(doc_id.cast("long"), F.lit(_LAST)).alias("rid"), F.xxhash64(text).alias("th")]


def _cut(d: DataFrame, min_sites: int, broadcast_limit: int) -> DataFrame:
    lines = site_lines(d.where("text is not null"))
    flags = marked(lines, boilerplate_keys(lines, min_sites, broadcast_limit), broadcast_limit).groupBy("rid", "th").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    # positions to one flag a line: each gap is a run of kept lines before a removed one
    runs = F.transform("gone", lambda p, i: F.concat(F.array_repeat(F.lit(False), F.when(i == 0, p).otherwise(p - F.get(F.col("gone"), i - 1) - 1)), F.array(F.lit(True))))
    flags = flags.select("rid", "th", F.flatten(runs).alias("flags"))
    out = d.join(flags, ["rid", "th"], "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.coalesce(F.get(F.col("flags"), i), F.lit(False))), "\n")
    return out.withColumn("kept", F.when(F.col("flags").isNull(), F.col("text")).otherwise(left))


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text; all rows and columns stay."""
    names = docs.columns
    rows = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    by = {n: F.col(f"_c{names.index(n)}") for n in (id_col, text_col, site_col)}
    site = F.coalesce(by[site_col].cast("string"), F.lit("\0"))
    d = rows.select("*", *_keys(by[id_col], by[text_col]), site.alias("site"), by[text_col].alias("text"))
    out = _cut(d, min_sites, broadcast_limit)
    return out.select(*[F.col("kept" if i == names.index(text_col) else f"_c{i}") for i in range(len(names))]).toDF(*names)
