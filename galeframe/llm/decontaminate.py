"""Removal of benchmark passages from training texts, by a broadcast set of word windows.

A window is ten consecutive words of a benchmark item; an item of fewer words is one
window.  The hashes of all windows are a broadcast set.  Every text is scanned once: the
hashes of its own windows of the same lengths are built from hashes of one, two, four
and eight words, and looked up.  Hits are verified word by word.  Everything is built-in
functions, so scan, look-up and verification are one stage without a shuffle; only hits
travel.

The set is broadcast in blocks of at most ``WINDOWS_AT_ONCE`` windows, which are counted
first.  A larger benchmark is looked up block by block, one scan of the texts for each,
so what is broadcast never grows with the benchmark.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.llm.support import kept

WINDOW = 10
# Some 100 bytes each, so a block is about 50 MB.
WINDOWS_AT_ONCE = 500_000

# What stands between words (fixed): ASCII without digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
BETWEEN_CASED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
IN_WORD_CASED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
# More than any text has words.
ALL = 1 << 30

_KEY = ["doc_id", "_gf_text"]


def words(text: str) -> Column:
    """The words of a text with A-Z lower-cased; null texts have none."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, f"{BETWEEN}+"), "")


def with_hashes(df: DataFrame, lengths: list[int], column: str = "_gf_words", out: str = "_gf_hashes") -> DataFrame:
    """``df`` with the hashes of all windows of an array of words: those of the first
    length from left to right, then those of the next."""

    def joined(a: str, b: str, behind: int) -> Column:
        return F.zip_with(a, F.slice(b, behind + 1, ALL), lambda x, y: F.xxhash64(x, y))

    names, own = ["_gf_h1"], df.columns
    df = df.withColumn("_gf_h1", F.transform(column, lambda w: F.xxhash64(w)))
    while 2 ** len(names) <= max(lengths):
        span = 2 ** len(names)
        names.append(f"_gf_h{span}")
        df = df.withColumn(names[-1], joined(names[-2], names[-2], span // 2))
    parts = []
    for n in lengths:
        at, name = 0, None
        for k in reversed(range(len(names))):
            if n >> k & 1:
                if name is None:
                    name = names[k]
                else:
                    df = df.withColumn(f"_gf_w{n}_{k}", joined(name, names[k], at))
                    name = f"_gf_w{n}_{k}"
                at += 2**k
        parts.append(F.slice(name, 1, _fitting(column, n)))
    return df.select(*(F.col(f"`{c}`") for c in own), (F.concat(*parts) if len(parts) > 1 else parts[0]).alias(out))


def _fitting(column: str, n: Column | int) -> Column:
    """How many windows of ``n`` words fit an array."""
    return F.greatest(F.lit(0), F.size(column) + 1 - n)


def windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, list[int]]:
    """(item_id, n, gram, hash) for every distinct window of every item, and the lengths
    that occur.

    Null and empty texts and texts without words have none; rows without item_id have
    windows that no item is named for.
    """
    held = benchmark.select("item_id", words("text").alias("_gf_words")).where(F.size("_gf_words") > 0)
    held = held.withColumn("n", F.least(F.size("_gf_words"), F.lit(window)))
    starts = held.select("item_id", "n", "_gf_words", F.explode(F.sequence(F.lit(1), F.size("_gf_words") - F.col("n") + 1)).alias("at"))
    cut = starts.select("item_id", "n", F.slice("_gf_words", F.col("at"), F.col("n")).alias("_gf_words"))
    cut = kept(cut.withColumn("gram", F.array_join("_gf_words", " ")).dropDuplicates(["item_id", "gram"]), "windows")
    lengths = sorted(r[0] for r in cut.select("n").distinct().collect())  # at most ``window`` numbers
    if not lengths:
        return cut.select("item_id", "n", "gram", F.lit(0).cast("long").alias("hash")), []
    sized = [with_hashes(cut.where(F.col("n") == n), [n]) for n in lengths]
    found = reduce(DataFrame.unionByName, sized)
    return found.select("item_id", "n", "gram", F.element_at("_gf_hashes", 1).alias("hash")), lengths


def hits(docs: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, _gf_text, start, n, gram): windows of ``grams`` (n, gram, hash) in texts.

    ``_gf_text`` is a hash of the text, so rows of one id with different texts stay apart.
    ``start`` counts words from 0.
    """
    scanned = with_hashes(docs.select("doc_id", _text_key().alias("_gf_text"), words("text").alias("_gf_words")), lengths)
    # The outer form keeps Spark from adding a filter that would hash all windows twice.
    looked = scanned.select(*_KEY, "_gf_words", F.posexplode_outer("_gf_hashes").alias("place", "hash"))
    met = looked.join(F.broadcast(grams), "hash")
    before = F.lit(0)
    base = F.lit(0)
    for n in lengths:
        base = F.when(F.col("n") == n, before) if n == lengths[0] else base.when(F.col("n") == n, before)
        before = before + _fitting("_gf_words", n)
    met = met.withColumn("start", F.col("place") - base)
    inside = (F.col("start") >= 0) & (F.col("start") < _fitting("_gf_words", F.col("n")))
    same = F.when(inside, F.array_join(F.slice("_gf_words", F.col("start") + 1, F.col("n")), " ") == F.col("gram"))
    return met.where(same).select(*_KEY, "start", "n", "gram")


def _text_key() -> Column:
    return F.xxhash64("text")


def found_windows(docs: DataFrame, items: DataFrame, lengths: list[int], at_once: int = WINDOWS_AT_ONCE) -> DataFrame:
    """``hits`` of all windows of ``items``, in as many blocks as their number asks for;
    kept as a table."""
    grams = items.select("n", "gram", "hash").dropDuplicates(["gram"])
    blocks = max(1, -(-grams.count() // at_once))
    if blocks == 1:
        return kept(hits(docs, grams, lengths), "hits")
    block = F.pmod(F.xxhash64("hash", F.lit("block")), F.lit(blocks))
    return kept(reduce(DataFrame.unionByName, (hits(docs, grams.where(block == k), lengths) for k in range(blocks))), "hits")


def spans(found: DataFrame) -> DataFrame:
    """(doc_id, _gf_text, start, stop): maximal runs of hit words."""
    ends = found.groupBy(*_KEY, "start").agg(F.max(F.col("start") + F.col("n")).alias("stop"))
    along = Window.partitionBy(*_KEY).orderBy("start")
    reach = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("_gf_new", F.when(F.col("start") <= reach, 0).otherwise(1))
    ends = ends.withColumn("_gf_run", F.sum("_gf_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return ends.groupBy(*_KEY, "_gf_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_gf_run")


def _beside(docs: DataFrame, of: DataFrame, how: str) -> DataFrame:
    """``docs`` (with ``_gf_text``) joined to rows of (doc_id, _gf_text), null ids included."""
    of = of.withColumnRenamed("doc_id", "_gf_id").withColumnRenamed("_gf_text", "_gf_of")
    same = docs["doc_id"].eqNullSafe(of["_gf_id"]) & (docs["_gf_text"] == of["_gf_of"])
    return docs.join(of, same, how)


def digests(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, at_once: int = WINDOWS_AT_ONCE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    Null and empty texts have no words and no hits; repeated rows have the same result
    each, and rows of one id with different texts their own; rows without id count like
    others.  Without benchmark rows nothing is hit.  The list of items of a document is
    as long as the benchmark at most; items without id are in no list.  Other columns
    are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = own.select("doc_id", _text_key().alias("_gf_text"), F.size(words("text")).cast("long").alias("n_words"))
    items, lengths = windows(benchmark, window)
    none = F.sha2(F.lit("").cast("binary"), 256)
    if not lengths:
        nothing = F.lit(0).cast("long")
        return counted.select("doc_id", "n_words", nothing.alias("n_hit"), nothing.alias("n_items"), none.alias("items_sha256"), F.lit(False).alias("contaminated"))
    found = found_windows(own, items, lengths, at_once)
    covered = spans(found).groupBy(*_KEY).agg(F.sum(F.col("stop") - F.col("start")).cast("long").alias("n_hit"))
    named = found.select(*_KEY, "gram").distinct().join(items.select("item_id", "gram"), "gram").groupBy(*_KEY)
    named = named.agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("_gf_items"))
    named = named.withColumnsRenamed({"doc_id": "_gf_named", "_gf_text": "_gf_named_text"})
    both = covered.join(named, covered["doc_id"].eqNullSafe(named["_gf_named"]) & (covered["_gf_text"] == named["_gf_named_text"]), "left")
    out = _beside(counted, both.select(*_KEY, "n_hit", "_gf_items"), "left")
    return out.select(
        counted["doc_id"], "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("_gf_items").isNull(), 0).otherwise(F.size("_gf_items")).cast("long").alias("n_items"),
        F.coalesce(F.sha2(F.array_join("_gf_items", ",").cast("binary"), 256), none).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def cleaned(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", window: int = WINDOW, at_once: int = WINDOWS_AT_ONCE) -> DataFrame:
    """``docs`` without what it shares with the benchmark, all columns kept.

    With ``remove="spans"`` hit words go from ``text``, each with what stands between it
    and the next word; with ``"documents"`` every row with a hit goes.  Rows without hits,
    null texts included, stay as they are; repeated rows are treated alike.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    items, lengths = windows(benchmark, window)
    if not lengths:
        return docs
    names = [f"`{c}`" for c in docs.columns]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    runs = spans(found_windows(own, items, lengths, at_once))
    marked = docs.withColumn("_gf_text", _text_key())
    if remove == "documents":
        return _beside(marked, runs.select(*_KEY).distinct(), "left_anti").select(*names)
    # A text has no more runs than words.
    runs = runs.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_gf_runs"))
    text = F.col("text")
    pieces = F.regexp_extract_all(text, F.lit(f"{IN_WORD_CASED}+{BETWEEN_CASED}*"), 0)
    begin = F.concat(F.array(F.lit(0)), F.transform("_gf_runs", lambda r: r["stop"]))
    end = F.concat(F.transform("_gf_runs", lambda r: r["start"]), F.array(F.size(pieces)))
    stay = F.flatten(F.zip_with(begin, end, lambda a, b: F.slice(pieces, a + 1, b - a)))
    cut = F.concat(F.regexp_extract(text, f"^{BETWEEN_CASED}*", 0), F.array_join(stay, ""))
    joined = _beside(marked, runs, "left").withColumn("_gf_cut", F.when(F.col("_gf_runs").isNull(), text).otherwise(cut))
    return joined.select(*(F.col("_gf_cut").alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns))


# The same digests in DuckDB: windows of texts as strings, joined to those of items.
SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
  b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
  s AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(len(w) - least(10, len(w)) + 1)) AS p FROM b WHERE len(w) > 0),
  win AS (SELECT DISTINCT item_id, n, array_to_string(w[p + 1:p + n], ' ') AS gram FROM s),
  k AS (SELECT DISTINCT n FROM win),
  dp AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS p FROM d, k WHERE len(w) >= n),
  hit AS (SELECT doc_id, dp.n, p, item_id FROM (SELECT doc_id, n, p, array_to_string(w[p + 1:p + n], ' ') AS gram FROM dp) dp JOIN win USING (n, gram)),
  pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
  it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
         FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
