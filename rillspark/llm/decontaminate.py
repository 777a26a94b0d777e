"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

The index is a stored table of postings (term, document, position) of those terms that the windows of benchmark items are
found by: each window's rarest ones, by their frequency in all documents. A phrase is found by intersecting lists from the
rarest term on: a posting less its term's offset in the window is where the window would start, and starts that the next
term's list has as well go on; what is left is compared word by word in its place. Proximity matches come from the same
lists: a window's rarest terms within a stretch of words, in any order and with others between them.

Terms, windows and texts have A-Z as a-z and all else as it is: unlike Spark's lower case, this gives a word the same
letters wherever it stands (a capital sigma's small form depends on what follows).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, written

WINDOW = 13
#: What stands between words, before A-Z are lower-cased: words are ASCII letters and digits, and all that isn't ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A document is contaminated if at least one word in SHARE is hit.
SHARE = 20


def plain(text: Column) -> Column:
    """A-Z as a-z, other letters as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: str) -> Column:
    """The words of a text with A-Z as a-z; lower-casing the whole text is cheaper than each word.

    Texts are split, which takes a tenth of the time of regexp_extract_all.
    """
    return F.array_remove(F.split(plain(F.coalesce(F.col(text), F.lit(""))), BETWEEN), "")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, window (words) of each item: all runs of size words, or all words of a shorter item that has any."""
    items = benchmark.select("item_id", words("text").alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return items.withColumn("s", F.explode(starts)).select("item_id", F.expr(f"slice(w, s, {size})").alias("window")).distinct()


def _seeds(docs: DataFrame, benchmark: DataFrame, size: int, lists: int) -> DataFrame:
    """wid, item_id, line (the window's words), n, seeds: its so many rarest terms with an offset each, rarest first.

    Windows with a term that no document has can't occur whole; they have n_found terms with postings, of n different ones.
    """
    wanted = written(windows(benchmark, size).withColumn("wid", F.monotonically_increasing_id()), "decon-windows")
    terms = wanted.select("wid", F.posexplode("window").alias("off", "term")).groupBy("wid", "term").agg(F.min("off").alias("off"))
    vocabulary, small = bounded(written(terms.select("term").distinct(), "decon-terms"))
    found = docs.select(F.explode_outer(words("text")).alias("term"))  # outer: else Spark finds the words once more, to leave out texts without any
    # a large vocabulary meets the words only after they're counted; either way the documents are read once
    often = found.join(vocabulary, "term").groupBy("term").count() if small else found.groupBy("term").count().join(vocabulary, "term")
    rarest = terms.join(written(often, "decon-frequency"), "term", "left").groupBy("wid").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "off", "term"))).alias("all")
    )
    rarest = rarest.select(F.col("wid").alias("_wid"), F.slice("all", 1, lists).alias("seeds"), F.size(F.filter("all", lambda x: x["count"] > 0)).alias("n_found"), F.size("all").alias("n_terms"))
    made = wanted.join(rarest, F.col("wid") == F.col("_wid"))
    return written(made.select("wid", "item_id", F.array_join("window", " ").alias("line"), F.size("window").alias("n"), "seeds", "n_found", "n_terms"), "decon-seeds")


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index: term, doc_id, pos (from 0) and n_words of the document, for the given terms.

    Each row of docs also has a posting of the empty term, at -1, which tells its n_words; no word is empty.
    """
    tokens = docs.select("doc_id", words("text").alias("w")).select("doc_id", F.size("w").cast("long").alias("n_words"), F.concat(F.array(F.lit("")), "w").alias("w"))
    each = tokens.select("doc_id", "n_words", F.posexplode_outer("w").alias("pos", "term"))  # w is never empty
    wanted, _ = bounded(terms.select("term").union(docs.sparkSession.createDataFrame([("",)], "term string")).distinct().withColumnRenamed("term", "_term"))
    postings = each.join(wanted, F.col("term") == F.col("_term")).select("term", "doc_id", (F.col("pos") - 1).alias("pos"), "n_words")
    return written(postings.sortWithinPartitions("term"), "decon-index")


def _starts(postings: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """wid, doc_id, start: where windows would start by the postings of their k-th rarest term."""
    one = seeds.filter(F.size("seeds") > k).select("wid", "n", F.col("seeds")[k]["term"].alias("_term"), F.col("seeds")[k]["off"].alias("off"))
    start = F.col("pos") - F.col("off")
    found = postings.join(bounded(one)[0], F.col("term") == F.col("_term")).filter((start >= 0) & (start + F.col("n") <= F.col("n_words")))
    return found.select("wid", "doc_id", start.alias("start"))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, lists: int = 2) -> tuple[DataFrame, DataFrame]:
    """doc_id, start, n (words), item_id of every place in a document where a window of an item occurs, and doc_id, n_words.

    lists: how many of a window's postings lists are intersected before its words are compared.
    """
    seeds = _seeds(docs, benchmark, size, lists).filter("n_found = n_terms")
    postings = index(docs, seeds.select(F.explode("seeds").alias("x")).select("x.term"))
    starts = _starts(postings, seeds, 0)
    for k in range(1, lists):
        # windows of fewer different terms have nothing more to intersect
        single = seeds.filter(F.size("seeds") <= k).select(F.col("wid").alias("_wid"))
        more = _starts(postings, seeds, k).select(F.col("wid").alias("_wid"), F.col("doc_id").alias("_id"), F.col("start").alias("_start"))
        both = starts.join(more, (F.col("wid") == F.col("_wid")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("start") == F.col("_start")), "left_semi")
        starts = both.unionByName(starts.join(bounded(single)[0], F.col("wid") == F.col("_wid"), "left_semi"))
    starts = written(starts.distinct(), "decon-starts")
    lines = seeds.select(F.col("wid").alias("_wid"), "item_id", "line", "n")
    candidates = written(starts.join(bounded(lines)[0], F.col("wid") == F.col("_wid")).select(F.col("doc_id").alias("_id"), "start", "n", "item_id", "line"), "decon-candidates")
    few, _ = bounded(candidates.select(F.col("_id").alias("_some")).distinct())
    near = docs.select("doc_id", "text").join(few, F.col("doc_id").eqNullSafe(F.col("_some")), "left_semi").select("doc_id", words("text").alias("w"))
    # the candidates, not the words, are built into a hash table; words have no spaces
    met = near.join(candidates.hint("shuffle_hash"), near["doc_id"].eqNullSafe(candidates["_id"]))
    same = F.array_join(F.slice("w", F.col("start") + 1, F.col("n")), " ") == F.col("line")
    return met.filter((F.col("start") + F.col("n") <= F.size("w")) & same).select("doc_id", "start", "n", "item_id"), postings.filter("pos = -1").select("doc_id", "n_words")


def near_matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, lists: int = 4, slop: int = 5) -> DataFrame:
    """doc_id, item_id, first, last: stretches of at most size + slop words that hold a window's rarest terms, in any order.

    A window's terms are its so many rarest that documents have (all, if it has fewer). For each place of the rarest one
    the stretch begins at most that many words before it; the closest posting of each other term counts. So passages are
    found in which words were put in, left out or exchanged. Rows are distinct; null ids match null ids.
    """
    seeds = _seeds(docs, benchmark, size, size).filter("n_found > 0")
    seeds = seeds.select("wid", "item_id", F.slice(F.filter("seeds", lambda x: x["count"] > 0), 1, lists).alias("seeds"))
    each = seeds.select("wid", "item_id", F.size("seeds").alias("k"), F.posexplode("seeds").alias("j", "x")).select("wid", "item_id", "k", "j", F.col("x.term").alias("_term"))
    each = written(each, "decon-near-terms")
    postings = index(docs, each.select(F.col("_term").alias("term"))).filter("pos >= 0")
    placed = postings.join(bounded(each)[0], F.col("term") == F.col("_term")).select("wid", "item_id", "k", "j", "doc_id", "pos")
    placed = written(placed, "decon-near-places")
    wide = size + slop
    # places are met in buckets of a stretch's length and the two beside it
    seed = placed.filter("j = 0").select(F.col("wid").alias("_wid"), F.col("doc_id").alias("_id"), "item_id", "k", F.col("pos").alias("at"))
    seed = seed.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col("at") / wide) + d for d in (-1, 0, 1)])))
    others = placed.select("wid", "doc_id", "j", "pos", F.floor(F.col("pos") / wide).alias("bucket"))
    met = others.join(seed, (F.col("wid") == F.col("_wid")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("bucket") == F.col("_bucket")) & (F.abs(F.col("pos") - F.col("at")) < wide))
    closest = met.groupBy("wid", "doc_id", "item_id", "k", "at", "j").agg(F.min(F.struct(F.abs(F.col("pos") - F.col("at")), "pos"))["pos"].alias("pos"))
    found = closest.groupBy("wid", "doc_id", "item_id", "k", "at").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    return found.filter((F.col("n") == F.col("k")) & (F.col("last") - F.col("first") < wide)).select("doc_id", "item_id", "first", "last").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words, null and wordless items no windows; a document without hits has the digest of the
    empty text. Rows that repeat a doc_id are taken as the same document. Empty tables give no rows or no hits.
    """
    found, counted = hits(docs, benchmark, size)
    found = written(found, "decon-hits")
    w = Window.partitionBy("doc_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    runs = found.select("doc_id", "start", (F.col("start") + F.col("n")).alias("stop")).distinct()
    covered = runs.withColumn("to", F.coalesce(F.max("stop").over(w), F.lit(0))).select("doc_id", F.greatest(F.col("stop") - F.greatest("start", "to"), F.lit(0)).alias("k"))
    covered = covered.groupBy("doc_id").agg(F.sum("k").cast("long").alias("n_hit"))
    items = found.select("doc_id", F.col("item_id").cast("string").alias("i")).groupBy("doc_id").agg(F.array_sort(F.collect_set("i")).alias("i"))
    sums = written(covered.join(items, covered["doc_id"].eqNullSafe(items["doc_id"])).select(covered["doc_id"].alias("_id"), "n_hit", F.size("i").cast("long").alias("n_items"), F.array_join("i", ",").alias("items")), "decon-sums")
    zero = F.lit(0).cast("long")
    hit = F.coalesce("n_hit", zero)
    return counted.join(sums, counted["doc_id"].eqNullSafe(sums["_id"]), "left").select(
        "doc_id", "n_words", hit.alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (hit * SHARE >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated rows, all columns as they are."""
    gone = written(decontaminate(docs, benchmark).filter("contaminated").select("doc_id").distinct(), "decon-gone")
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")


_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, array_to_string(w[s:s + {WINDOW - 1}], ' ') AS win, least(len(w), {WINDOW}) AS n
  FROM i, range(1, 100000) t(s) WHERE len(w) > 0 AND s <= greatest(len(w) - {WINDOW - 1}, 1)),
lens AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, s, lens.n, array_to_string(w[s:s + lens.n - 1], ' ') AS win FROM d, lens, LATERAL (SELECT unnest(range(1, len(w) - lens.n + 2)) AS s)),
hit AS MATERIALIZED (SELECT doc_id, s, grams.n, item_id FROM grams JOIN win USING (win)),
pos AS (SELECT DISTINCT doc_id, s + k AS p FROM hit, range(0, {WINDOW}) t(k) WHERE k < n),
hits AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS l FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit > 0 AND {SHARE} * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
