"""Benchmark decontamination with DataFrame functions only: size-partitioned MinHash containment search, then exact containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side

WORDS, CONTAINMENT = 5, 0.8


def word_array(text: Column) -> Column:
    """Runs of letters and digits, in lower case; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def shingle_array(words: Column, n: int) -> Column:
    """Hashes of each ``n`` consecutive words; of the whole sequence where there are fewer; none without words."""
    places = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
    return F.when(F.size(words) > 0, F.transform(places, lambda i: F.xxhash64(F.slice(words, i, n)))).otherwise(F.array().cast("array<bigint>"))


def _shingles(df: DataFrame, id_col: str, text_col: str, name: str, n: int) -> DataFrame:
    source = df.select(F.col(id_col).alias(name), word_array(F.col(text_col)).alias("words")).where(F.col(name).isNotNull())
    return source.select(name, F.explode(shingle_array(F.col("words"), n)).alias("h"))


def _item_sets(items: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    return _shingles(items, item_col, text_col, "item", n).distinct()


def signatures(sets: DataFrame, containment: float) -> DataFrame:
    """MinHash signatures of items: ``(item, h, needed)``, their ``k`` shingles that a random hash makes smallest.

    Items are partitioned by size, each partition up to twice the sizes of the one before; ``k`` is such that of the largest item of a
    partition at least one signature shingle lies in every text that holds ``containment`` of the item: at most
    ``(1 - containment) * size`` shingles can be missing. ``needed`` is how many must be found for an item's own size.
    """
    missing = lambda size: F.floor(size * (1 - containment) + 1e-9)
    order = Window.partitionBy("item").orderBy(F.xxhash64("h", F.lit(7)), "h")
    sized = sets.join(sets.groupBy("item").agg(F.count("*").alias("size")), "item")
    top = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("size").cast("double"))))
    ranked = sized.withColumn("k", missing(top) + 1).withColumn("rank", F.row_number().over(order)).where("rank <= k")
    return ranked.select("item", "h", F.greatest(F.lit(1), F.least("k", "size") - missing(F.col("size"))).alias("needed"))


def contained_items(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    n: int = WORDS, containment: float = CONTAINMENT,
) -> DataFrame:
    """Pairs of a document and an item at least ``containment`` of whose distinct ``n``-word shingles the document has.

    Columns: the two ids, ``n_item`` (the item's shingles), ``n_shared`` and ``containment``. Only the items are sketched: a document's
    own sketch would drown a short passage in a long text, while the share of an item's MinHash values found among all the
    document's shingles estimates containment whatever its length. Candidates are then verified exactly. Signatures are
    broadcast if counted small, else joined by a shuffle; either way a document sends one row for each (item, shingle) found.
    Rows with a null id are left out; null and empty texts hold nothing and are held by nothing; rows of one id count as one set;
    an item of fewer than ``n`` words is one shingle. Only the four named columns are read.
    """
    sets = materialize(_item_sets(items, item_col, item_text_col, n), "item-shingles")
    signed = small_side(materialize(signatures(sets, containment), "item-signatures"))
    shingles = _shingles(docs, id_col, text_col, "doc", n)
    candidates = (
        shingles.join(signed, "h").groupBy("doc", "item").agg(F.count_distinct("h").alias("found"), F.max("needed").alias("needed")).where("found >= needed").select("doc", "item")
    )
    candidates = materialize(candidates, "candidates")
    named = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    wanted = named.join(small_side(candidates.select("doc").distinct()), "doc", "left_semi")
    shared = (
        _shingles(wanted, "doc", "text", "doc", n).join(small_side(sets), "h").groupBy("doc", "item").agg(F.count_distinct("h").alias("n_shared"))
    )
    size = sets.groupBy("item").agg(F.count("*").alias("n_item"))
    pairs = shared.join(candidates, ["doc", "item"], "left_semi").join(small_side(size), "item")
    share = F.col("n_shared") / F.col("n_item")
    return pairs.where(share >= containment - 1e-9).select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_item", "n_shared", share.alias("containment")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item; rows with a null id stay."""
    hit = materialize(contained_items(docs, items).select(F.col("doc_id").alias("hit_id")).distinct(), "contaminated")
    hit = small_side(hit)
    return docs.join(hit, docs["doc_id"] == hit["hit_id"], "left_anti")


#: For DuckDB.
DECONTAM_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
doc_sets AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM doc_words WHERE len(w) > 0),
item_sets AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM item_words WHERE len(w) > 0),
sizes AS (SELECT item_id, count(*) AS n_item FROM item_sets GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM doc_sets JOIN item_sets USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM shared JOIN sizes USING (item_id) WHERE n_shared / n_item >= 0.8 - 1e-9
"""
