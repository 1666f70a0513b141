"""Operator 1: documents that contain benchmark items, by size-partitioned MinHash containment search, in DataFrame and SQL
functions only.

Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, shingles five words; with fewer words the whole sequence is one
shingle. A document contains an item if it holds at least LEAST percent of the item's distinct shingles.

Items are partitioned by size: band i has the items of up to 2**i shingles. An item's sketch are its smallest MinHash
values, as many as its band's largest size may miss and one more, so no document that contains the item can miss them
all: the search loses nothing. A band also says how many shingles a document must have at least. Documents keep only
hashes up to the largest value in the sketches of the bands that they are large enough for, of these only such whose bit is
set in a Bloom filter of the sketches' values (one hash, a word of 64 bits for each value, FILTER_WORDS at most), and meet
the sketches by one join. What meets is verified by the shingles themselves: the items' shingles of each candidate pair are looked for in the
candidate. Sketches and the items' shingles are broadcast within bounds of rows and bytes that are checked for each, else
joined by shuffles.

Null and empty texts have no words, contain nothing and are contained in nothing. Repeated rows of documents or items
count as one, rows without doc_id or item_id are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

LEAST = 80
#: Rows of (hash, item) that may be broadcast, about 16 bytes each.
BROADCAST_ROWS = 500_000
#: Bytes of the items' shingles as text that may be broadcast, besides no more than BROADCAST_ROWS of them.
BROADCAST_BYTES = 32 << 20
#: Words of 64 bits that the filter has at most, 16 MB; where there are more sketch values, more hashes pass in vain.
FILTER_WORDS = 1 << 21


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    spaced = F.translate(low, "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def shingles(w: Column, make) -> Column:
    """make(words, position from 0) of each position; too few words: of the whole as one; none: empty."""
    n = F.size(w)
    return F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: make(w, i))).when(n > 0, F.array(make(w, F.lit(0)))).otherwise(F.filter(F.array(make(w, F.lit(0))), lambda _: F.lit(False)))


def hashed(w: Column, i: Column) -> Column:
    """MinHash value of a shingle; missing words are null and leave the hash as it is."""
    return F.xxhash64(*(F.get(w, i + k) for k in range(5)))


def split(df: DataFrame, key: str) -> DataFrame:
    """(key, w): the words as a column of their own, so that a shingle doesn't cut the text anew."""
    return df.select(key, words(F.col("text")).alias("w"))


def spelled(w: Column, i: Column) -> Column:
    return F.array_join(F.slice(w, i + 1, 5), " ")


def sketches(items: DataFrame) -> DataFrame:
    """(h, item_id, band_least): an item's smallest hashes, and the shingles a document needs at least."""
    sized = split(items.where("item_id is not null"), "item_id").select("item_id", F.array_distinct(shingles(F.col("w"), hashed)).alias("hs")).where(F.size("hs") > 0)
    n = F.size("hs")
    top = F.pow(F.lit(2), F.ceil(F.log2(n))).cast("int")  # the band's largest size
    keep = F.least(n, top - F.ceil(top * LEAST / 100) + 1).cast("int")
    least = F.ceil((F.when(top > 1, top / 2 + 1).otherwise(F.lit(1))) * LEAST / 100).cast("int")
    return sized.select("item_id", least.alias("band_least"), F.explode(F.slice(F.array_sort("hs"), 1, keep)).alias("h"))


def _filter_words(rows: int) -> int:
    return min(FILTER_WORDS, 1 << max(0, rows - 1).bit_length())


def bit_filter(found: DataFrame, words: int) -> DataFrame:
    """One row with words, an array of that many longs (a power of two) with the bit of each h of found set: the word by the
    low bits of h, the bit in it by the six above the low 21."""
    bits = found.select(F.col("h").bitwiseAND(F.lit(words - 1)).alias("word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 21) & 63 as int))").alias("bits"))
    none = found.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    made = bits.unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return made.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))


def near(docs: DataFrame, found: DataFrame, bands: list) -> DataFrame:
    """(doc_id, size, h): the hashes of documents that may be in the sketches found; bands holds (band_least, highest, n)."""
    hashes = split(docs, "doc_id").select("doc_id", shingles(F.col("w"), hashed).alias("hs")).withColumn("size", F.size("hs"))
    # never null, and exploded as outer: filters for nulls and empty arrays, which Spark would put below, make all hashes again
    reach = F.coalesce(F.greatest(F.lit(None).cast("long"), *(F.when(F.col("size") >= r.band_least, F.lit(r.highest)) for r in bands)), F.lit(-(2**63)))
    words = _filter_words(sum(r.n for r in bands))
    low = hashes.withColumn("reach", reach).select("doc_id", "size", "reach", F.explode_outer("hs").alias("h"))
    word = F.get(bit_filter(found, words).scalar(), F.col("h").bitwiseAND(F.lit(words - 1)).cast("int"))
    low = low.where("h <= reach").withColumn("_word", word)
    return low.where("shiftright(_word, cast(shiftrightunsigned(h, 21) & 63 as int)) & 1 = 1").select("doc_id", "size", "h")


def contained(docs: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found) for each document and item that it contains."""
    if least < LEAST:
        raise ValueError(f"the sketches are made for at least {LEAST} percent")
    items = items.select("item_id", "text")
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    found = materialize(sketches(items).distinct())
    # the bands: what a document must have for one, and the largest value in its sketches; a band for each power of two
    bands = found.groupBy("band_least").agg(F.max("h").alias("highest"), F.count("*").alias("n")).collect()
    if not bands:
        return docs.join(items, F.lit(False)).select("doc_id", "item_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("n_found"))
    sent = F.broadcast if sum(r.n for r in bands) <= BROADCAST_ROWS else (lambda df: df)
    pairs = materialize(near(docs, found, bands).join(sent(found), "h").where("size >= band_least").select("doc_id", "item_id").distinct())
    # exact: the shingles of the candidates' items as text, looked for in the candidates
    asked = split(items.where("item_id is not null"), "item_id").select("item_id", F.array_distinct(shingles(F.col("w"), spelled)).alias("asked"))
    asked = materialize(asked.distinct().select("item_id", F.size("asked").cast("long").alias("n_shingles"), F.explode("asked").alias("g")))
    rows, size = asked.agg(F.count("*"), F.sum(F.octet_length("g"))).first()
    sent = F.broadcast if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else (lambda df: df)
    wanted = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    held = split(wanted, "doc_id").select("doc_id", F.explode(F.array_distinct(shingles(F.col("w"), spelled))).alias("g"))
    held = held.join(sent(asked.select("g").distinct()), "g", "left_semi").distinct()
    counts = pairs.join(sent(asked), "item_id").join(held, ["doc_id", "g"]).groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.count_distinct("g").alias("n_found"))
    return counts.where(F.col("n_found") * 100 >= F.col("n_shingles") * least)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_SET = "CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END"
ORACLE = f"""
WITH d AS (SELECT DISTINCT doc_id, unnest({_SET}) AS g FROM (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL)),
i AS (SELECT item_id, len(s)::BIGINT AS n_shingles, unnest(s) AS g FROM (SELECT item_id, {_SET} AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)))
SELECT doc_id, item_id, max(n_shingles) AS n_shingles, count(*)::BIGINT AS n_found FROM d JOIN i USING (g)
GROUP BY doc_id, item_id HAVING count(*) * 100 >= max(n_shingles) * {LEAST}"""
