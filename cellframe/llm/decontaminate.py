"""Passages of benchmark items in documents, in DataFrame functions only.

Words are the runs outside ``[\\x20\\x09-\\x0D]`` of the lower-cased text; shingles are SHINGLE consecutive words (the
whole item where it has fewer). A window has as many words as its item. Its similarity to the item is the weighted
Jaccard of their shingles, a shingle weighing as often as it occurs; a leak has SIMILAR or more.

1. Places: a leak shares more than 1 - SIMILAR of the item's shingles, so it shares one of the item's rarest ones that
   weigh just over that. Documents are joined with those on the shingle's hash, and every window that holds the place
   is a candidate. No similar window is lost here.
2. SimHash: a window's fingerprint sets a bit that over half of its shingles' hashes have. Fingerprints within RADIUS
   bits agree in one of RADIUS + 1 blocks, so windows and items meet in a join on (item, block, value), and the complete
   distance is taken of those that meet. All fingerprints within the radius pass. The radius is wide: at a similarity
   of exactly SIMILAR, of 64 bits about 10 differ, and over RADIUS with a probability of about one in a million.
3. The exact similarity of the windows that passed decides.

Item shingles are broadcast while they are at most BROADCAST_ROWS rows; with more, the join shuffles.

Equal texts are one until the end, so copies cost a row each and no more. The result has one row for each document and
item with a leak: the most similar window, the earliest of equals. Nulls: a null text or item has no words and no leak;
rows without item_id are no items; a row without doc_id gets its row in the result. Repeated rows give repeated rows,
equal items a row each. An item of fewer than SHINGLE words is found where it is the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.session import cut

SHINGLE, SIMILAR, RADIUS = 5, 0.8, 24
BLOCKS = RADIUS + 1
BROADCAST_ROWS = 200_000
#: Three counters of 21 bits in a long: of the bits k, k + 21 and k + 42 of a hash.
FIELD = 21
FIELDS = 1 | 1 << FIELD | 1 << 2 * FIELD


def word_hashes(text: str = "text") -> Column:
    """The hashes of a text's words in order."""
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare != "", F.transform(F.split(bare, "[\\x20\\x09-\\x0D]+"), lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def shingles(words: Column) -> Column:
    """Hashes of the consecutive SHINGLE words; of all words if there are fewer; none of none."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
    return F.when(n > 0, many).otherwise(F.array().cast("array<bigint>"))


def fingerprinted(hashes: DataFrame, keys: list[str]) -> DataFrame:
    """keys and fp: a bit is set if over half of the rows' hashes ``h`` have it."""
    counters = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(FIELDS))).alias(f"s{k}") for k in range(FIELD + 1)]
    summed = hashes.groupBy(*keys).agg(F.count("*").alias("n"), *counters)
    fp = F.lit(0).cast("long")
    for bit in range(64):  # bit 63 is the last counter of the last sum
        k, j = (bit % FIELD, bit // FIELD) if bit < 3 * FIELD else (FIELD, 2)
        count = F.shiftrightunsigned(f"s{k}", FIELD * j).bitwiseAND(F.lit((1 << FIELD) - 1))
        fp = fp.bitwiseOR(F.when(count * 2 > F.col("n"), F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return summed.select(*keys, fp.alias("fp"))


def blocks(fp: Column) -> Column:
    """(block, value) of a fingerprint's BLOCKS parts."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for i, (a, b) in enumerate(zip(edges, edges[1:]))])


def prepared(items: DataFrame) -> DataFrame:
    """item_id, item_no, n_words, size and shingles of every item with words; item_no tells items with other texts apart."""
    rows = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), word_hashes().alias("words"))
    rows = rows.where(F.size("words") > 0).distinct()
    rows = rows.select("item_id", F.size("words").alias("n_words"), shingles(F.col("words")).alias("item_shingles"))
    return rows.withColumn("size", F.size("item_shingles")).withColumn("item_no", F.xxhash64("item_id", "item_shingles"))


def anchors(items: DataFrame) -> DataFrame:
    """item_no, n_words, width and the rarest shingles of each item, which weigh just over 1 - SIMILAR of it."""
    each = items.select("item_no", "n_words", "size", F.explode("item_shingles").alias("h")).groupBy("item_no", "n_words", "size", "h").agg(F.count("*").alias("weight"))
    common = each.groupBy("h").agg(F.count("*").alias("items"))
    listed = each.join(common, "h").groupBy("item_no", "n_words", "size").agg(F.sort_array(F.collect_list(F.struct("items", "h", "weight"))).alias("list"))
    # a shingle is an anchor while those before it weigh at most 1 - SIMILAR of all
    before = lambda i: F.aggregate(F.slice("list", F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x["weight"])
    kept = F.filter("list", lambda x, i: before(i) <= F.col("size") * (1 - SIMILAR) + 1e-9)
    return listed.select("item_no", "n_words", "size", F.explode(kept).alias("x")).select("item_no", "n_words", "size", F.col("x.h").alias("h"))


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_chars, item_id, start (first word, from 0), n_words, distance and similarity of every leak."""
    items = cut(prepared(items))
    rare = cut(anchors(items))
    small = rare.count() <= BROADCAST_ROWS
    held = lambda df: F.broadcast(df) if small else df
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text")).withColumn("n_chars", F.length("text"))
    key = ["text_hash", "n_chars"]
    places = texts.select(*key, word_hashes().alias("words")).where(F.size("words") > 0).select(*key, F.size("words").alias("doc_words"), F.posexplode(shingles(F.col("words"))).alias("place", "h"))
    # all windows of the item's length that hold the shared shingle; a shorter text is one window
    latest = F.greatest(F.lit(0), F.col("doc_words") - F.col("n_words"))
    span = F.sequence(F.least(F.greatest(F.lit(0), F.col("place") - (F.col("size") - 1)), latest), F.least(F.col("place"), latest))
    windows = cut(places.join(held(rare), "h").select(*key, "item_no", "n_words", "size", F.explode(span).alias("start")).distinct())
    # the texts with a place, with their shingles
    found = texts.join(windows.select(*key).distinct(), key, "left_semi").dropDuplicates(key).select(*key, F.get(F.transform(F.array(word_hashes()), shingles), 0).alias("all"))  # binds the words once
    at = [*key, "item_no", "start", "n_words", "size"]
    each = lambda rows: rows.join(found, key).select(*at, F.explode(F.slice("all", F.col("start") + 1, F.col("size"))).alias("h"))
    marked = cut(fingerprinted(each(windows), at))  # the fingerprint is read in many places
    item_each = items.select("item_no", F.explode("item_shingles").alias("h"))
    item_fps = cut(fingerprinted(item_each, ["item_no"]).withColumnRenamed("fp", "item_fp"))
    by_block = item_fps.select("item_no", "item_fp", F.explode(blocks(F.col("item_fp"))).alias("b")).select("item_no", "item_fp", "b.*")
    # of the blocks in which a window meets its item, the first counts
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.coalesce(*[F.when(F.shiftrightunsigned(differ, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) == 0, F.lit(i)) for i, (a, b) in enumerate(zip(edges, edges[1:]))])
    near = (
        marked.select("*", F.explode(blocks(F.col("fp"))).alias("b")).select(*at, "fp", "b.*").join(held(by_block), ["item_no", "block", "value"])
        .withColumn("distance", F.bit_count(differ)).where((F.col("distance") <= RADIUS) & (F.col("block") == first)).select(*at, "distance")
    )
    near = cut(near)
    weights = item_each.groupBy("item_no", "h").agg(F.count("*").alias("weight"))
    counted = each(near.drop("distance")).groupBy(*at, "h").agg(F.count("*").alias("times"))
    both = counted.join(held(weights), ["item_no", "h"], "left").groupBy(*at).agg(F.sum(F.least("times", F.coalesce("weight", F.lit(0)))).alias("both"), F.sum("times").alias("all"))
    exact = both.withColumn("similarity", F.col("both") / (F.col("all") + F.col("size") - F.col("both"))).where(F.col("similarity") >= SIMILAR)
    exact = exact.join(near, at).join(held(items.select("item_no", "item_id")), "item_no")
    best = exact.groupBy(*key, "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words", "distance")).alias("b"))
    owners = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))
    wide = lambda c: F.col(c).cast("long").alias(c.split(".")[-1])
    return owners.join(best, key).select("doc_id", "text_hash", "n_chars", "item_id", (-F.col("b.back")).cast("long").alias("start"), wide("b.n_words"), wide("b.distance"), "b.similarity")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has no leak."""
    bad = leaks(docs, items).select(F.col("text_hash").alias("_bad_hash"), F.col("n_chars").alias("_bad_chars")).distinct()
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.join(bad, (F.xxhash64(text) == F.col("_bad_hash")) & (F.length(text) == F.col("_bad_chars")), "left_anti")


def _shingle_sql(table: str, key: str) -> str:
    """A row for every shingle of a table: its key, the number of words, the place and the shingle's hash."""
    return (
        f"{table}w as materialized (select {key}, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') as w from {table}), "
        f"{table}p as materialized (select {key}, w, len(w) as n, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) as p from {table}w where len(w) > 0), "
        f"{table}s as materialized (select {key}, n, p, hash(array_to_string(list_slice(w, p, p + {SHINGLE - 1}), ' ')) as s from {table}p)"
    )


#: The leaks by trying every window of every document and item that share a shingle, in DuckDB's SQL. Steps are
#: materialised and joined on numbers.
ORACLE_SQL = f"""
with {_shingle_sql('documents', 'doc_id')}, {_shingle_sql('benchmark', 'item_id')},
sizes as materialized (select item_id, max(n) as n_words, count(*) as size from benchmarks group by item_id),
weights as materialized (select item_id, s, count(*) as weight from benchmarks group by item_id, s),
lengths as materialized (select doc_id, max(n) as n from documentss group by doc_id),
pairs as materialized (select distinct doc_id, item_id from documentss d join weights b on d.s = b.s),
sized as materialized (select doc_id, item_id, n_words, size, n from pairs join sizes using (item_id) join lengths using (doc_id)),
starts as materialized (select doc_id, item_id, n_words, size, unnest(range(0, greatest(n - n_words, 0) + 1)) as start from sized),
places as materialized (select doc_id, item_id, start, n_words, size, unnest(range(start + 1, start + size + 1)) as p from starts),
counted as materialized (select t.doc_id, t.item_id, t.start, t.n_words, t.size, d.s, count(*) as times from places t join documentss d on d.doc_id = t.doc_id and d.p = t.p group by all),
summed as materialized (
    select c.doc_id, c.item_id, c.start, c.n_words, c.size, sum(least(c.times, coalesce(w.weight, 0)))::bigint as both_, sum(c.times)::bigint as all_
    from counted c left join weights w on w.item_id = c.item_id and w.s = c.s group by all),
likeness as materialized (select *, both_::double / (all_ + size - both_) as similarity from summed)
select doc_id, item_id, start, n_words, similarity from likeness where similarity >= {SIMILAR}
qualify row_number() over (partition by doc_id, item_id order by similarity desc, start) = 1
"""
