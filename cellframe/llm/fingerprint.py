"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame functions only.

A paragraph (a line; a text without line breaks is one) is hashed to a wide vector. Its first EXACT lanes are the
32-bit words of its SHA-256. The others come from its sentences: each one adds its length to the counters of the bits
that are set in two pieces of its MD5, packed two counters to a long. A text's fingerprint is the sum of its paragraphs'
vectors, the exact lanes modulo 2^32; a counter has 30 bits, which hold the length of any text of fewer than 2^30 code points. So
the order of paragraphs doesn't matter, and a paragraph is inserted or deleted by adding or subtracting its vector (``combine``), without the rest of the text.

A counter c of a text whose sentences have n code points is the sum 2 c - n of lengths with random signs. The products
of two texts' sums estimate the squared lengths of the sentences they share, so ``likeness`` is the cosine of the two
multisets of sentences, weighted by length, 0 to 1; equal fingerprints have 1.

The edited text of a row ends with the beginning of the next document: its last floor(n_chars / 2) code points are
replaced by as many (or all) of the next document's first ones. Next is the largest smaller doc_id, for the smallest
the largest of all. Neighbours are found on the ids alone, sorted by ranges; texts move once, by doc_id.

Nulls: a null text is an empty one, which has one empty paragraph. A row without doc_id has no next document, so its
edited text is its first half and near_next is null. Repeated rows are returned as often. If rows share a doc_id,
the next document's beginning is the least of their beginnings, and its fingerprint that of the least SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.session import cut

EXACT, SHIFTS, FIELD = 8, 22, 30
MASK = 1 | 1 << FIELD
SENTENCE_END = "[.!?]+ *"
COUNTERS = [f"c{i}" for i in range(2 * SHIFTS)]
LANES = [f"e{i}" for i in range(EXACT)]


def _hex_part(digest: Column, at: int, n: int) -> Column:
    return F.conv(F.substring(digest, at, n), 16, 10).cast("long")


def vectors(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n (length of all sentences), rows, e0.. and c0..: the sums over the paragraphs of ``text``, for every value of the keys.

    Rows with equal keys must have equal texts; ``rows`` is how many there are.
    """
    lines = texts.select(*keys, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    sentences = lines.select(*keys, "line_no", "line", F.posexplode(F.split("line", SENTENCE_END, -1)).alias("at", "sentence"))
    digest, whole = F.md5("sentence"), F.sha2("line", 256)
    head, said = F.col("at") == 0, F.col("sentence") != ""
    hashed = sentences.select(
        *keys, "line_no", "at", F.length("sentence").cast("long").alias("said"), F.when(said, _hex_part(digest, 1, 15)).otherwise(0).alias("h0"), F.when(said, _hex_part(digest, 17, 15)).otherwise(0).alias("h1"), F.when(head, whole).alias("whole")
    )
    exact = hashed.select(*keys, "said", "h0", "h1", ((F.col("at") == 0) & (F.col("line_no") == 0)).cast("long").alias("first"), *[F.coalesce(_hex_part(F.col("whole"), 8 * i + 1, 8), F.lit(0)).alias(n) for i, n in enumerate(LANES)])
    counters = [F.shiftright(f"h{i // SHIFTS}", i % SHIFTS).bitwiseAND(F.lit(MASK)) * F.col("said") for i in range(2 * SHIFTS)]
    summed = exact.groupBy(*keys).agg(F.sum("said").alias("n"), F.sum("first").alias("rows"), *[F.sum(e).alias(e) for e in LANES], *[F.sum(c).alias(n) for c, n in zip(counters, COUNTERS)])
    each = lambda c: F.expr(f"`{c}` div `rows`")
    return summed.select(*keys, each("n").alias("n"), "rows", *[F.pmod(each(e), F.lit(1 << 32)).alias(e) for e in LANES], *[each(c).alias(c) for c in COUNTERS])


def printed(row: str) -> Column:
    """A fingerprint as text: exact lanes, length of all sentences, counters, in hexadecimal."""
    f = lambda c, n: F.lpad(F.hex(F.col(f"{row}.{c}")), n, "0")
    return F.lower(F.concat(*[f(e, 8) for e in LANES], F.lit(":"), F.hex(F.col(f"{row}.n")), F.lit(":"), *[f(c, 16) for c in COUNTERS]))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint vector (a struct of n, e0.., c0..) of a with b's paragraphs inserted (1) or deleted (-1)."""
    add = lambda c: a[c] + sign * b[c]
    return F.struct(add("n").alias("n"), *[F.pmod(add(e), F.lit(1 << 32)).alias(e) for e in LANES], *[add(c).alias(c) for c in COUNTERS])


def signs(vector: Column) -> Column:
    """The sums of signs of all lanes."""
    low = F.lit((1 << FIELD) - 1)
    fields = F.flatten(F.array(*[F.array(vector[c].bitwiseAND(low), F.shiftright(vector[c], FIELD)) for c in COUNTERS]))
    return F.transform(fields, lambda c: 2 * c - vector["n"])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two arrays of signs, 0 to 1."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(a == b, F.lit(1.0)).when(norm == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def neighbours(ids: DataFrame) -> DataFrame:
    """doc_id and next_id (the largest smaller one; for the smallest the largest) of distinct, non-null ids."""
    ranged = cut(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    here = ranged.withColumn("next_id", F.lag("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    # one row a partition of the sort
    parts = ranged.groupBy("part").agg(F.max("doc_id").alias("top"))
    order = Window.orderBy("part")
    parts = parts.select("part", F.lag("top").over(order).alias("below"), F.max("top").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))
    return here.join(parts, "part").select("doc_id", F.coalesce("next_id", "below", "last").alias("next_id"))


def with_edited(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text, n_chars, next_id and edited (the edited text), of the rows with doc_id and of those without."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = rows.where(F.col("doc_id").isNotNull())
    n_chars = F.length("text").cast("long")
    ids = cut(known.groupBy("doc_id").agg(F.max(n_chars).alias("most")))
    near = cut(neighbours(ids.select("doc_id")))
    # what each document gives to those before it: the beginning that the longest of them needs
    wanted = near.join(ids, "doc_id").select(F.col("doc_id").alias("for_id"), F.col("next_id").alias("doc_id"), F.expr("cast(most div 2 as int)").alias("take"))
    # both joins read ``known`` by doc_id and as it is, so its texts are shuffled once
    given = known.join(wanted, "doc_id").select(F.col("for_id").alias("doc_id"), F.col("doc_id").alias("next_id"), F.expr("substring(text, 1, take)").alias("given"))
    given = given.groupBy("doc_id").agg(F.min("next_id").alias("next_id"), F.min("given").alias("given"))
    head = F.expr("substring(text, 1, length(text) - length(text) div 2)")
    tail = F.coalesce(F.expr("substring(given, 1, cast(length(text) div 2 as int))"), F.lit(""))
    edited = known.join(given, "doc_id", "left").select("doc_id", "text", n_chars.alias("n_chars"), "next_id", F.concat(head, tail).alias("edited"))
    alone = rows.where(F.col("doc_id").isNull()).select("doc_id", "text", n_chars.alias("n_chars"), F.lit(None).cast("long").alias("next_id"), head.alias("edited"))
    return edited, alone


def _pairs(rows: DataFrame) -> DataFrame:
    """The vectors of each row's text and edited text; equal rows are one with their number in ``rows``."""
    both = rows.select(
        "doc_id", "n_chars", "next_id", F.sha2("text", 256).alias("sha"), F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(False).alias("is_edited"), F.col("text").alias("text")), F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("text")))).alias("of"),
    ).select("doc_id", "n_chars", "next_id", "sha", "edited_sha256", "of.*")
    keys = ["doc_id", "n_chars", "next_id", "sha", "edited_sha256", "is_edited"]
    packed = vectors(both, keys).select(*keys, "rows", F.struct("n", *LANES, *COUNTERS).alias("v"))
    return packed.groupBy(*keys[:-1]).agg(F.max("rows").alias("rows"), F.max(F.when(~F.col("is_edited"), F.col("v"))).alias("own"), F.max(F.when(F.col("is_edited"), F.col("v"))).alias("edited"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    known, alone = with_edited(docs)
    # apart, because a union renames columns and the two shuffles of ``known`` would no longer be one
    pairs = cut(_pairs(known)).unionByName(cut(_pairs(alone)))
    following = pairs.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("next_id")).agg(F.min(F.struct("sha", "own"))["own"].alias("following"))
    joined = pairs.join(following, "next_id", "left").select("*", signs(F.col("own")).alias("s"), signs(F.col("edited")).alias("s_edited"), signs(F.col("following")).alias("s_next"))
    out = joined.select(
        "doc_id", "n_chars", "edited_sha256", printed("own").alias("fingerprint"), printed("edited").alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("s_edited")).alias("near_edited"), F.when(F.col("following").isNotNull(), likeness(F.col("s"), F.col("s_next"))).alias("near_next"), "rows",
    )
    return out.withColumn("again", F.explode(F.expr("sequence(1, rows)"))).drop("again", "rows")


#: The same rows in DuckDB's SQL (doc_id distinct and not null, as in the given table).
def _sql() -> str:
    lane = lambda d, a, n: f"('0x' || substr({d}, {a}, {n}))::bigint"
    exact = ", ".join(f"sum(case when pos = 1 then {lane('whole', 8 * i + 1, 8)} else 0 end)::bigint % 4294967296 as e{i}" for i in range(EXACT))
    counters = ", ".join(f"sum(((h{i // SHIFTS} >> {i % SHIFTS}) & {MASK}) * said)::bigint as c{i}" for i in range(2 * SHIFTS))
    text = " || ".join([f"lpad(printf('%x', e{i}), 8, '0')" for i in range(EXACT)]) + " || ':' || printf('%x', n) || ':' || " + " || ".join(f"lpad(printf('%x', {c}), 16, '0')" for c in COUNTERS)
    signs_ = ", ".join(f"2 * (({c} >> {s}) & {(1 << FIELD) - 1}) - n" for c in COUNTERS for s in (0, FIELD))
    near = lambda a, b: (
        f"case when {a} = {b} then 1.0::double when list_sum(list_transform(list_zip({a}, {a}), lambda x: x[1]::double * x[2])) * list_sum(list_transform(list_zip({b}, {b}), lambda x: x[1]::double * x[2])) = 0 then 0.0::double else "
        f"greatest(0.0::double, least(1.0::double, list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::double * x[2])) / sqrt(list_sum(list_transform(list_zip({a}, {a}), lambda x: x[1]::double * x[2])) * list_sum(list_transform(list_zip({b}, {b}), lambda x: x[1]::double * x[2]))))) end"
    )
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
n as (select *, length(text)::bigint as n_chars, coalesce(lead(doc_id) over (order by doc_id desc), max(doc_id) over ()) as next_id from d),
e as (select n.*, left(n.text, (n.n_chars - n.n_chars // 2)::bigint) || left(m.text, (n.n_chars // 2)::bigint) as edited from n join d m on m.doc_id = n.next_id),
t as (select doc_id, false as is_edited, text from e union all select doc_id, true, edited from e),
l as (select doc_id, is_edited, unnest(string_split(text, chr(10))) as line from t),
s as (select doc_id, is_edited, sha256(line) as whole, unnest(string_split_regex(line, '{SENTENCE_END}')) as sentence, unnest(range(1, len(string_split_regex(line, '{SENTENCE_END}')) + 1)) as pos from l),
h as (select doc_id, is_edited, whole, pos, length(sentence)::bigint as said, case when sentence <> '' then {lane('md5(sentence)', 1, 15)} else 0 end as h0, case when sentence <> '' then {lane('md5(sentence)', 17, 15)} else 0 end as h1 from s),
v as (select doc_id, is_edited, sum(said)::bigint as n, {exact}, {counters} from h group by doc_id, is_edited),
f as (select doc_id, is_edited, {text} as fingerprint, [{signs_}] as s from v)
select e.doc_id, e.n_chars, sha256(e.edited) as edited_sha256, a.fingerprint, b.fingerprint as edited_fingerprint,
  {near('a.s', 'b.s')} as near_edited, {near('a.s', 'c.s')} as near_next
from e join f a on a.doc_id = e.doc_id and not a.is_edited join f b on b.doc_id = e.doc_id and b.is_edited join f c on c.doc_id = e.next_id and not c.is_edited
"""


ORACLE_SQL = _sql()
