"""Words covered by passages that an earlier document holds, found by backward search in compressed FM-indexes.

A window is WINDOW consecutive words (``[^\\x20\\x09-\\x0D]+``) of one document. A word goes if a window that covers it
has a word sequence that also starts in a document with a smaller doc_id.

Equal windows must meet in one shard, without every shard seeing every document. A window belongs to the least of its
ANCHOR-word sequences, by hash; consecutive windows with the same anchor form a segment, and the anchor's hash names
the segment's shard. Packs first send 32 bits of each of their anchors and learn which ones occur in another document
too (a chance match only adds some). Then each pack sends every distinct segment with such an anchor once, with the
least and greatest doc_id that hold it. A shard builds an FM-index over the distinct segments and streams the segments'
windows through it: the search goes backwards while the passage also occurs elsewhere, and where WINDOW words match,
the least doc_id of the interval is the window's answer. Answers return to the packs that can use them.

Frequent anchors (over about HOT_SHARE of all segments) are chosen last: only windows made of nothing but frequent
sequences have one, and such segments are few different ones, that every pack sends once. So a passage in a third of
all documents loads no shard more than others.

Words are compared by 64-bit hashes. Nulls: a null text has no words; a row without doc_id keeps all of its words and
is no earlier document. Rows with equal doc_id don't count as earlier than each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cellframe.llm import packs
from cellframe.llm.fmindex import FMIndex
from cellframe.llm.pieces import Slots
from cellframe.llm.text import Words, mix, ragged, span_hashes, utf8

WINDOW, ANCHOR = 13, 4
HOT_SHARE = 1 / 20_000
SHARD_BYTES = 4 << 20
LAST = np.iinfo(np.int64).max
#: Fixed odd factors of the words of an anchor.
FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def anchors(h: np.ndarray, hot: Slots | None) -> np.ndarray:
    """A value of every ANCHOR consecutive words; those of frequent sequences come after all others."""
    n = len(h) - ANCHOR + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = mix(sum((h[k : k + n] * f for k, f in enumerate(FACTORS)), np.zeros(n, np.uint64))) >> np.uint64(1)
    if hot is not None:
        g |= (hot.get(g << np.uint64(1)) >= 0).astype(np.uint64) << np.uint64(63)
    return g


def segments(h: np.ndarray, first: np.ndarray, hot: Slots | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of windows, anchor) of the segments of documents whose words start at ``first``."""
    n = np.maximum(np.diff(first) - WINDOW + 1, 0)
    window = ragged(first[:-1], n)
    if not len(window):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    low, reach, span = anchors(h, hot), 1, WINDOW - ANCHOR + 1
    while 2 * reach <= span:
        low, reach = np.minimum(low[:-reach], low[reach:]), 2 * reach
    if reach < span:
        low = np.minimum(low[: reach - span], low[span - reach :])
    anchor = low[window]
    new = np.concatenate([[True], (window[1:] != window[:-1] + 1) | (anchor[1:] != anchor[:-1])])
    new[np.searchsorted(window, first[:-1][n > 0])] = True
    heads = np.flatnonzero(new)
    return window[heads], np.diff(np.append(heads, len(window))), anchor[heads]


class Pack:
    """The words and segments of a pack's rows; rows without doc_id have no segments."""

    def __init__(self, table: pa.Table, hot: Slots | None):
        texts = utf8(table.column("text"))
        self.ids = [int(i) if i is not None else None for i in table.column("doc_id").to_pylist()]
        self.words = Words(texts)
        self.h = self.words.hashes()
        own = np.array([i if i is not None else LAST for i in self.ids], np.int64)
        self.known = np.array([i is not None for i in self.ids], bool)
        start, count, anchor = segments(self.h, self.words.first, hot)
        row = np.searchsorted(self.words.first, start, "right") - 1
        keep = self.known[row]
        self.start, self.count, self.anchor, self.row = start[keep], count[keep], anchor[keep], row[keep]
        self.own = own
        self.key = span_hashes(self.h, self.start, self.start + self.count + WINDOW - 1)


def slots_of(hot: np.ndarray) -> Slots | None:
    if not len(hot):
        return None
    slots = Slots(max(4, int(len(hot) * 4).bit_length()))
    slots.add(hot << np.uint64(1), np.zeros(len(hot), np.int32))
    return slots


def anchor_parts(pack: Pack, n_shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A pack's distinct anchors in order of shard, their shards, whether two of its documents share it, and where each segment's anchor is."""
    anchor, back = np.unique(pack.anchor, return_inverse=True)
    least, most = np.full(len(anchor), LAST), np.full(len(anchor), np.iinfo(np.int64).min)
    own = pack.own[pack.row]
    np.minimum.at(least, back, own)
    np.maximum.at(most, back, own)
    shard = (mix(anchor) % np.uint64(n_shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return anchor[order], shard[order], (least < most)[order], place[back]


def heads_of(shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of equal values."""
    if not len(shard):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    heads = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    return heads, np.append(heads[1:], len(shard))


def shared_anchors(messages: list[bytes]) -> list[bytes]:
    """For every pack's anchors a bit that says whether two documents hold it."""
    parts = [packs.from_bytes(m, "<u4", "u1") for m in messages]
    key, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    twice = np.bincount(back, minlength=len(key)) + np.bincount(back, np.concatenate([np.unpackbits(p[1], count=len(p[0])) for p in parts]), len(key)) > 1
    out, at = [], 0
    for p in parts:
        out.append(np.packbits(twice[back[at : at + len(p[0])]]).tobytes())
        at += len(p[0])
    return out


def shard_answers(group: pa.Table) -> Iterator[tuple[int, bytes]]:
    """(pack, answers) of one shard's segments."""
    texts: list[bytes] = []
    low, high, pack = [], [], []
    for number, data in zip(group.column("pack").to_pylist(), group.column("segments").to_pylist()):
        sizes, lo, hi, joined = packs.from_bytes(data, "<u4", "<i8", "<i8", "bytes")
        at = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))]).tolist()
        texts += [joined[a:b] for a, b in zip(at[:-1], at[1:])]
        low.append(lo)
        high.append(hi)
        pack.append(np.full(len(lo), number))
    lo, hi, pack_of = np.concatenate(low), np.concatenate(high), np.concatenate(pack)
    words = Words(texts)
    h, first = words.hashes(), words.first
    key, where, back = np.unique(span_hashes(h, first[:-1], first[1:]), return_index=True, return_inverse=True)
    least = np.full(len(key), LAST)
    np.minimum.at(least, back, lo)
    counts = words.counts[where]
    index = FMIndex(h[ragged(first[:-1][where], counts)], counts)
    n_windows = counts - WINDOW + 1
    ends = ragged(index.starts + WINDOW - 1, n_windows)
    matched, a, b = index.search(ends, WINDOW)
    answer = np.repeat(least, n_windows)
    full = matched == WINDOW
    of_place = np.repeat(least, counts + 1)
    answer[full] = index.least(of_place, a[full], b[full])
    at = np.concatenate([[0], np.cumsum(n_windows)])
    best = np.minimum.reduceat(answer, at[:-1])
    useful = best[back] < hi
    entry, owner = back[useful], pack_of[useful]
    order = np.argsort(owner, kind="stable")
    entry, owner = entry[order], owner[order]
    for i, end in zip(*heads_of(owner)):
        mine = entry[i:end]
        yield int(owner[i]), packs.to_bytes(key[mine], answer[ragged(at[mine], n_windows[mine])])


def removed(pack: Pack, answers: list[bytes]) -> np.ndarray:
    """For every word of a pack whether it goes."""
    gone = np.zeros(len(pack.h) + 1, np.int64)
    if answers and len(pack.key):
        keys, values = zip(*(packs.from_bytes(a, "<u8", "<i8") for a in answers))
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(pack.key, kind="stable")
        sizes = pack.count[order[np.searchsorted(pack.key[order], keys)]]
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        by = np.argsort(keys)
        at = np.minimum(np.searchsorted(keys[by], pack.key), len(keys) - 1)
        hit = np.flatnonzero(keys[by][at] == pack.key)
        which = by[at[hit]]
        least = values[ragged(begin[which], pack.count[hit])]
        own = np.repeat(pack.own[pack.row[hit]], pack.count[hit])
        window = ragged(pack.start[hit], pack.count[hit])[least < own]
        np.add.at(gone, window, 1)
        np.add.at(gone, window + WINDOW, -1)
    return np.cumsum(gone)[:-1] > 0


def dedup(docs: DataFrame, keep_unchanged: bool = False) -> DataFrame:
    """All columns of ``docs``, with ``text`` replaced by the kept words joined by a space, and n_words, n_removed.

    ``docs`` needs doc_id and text; columns named n_words or n_removed are replaced. With ``keep_unchanged``, a text
    that loses no word stays as it is, white space and nulls included.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).drop("n_words", "n_removed")
    table = packs.write(docs)
    hot = packs.frequent(table, lambda rows: Pack(rows, None).anchor, HOT_SHARE)
    n = packs.n_shards(table, SHARD_BYTES)
    out_schema = StructType([*docs.schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType())])
    names = docs.columns

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent_ones = slots_of(hot)
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                anchor, shard, twice, _ = anchor_parts(Pack(packs.open_pack(data), frequent_ones), n)
                begin, end = heads_of(shard)
                message = [packs.to_bytes((mix(anchor[i:j]) >> np.uint64(32)).astype("<u4"), np.packbits(twice[i:j])) for i, j in zip(begin.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(shard[begin]), pa.array(np.full(len(begin), number)), pa.array(message, pa.binary())], ["shard", "pack", "message"])

    def tell(group: pa.Table) -> pa.Table:
        bits = shared_anchors(group.column("message").to_pylist())
        return pa.table({"pack": group.column("pack"), "shard": group.column("shard"), "bits": pa.array(bits, pa.binary())})

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        pack = Pack(packs.open_pack(left.column("rows")[0].as_py()), slots_of(hot))
        anchor, shard, _, place = anchor_parts(pack, n)
        given, begin, end = dict(zip(right.column("shard").to_pylist(), right.column("bits").to_pylist())), *heads_of(shard)
        bits = [np.unpackbits(np.frombuffer(given[s], np.uint8), count=j - i) for s, i, j in zip(shard[begin].tolist(), begin.tolist(), end.tolist())]
        chosen = np.flatnonzero(np.concatenate(bits)[place]) if bits else np.empty(0, np.int64)
        return sent(left.column("pack")[0].as_py(), pack, chosen)

    def sent(number: int, pack: Pack, chosen: np.ndarray) -> pa.Table:
        key, where, back = np.unique(pack.key[chosen], return_index=True, return_inverse=True)
        where = chosen[where]
        lo, hi = np.full(len(key), LAST), np.full(len(key), np.iinfo(np.int64).min)
        own = pack.own[pack.row[chosen]]
        np.minimum.at(lo, back, own)
        np.maximum.at(hi, back, own)
        shard = (mix(pack.anchor[where]) % np.uint64(n)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        shard, where, lo, hi = shard[order], where[order], lo[order], hi[order]
        a, b = pack.words.starts[pack.start[where]], pack.words.ends[pack.start[where] + pack.count[where] + WINDOW - 2]
        joined, blobs, (begin, end) = pack.words.joined, [], heads_of(shard)
        for i, j in zip(begin.tolist(), end.tolist()):
            text = b"".join([joined[x:y] for x, y in zip(a[i:j].tolist(), b[i:j].tolist())])
            blobs.append(packs.to_bytes((b[i:j] - a[i:j]).astype("<u4"), lo[i:j], hi[i:j], text))
        return pa.table({"shard": pa.array(shard[begin]), "pack": pa.array(np.full(len(begin), number)), "segments": pa.array(blobs, pa.binary())})

    def answer(group: pa.Table) -> pa.Table:
        rows = list(shard_answers(group))
        return pa.table({"pack": pa.array([r[0] for r in rows], pa.int64()), "answers": pa.array([r[1] for r in rows], pa.binary())})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = packs.open_pack(left.column("rows")[0].as_py())
        pack = Pack(rows, slots_of(hot))
        gone = removed(pack, right.column("answers").to_pylist())
        words, first = pack.words, pack.words.first
        n_gone = np.add.reduceat(np.append(gone, False).astype(np.int64), first[:-1]) * (words.counts > 0)
        starts, ends, texts = words.starts, words.ends, []
        before = rows.column("text").to_pylist() if keep_unchanged else []
        for i, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            if keep_unchanged and not n_gone[i]:
                texts.append(before[i])
                continue
            keep = x + np.flatnonzero(~gone[x:y])
            texts.append(b" ".join([words.joined[p:q] for p, q in zip(starts[keep].tolist(), ends[keep].tolist())]).decode())
        columns = {c: rows.column(c) for c in names} | {"text": pa.array(texts, pa.string()), "n_words": pa.array(words.counts), "n_removed": pa.array(n_gone)}
        return pa.table(columns)

    rows = table.select("pack", "rows")
    bits = rows.mapInArrow(ask, "shard long, pack long, message binary").groupBy("shard").applyInArrow(tell, "pack long, shard long, bits binary")
    segments_ = rows.groupBy("pack").cogroup(bits.groupBy("pack")).applyInArrow(send, "shard long, pack long, segments binary")
    answers = segments_.groupBy("shard").applyInArrow(answer, "pack long, answers binary")
    return rows.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(finish, out_schema)


#: The query's rows in DuckDB's SQL.
ORACLE_SQL = """
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
windows as (select doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d)),
owners as (select k, min(doc_id) as first_id from windows group by k),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from windows join owners using (k) where first_id < doc_id),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (select doc_id, count(*) as n_kept, string_agg(word, ' ' order by p) as text from words anti join gone using (doc_id, p) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, (len(d.w) - coalesce(n_kept, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept on kept.doc_id = d.doc_id
"""
