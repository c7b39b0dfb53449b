"""Language-model scores from an Elias-Fano n-gram trie.

A-Z are lowered; tokens are the words (``[^\\x20\\x09-\\x0D]+``) and one end. Rows whose crc32(doc_id as text) mod
FOLDS is not 0 are counted. The base gives a token (c + 0.1) / (N + 0.1 (V + 1)); the model gives it
(c(context, token) + WEIGHT * base) / (c(context) + WEIGHT), where the context is the word before it or the start.

Every pack of documents sends its distinct tokens and pairs once, with their counts, to the shard of the token or of
the pair's context; pairs of frequent contexts are dealt by the whole pair, so that no shard holds one context whole.
A shard adds up, builds its trie in a mapped file (contexts, monotone pointers, successors, quantised counts) and
answers each pack in the pack's own order, so no key travels back. All counts of all training rows enter; nothing is
pruned.

Tokens are told apart by 56 bits within their shard, a context's successors within a shard by 40. Nulls: a null text has the end alone;
a row without doc_id is scored, but is neither counted nor held out (held_out is null). Repeated rows count each.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm import packs
from cellframe.llm.eliasfano import Trie, restore
from cellframe.llm.pieces import Slots
from cellframe.llm.text import Words, mix, ragged, utf8
from cellframe.session import cut

FOLDS, ALPHA, WEIGHT = 10, 0.1, 300.0
HOT_SHARE = 1 / 20_000
SHARD_BYTES = 4 << 20
#: Bytes of a token's hash that travel; the shard, which another hash of the token chooses, tells more of them apart.
KEY_BYTES = 7
#: Hashes that stand for the end and the start; no word has white space in it.
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
ODD = np.uint64(0xD6E8FEB86659FD93)


def tokens_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all rows, each row's ended by END; where each row starts)."""
    words = Words(utf8(table.column("text")), lower=True)
    first = words.first + np.arange(len(words.first))
    out = np.full(int(first[-1]), END)
    out[ragged(first[:-1], words.counts)] = words.hashes()
    return out, first


class Asked:
    """A pack's distinct tokens and pairs, in the order of their shards."""

    def __init__(self, table: pa.Table, n_shards: int, hot: Slots | None):
        self.ids = table.column("doc_id").to_pylist()
        tokens, self.first = tokens_of(table)
        self.remainder = [zlib.crc32(str(i).encode()) % FOLDS if i is not None else None for i in self.ids]
        trained = np.repeat(np.array([bool(r) for r in self.remainder], bool), np.diff(self.first))
        self.token, self.of_token = np.unique(tokens, return_inverse=True)
        self.token_count = np.bincount(self.of_token, trained, len(self.token)).astype(np.uint32)
        keys = np.append(self.token, START)
        self.context = np.empty(len(tokens), np.int64)
        self.context[1:] = self.of_token[:-1]
        self.context[self.first[:-1]] = len(self.token)
        suffix = mix(self.token ^ ODD) >> np.uint64(64 - Trie.SUFFIX)
        pair, self.of_pair = np.unique(self.context.astype(np.uint64) << np.uint64(Trie.SUFFIX) | suffix[self.of_token], return_inverse=True)
        self.pair_count = np.bincount(self.of_pair, trained, len(pair)).astype(np.uint32)
        self.owner, self.suffix = (pair >> np.uint64(Trie.SUFFIX)).astype(np.int64), pair & np.uint64((1 << Trie.SUFFIX) - 1)
        self.keys = keys
        by_token = mix(keys + ODD)
        spread = by_token[self.owner]
        if hot is not None:
            wide = (hot.get(keys) >= 0)[self.owner]
            spread[wide] = mix(spread[wide] ^ self.suffix[wide])
        self.token_shard = (by_token[:-1] % np.uint64(n_shards)).astype(np.int64)
        self.pair_shard = (spread % np.uint64(n_shards)).astype(np.int64)
        small = np.uint16 if n_shards <= 1 << 16 else np.int64
        self.token_order = np.argsort(self.token_shard.astype(small), kind="stable")
        self.pair_order = np.argsort(self.pair_shard.astype(small), kind="stable")

    def parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, its tokens, its pairs) of the shards that get any."""
        shards = np.union1d(self.token_shard, self.pair_shard)
        t, p = self.token_shard[self.token_order], self.pair_shard[self.pair_order]
        cuts = [np.searchsorted(x, shards, side) for x in (t, p) for side in ("left", "right")]
        for s, a, b, c, d in zip(shards.tolist(), *(x.tolist() for x in cuts)):
            yield s, self.token_order[a:b], self.pair_order[c:d]

    def message(self, tokens: np.ndarray, pairs: np.ndarray) -> bytes:
        owner = self.owner[pairs]
        heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
        own = lambda keys: packs.narrow(keys >> np.uint64(64 - 8 * KEY_BYTES), KEY_BYTES)
        sizes = np.diff(np.append(heads, len(owner))).astype("<u4")
        return packs.to_bytes(own(self.token[tokens]), self.token_count[tokens], own(self.keys[owner[heads]]), sizes, packs.narrow(self.suffix[pairs], Trie.SUFFIX // 8), self.pair_count[pairs])


def answer_shard(messages: list[bytes]) -> tuple[list[bytes], int, int]:
    """Answers to the packs' messages, and the shard's distinct and total training tokens."""
    parts = [packs.from_bytes(m, "u1", "<u4", "u1", "<u4", "u1", "<u4") for m in messages]
    token, count, context, size, suffix, pairs = (np.concatenate([p[i] for p in parts]) for i in range(6))
    token, context, suffix = packs.widen(token, KEY_BYTES), packs.widen(context, KEY_BYTES), packs.widen(suffix, Trie.SUFFIX // 8)
    _, of = np.unique(token, return_inverse=True)
    total = np.bincount(of, count)
    size = size.astype(np.int64)
    key, of_context = np.unique(context, return_inverse=True)
    if len(key) >= 1 << (64 - Trie.SUFFIX):
        raise ValueError("too many contexts in one shard; lower SHARD_BYTES")
    pair, of_pair = np.unique(np.repeat(of_context.astype(np.uint64), size) << np.uint64(Trie.SUFFIX) | suffix, return_inverse=True)
    trained = np.bincount(of_pair, pairs, len(pair))
    pair, trained = pair[trained > 0], trained[trained > 0]
    owner, sizes = np.unique((pair >> np.uint64(Trie.SUFFIX)).astype(np.int64), return_counts=True)
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "trie")
        Trie.build(key[owner], sizes, pair & np.uint64((1 << Trie.SUFFIX) - 1), trained, path)
        trie = Trie.open(path)
        codes = trie.counts(context, size, suffix)
        del trie
    out, t, p = [], 0, 0
    whole = total[of].astype("<u8")
    for part in parts:
        n, m = len(part[1]), len(part[5])
        out.append(packs.to_bytes(whole[t : t + n], codes[p : p + m]))
        t, p = t + n, p + m
    return out, int((total > 0).sum()), int(total.sum())


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    table = packs.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    hot = packs.frequent(table, lambda rows: tokens_of(rows)[0], HOT_SHARE)
    n = packs.n_shards(table, SHARD_BYTES)

    def slots() -> Slots | None:
        if not len(hot):
            return None
        out = Slots(max(4, int(len(hot) * 4).bit_length()))
        out.add(hot, np.zeros(len(hot), np.int32))
        return out

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = slots()
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                asked = Asked(packs.open_pack(data), n, wide)
                rows = [(s, asked.message(t, p)) for s, t, p in asked.parts()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([number] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "pack", "message"])

    def answer(group: pa.Table) -> pa.Table:
        out, distinct, total = answer_shard(group.column("message").to_pylist())
        shard = group.column("shard")[0].as_py()
        number = [None, *group.column("pack").to_pylist()]  # the row without a pack has the shard's sums
        return pa.table({"pack": pa.array(number, pa.int64()), "shard": pa.array([shard] * len(number)), "answers": pa.array([None, *out], pa.binary()), "distinct": pa.array([distinct] + [0] * len(out)), "total": pa.array([total] + [0] * len(out))})

    asked = table.select("pack", "rows").mapInArrow(send, "shard long, pack long, message binary")
    answers = cut(asked.groupBy("shard").applyInArrow(answer, "pack long, shard long, answers binary, distinct long, total long"))
    v, total = answers.agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = Asked(packs.open_pack(left.column("rows")[0].as_py()), n, slots())
        given = dict(zip(right.column("shard").to_pylist(), right.column("answers").to_pylist()))
        c, both = np.zeros(len(asked.token)), np.zeros(len(asked.owner))
        for shard, tokens, pairs in asked.parts():
            whole, codes = packs.from_bytes(given[shard], "<u8", "<u2")
            c[tokens], both[pairs] = whole, restore(codes)
        base = (c + ALPHA) / (total + ALPHA * (v + 1))
        starts = c[np.flatnonzero(asked.token == END)]  # as many starts as ends
        before = np.append(c, starts[0] if len(starts) else 0.0)[asked.context]
        own = base[asked.of_token]
        p = (both[asked.of_pair] + WEIGHT * own) / (before + WEIGHT)
        sums = [np.add.reduceat(x, asked.first[:-1]) for x in (np.log10(own), np.log10(p), (c > 0)[asked.of_token].astype(np.int64))]
        held_out = pa.array([None if r is None else r == 0 for r in asked.remainder], pa.bool_())
        n_tokens = np.diff(asked.first)
        return pa.table({
            "doc_id": pa.array(asked.ids, pa.int64()), "held_out": held_out, "n_tokens": pa.array(n_tokens.astype(np.int64)), "n_known": pa.array(sums[2]),
            "train_tokens": pa.array(np.full(len(n_tokens), total, np.int64)), "base_score": pa.array(sums[0]), "score": pa.array(sums[1]),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    replies = answers.where(F.col("pack").isNotNull()).select("pack", "shard", "answers")
    return table.select("pack", "rows").groupBy("pack").cogroup(replies.groupBy("pack")).applyInArrow(finish, schema)
