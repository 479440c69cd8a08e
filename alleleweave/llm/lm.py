"""LM scoring by deleted interpolation.

P(w | v) mixes the maximum-likelihood estimates of a word after the word before it and of a word alone
with the uniform 1 / (V + 1). The three weights depend on how often the context v occurs, by powers of two.
They are learned by expectation-maximisation on deleted counts: each occurrence in the training texts is
held out of the counts that predict it.

Counts are exact and cover all training texts, and nothing of them is ever on one machine:

1. Blocks: texts become blocks of ``BLOCK`` tokens, each with a list of its words' hashes. A text that is
   longer goes on in the next block.
2. Requests: a block sends its distinct words and word pairs, as sorted hashes with its own
   counts, to the buckets that own them by their leading bits. A frequent word or pair arrives once from
   each block, however often it occurs.
3. Replies: a bucket adds up and sends each block the totals in the order of its request.
4. A block has all counts of its tokens now, and is written with them: read once for the histogram that EM
   needs, and once for the scores.

Words and pairs are told apart by 64 bits of a hash: of n distinct ones about n**2 / 2**65 share their counts,
one for six thousand million.

A request has a row for each block and bucket that it has a key of. With more than 2**RELAYED buckets a block asks as many relays
instead, each for some 2**RELAYED blocks, which put their keys together and ask on: so a row has about 2**10 keys up to 2**20
buckets of ``BUCKET_TOKENS``, and the keys travel twice.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, release

#: Tokens of a block, which a task holds with some 100 bytes for each.
BLOCK = 1 << 20
#: Tokens for which there is a bucket.
BUCKET_TOKENS = 1 << 20
#: Leading bits by which blocks ask buckets at once; with more buckets than that, relays stand between them.
RELAYED = 10
#: Tokens that are scored at a time, and bytes of a text that are cut into words at a time.
SLICE = 1 << 16
PIECE = 1 << 20
#: The end of a text, which is also the context of its first word: no word, as it holds a space.
END = b" "
SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Log2 ratios to the uniform lie within -RANGE .. RANGE and are put into bins of 1/STEPS for EM, so the histogram has at
#: most 65 * (2 * RANGE * STEPS + 2)**2 rows, whatever the corpus. Each bin keeps the mean of its ratios.
STEPS, RANGE = 2, 64
ROUNDS = 200
LEAST_WEIGHT = 1e-6
#: Added to each count by the base score.
ADDED = 0.1


OTHER_ORDER = "the texts came in another order when a lost block was made again"


def _pack(x: np.ndarray, level: int = 1) -> bytes:
    """Bytes of equal weight stand together, which helps the compressor."""
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    x = before * np.uint64(0x9E3779B97F4A7C15) + after
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A text in pieces of about ``size`` bytes that end before white space."""
    start = 0
    while start < len(text):
        space = SPACE.search(text, start + size) if start + size < len(text) else None
        end = space.start() if space else len(text)
        yield text[start:end]
        start = end


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, of which one is held at a time."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


#: A block's parts of texts: the row that a part belongs to, whether it is held out, its tokens, and the word before it.
PARTS = "rows array<long>, held array<boolean>, lengths array<int>"


def _blocks(docs: DataFrame, size: int) -> DataFrame:
    """(block, ids, PARTS, before, tokens, words) from (id, text, held), in blocks of ``size`` tokens."""
    kind = docs.schema["id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    names = ["block", "ids", "rows", "held", "lengths", "before", "tokens", "words"]
    kinds = [pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]

    class Open:
        def __init__(self) -> None:
            self.known, self.tokens = {END: 0}, array("I")
            self.ids, self.rows, self.held, self.lengths, self.before = [], [], [], [], []

        def begin(self, i, row: int, held: bool, word: bytes) -> None:
            for to, x in zip((self.ids, self.rows, self.held, self.lengths, self.before), (i, row, held, 0, self.known.setdefault(word, len(self.known)))):
                to.append(x)

        def add(self, words: list[bytes]) -> None:
            known = self.known
            self.tokens.extend([known.setdefault(w, len(known)) for w in words])
            self.lengths[-1] += len(words)

        def closed(self, number: int) -> pa.RecordBatch:
            words = np.fromiter(map(xxhash.xxh64_intdigest, self.known), np.uint64, len(self.known))
            out = [number, self.ids, self.rows, self.held, self.lengths, self.before, _pack(np.frombuffer(self.tokens, np.uint32), 3), _pack(words)]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks, texts, block = TaskContext.get().partitionId(), 0, 0, Open()
        for batch in batches:
            for i, t, h in zip(batch.column(0), batch.column(1), batch.column(2)):
                i, row, h, last, open_ = i.as_py(), (part << 33) + texts, h.as_py(), END, False
                texts += 1
                for words in (*(p.lower().split() for p in pieces(t.as_py() or b"")), [END]):  # of bytes: A-Z and ASCII white space only
                    while words:
                        if not open_:
                            block.begin(i, row, h, last)
                            open_ = True
                        room = max(1, size - len(block.tokens))
                        block.add(words[:room])
                        last, words = words[:room][-1], words[room:]
                        if len(block.tokens) >= size:
                            yield block.closed((part << 32) + blocks)
                            blocks, block, open_ = blocks + 1, Open(), False
        if block.ids:
            yield block.closed((part << 32) + blocks)
        release()

    return docs.mapInArrow(run, f"block long, ids array<{kind}>, {PARTS}, before array<int>, tokens binary, words binary")


class _Parts:
    """Where a block's parts of texts begin, and which of its tokens are trained on."""

    def __init__(self, row: dict) -> None:
        self.lengths = np.array(row["lengths"], np.int64)
        self.held = np.array(row["held"], bool)
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.trained = np.repeat(~self.held, self.lengths)


class _Keys(_Parts):
    """Beside that, each token and the one before it, as places in the block's list of words, and the distinct words
    and pairs in the order of their hashes."""

    def __init__(self, row: dict) -> None:
        super().__init__(row)
        self.mark = xxhash.xxh3_64_intdigest(row["tokens"], xxhash.xxh3_64_intdigest(row["words"])) >> 1
        self.word = _unpack(row["tokens"], np.uint32).astype(np.int64)
        self.before = np.array(row["before"], np.int64)
        context = np.r_[0, self.word[:-1]]
        context[self.starts] = self.before
        hashes = _unpack(row["words"], np.uint64)
        self.pairs, self.pair = np.unique(pair_keys(hashes[context], hashes[self.word]), return_inverse=True)
        self.order = np.argsort(hashes)
        self.words = hashes[self.order]

    def requests(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        own = np.bincount(self.word[self.trained], minlength=len(self.words))[self.order]
        yield 0, self.words, own.astype(np.uint32)
        yield 1, self.pairs, np.bincount(self.pair[self.trained], minlength=len(self.pairs)).astype(np.uint32)


ASKED = "block long, mark long, kind int, bucket int, keys binary, counts binary"
SAID = "block long, mark long, kind int, bucket int, totals binary, seen long"
_asked = pa.schema([("block", pa.int64()), ("mark", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_said = pa.schema([("block", pa.int64()), ("mark", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary()), ("seen", pa.int64())])


def _cut(keys: np.ndarray, counts: np.ndarray, bits: int, **about) -> list[dict]:
    """Rows of ASKED for sorted keys: one for each bucket, by the leading bits, that has any."""
    lead = keys >> np.uint64(64 - bits)
    starts = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]]) if len(keys) else []
    ends = np.r_[starts[1:], len(keys)] if len(keys) else []
    return [about | {"bucket": int(lead[s]), "keys": _pack(np.diff(keys[s:e], prepend=np.uint64(0))), "counts": _pack(counts[s:e])} for s, e in zip(starts, ends)]


def _added(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct keys of rows of ASKED, which lose their keys and counts; the sums of their counts; and each row's places."""
    keys = [np.cumsum(_unpack(r.pop("keys"), np.uint64), dtype=np.uint64) for r in rows]
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([_unpack(r.pop("counts"), np.uint32) for r in rows]), minlength=len(distinct))
    return distinct, total.astype(np.uint64), np.split(at, cuts)


def _answered(asked: DataFrame) -> DataFrame:
    """SAID for ASKED: the totals of a row's keys over all rows of its bucket."""

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        _, total, places = _added(rows)
        seen = int((total > 0).sum())
        out = [r | {"totals": _pack(total[x]), "seen": 0 if k else seen} for k, (r, x) in enumerate(zip(rows, places))]
        return pa.Table.from_pylist(out, schema=_said)

    return asked.groupBy("kind", "bucket").applyInArrow(add, SAID)


def _relayed(asked: DataFrame, bits: int, blocks: int) -> DataFrame:
    """The same where there are so many buckets that a block has few keys for each. ``asked`` are buckets of ``RELAYED``
    leading bits; a relay has such a bucket's rows of some 2**RELAYED blocks, about as many keys as a block, asks for them like one
    with all ``bits``, and hands each block its part of the answer."""
    relays = asked.withColumn("relay", F.pmod(F.xxhash64("block"), F.lit(max(1, blocks >> RELAYED))).cast("int")).repartition("kind", "bucket", "relay")  # read twice

    def mark_of(distinct: np.ndarray) -> int:
        return xxhash.xxh3_64_intdigest(distinct.tobytes()) >> 1

    def pass_on(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        about = {"block": rows[0]["bucket"] << 32 | rows[0]["relay"], "kind": rows[0]["kind"]}
        distinct, total, _ = _added(rows)
        return pa.Table.from_pylist(_cut(distinct, total.astype(np.uint32), bits, mark=mark_of(distinct), **about), schema=_asked)

    def hand_back(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, said = left.to_pylist(), sorted(right.to_pylist(), key=lambda r: r["bucket"])
        distinct, _, places = _added(rows)
        totals = np.concatenate([_unpack(r["totals"], np.uint64) for r in said])
        if {r["mark"] for r in said} != {mark_of(distinct)} or len(totals) != len(distinct):
            raise RuntimeError(OTHER_ORDER)
        seen = sum(r["seen"] for r in said)
        out = [{c: r[c] for c in ("block", "mark", "kind", "bucket")} | {"totals": _pack(totals[x]), "seen": 0 if k else seen} for k, (r, x) in enumerate(zip(rows, places))]
        return pa.Table.from_pylist(out, schema=_said)

    answers = _answered(relays.groupBy("kind", "bucket", "relay").applyInArrow(pass_on, ASKED))
    answers = answers.withColumns({"coarse": F.shiftright("block", 32).cast("int"), "relay": F.col("block").bitwiseAND((1 << 32) - 1).cast("int")})
    return relays.groupBy("kind", "bucket", "relay").cogroup(answers.groupBy("kind", "coarse", "relay")).applyInArrow(hand_back, SAID)


def _replies(blocks: DataFrame, bits: int, n_blocks: int) -> DataFrame:
    """SAID: to each of ``blocks`` the totals of its keys, in their order, by buckets; the ``seen`` of a kind add up to the number
    of its trained keys."""
    own = min(bits, RELAYED)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                block = _Keys(row)
                for kind, keys, counts in block.requests():
                    for asked in _cut(keys, counts, own, block=row["block"], mark=block.mark, kind=kind):
                        yield pa.RecordBatch.from_pylist([asked], schema=_asked)
                del block
        release()

    requests = blocks.mapInArrow(ask, ASKED)
    return _answered(requests) if bits <= RELAYED else _relayed(requests, bits, n_blocks)


def _counted(blocks: DataFrame, replies: DataFrame, kind: str) -> DataFrame:
    """(ids, PARTS, before, words, pairs, train, seen): c(w) and c(v w) of each of the block's tokens, c(v) of each part's first
    context, the number of its trained tokens, and a share of the number of distinct trained words."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        b = _Keys(left.select(["held", "lengths", "before", "tokens", "words"]).to_pylist()[0])
        said = sorted(right.drop_columns(["seen"]).to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
        words, pairs = (np.concatenate([_unpack(r["totals"], np.uint64) for r in said if r["kind"] == k]) for k in (0, 1))
        if {r["mark"] for r in said} != {b.mark} or len(words) != len(b.words) or len(pairs) != len(b.pairs):
            raise RuntimeError(OTHER_ORDER)
        own = np.empty_like(words)
        own[b.order] = words
        counts = [pa.array([own[b.before].astype(np.int64)], pa.list_(pa.int64())), *(pa.array([_pack(x)], pa.binary()) for x in (own[b.word], pairs[b.pair]))]
        seen = sum(s for s, k in zip(right.column("seen").to_pylist(), right.column("kind").to_pylist()) if k == 0)
        numbers = [pa.array([x], pa.int64()) for x in (int(b.trained.sum()), seen)]
        return pa.Table.from_arrays([left.column(c) for c in ("ids", "rows", "held", "lengths")] + counts + numbers, schema=out)

    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    out = pa.schema([("ids", pa.list_(types[kind])), ("rows", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("before", pa.list_(pa.int64())), ("words", pa.binary()), ("pairs", pa.binary()), ("train", pa.int64()), ("seen", pa.int64())])
    both = blocks.groupBy("block").cogroup(replies.groupBy("block"))
    return both.applyInArrow(join, f"ids array<{kind}>, {PARTS}, before array<long>, words binary, pairs binary, train long, seen long")


class _Counts(_Parts):
    """A block with c(v w), c(v) and c(w) of each token. A context's count is that of the token before."""

    def __init__(self, row: dict) -> None:
        super().__init__(row)
        self.c_word, self.c_pair = (_unpack(row[c], np.uint64).astype(np.int64) for c in ("words", "pairs"))
        self.c_context = np.r_[0, self.c_word[:-1]]
        self.c_context[self.starts] = row["before"]


def context_bucket(c: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + floor(log2(c))."""
    return np.where(c > 0, 1 + np.floor(np.log2(np.maximum(c, 1))).astype(np.int64), 0)


def _ratio_bin(ratio: np.ndarray) -> np.ndarray:
    """0 for a ratio of 0; else log2 in 1/STEPS, counted from 1."""
    edge = RANGE * STEPS
    return np.where(ratio > 0, np.clip(np.rint(STEPS * np.log2(np.maximum(ratio, 1e-300))), -edge, edge).astype(np.int64) + edge + 1, 0)


def learn_weights(histogram: pd.DataFrame) -> np.ndarray:
    """Weights of pair, word and uniform for each context bucket, by EM, from (bucket, pair, word, n): the ratios of the
    pair's and the word's estimate to the uniform, and how many tokens have them."""
    out = np.tile([0.0, 0.0, 1.0], (65, 1))
    for k in range(65):
        h = histogram[histogram["bucket"] == k]
        if h.empty:
            if k:
                out[k] = out[k - 1]
            continue
        p = np.stack([h["pair"].to_numpy(float), h["word"].to_numpy(float), np.ones(len(h))])
        n, w = h["n"].to_numpy(float), np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            mixed = w[:, None] * p
            w = (mixed / mixed.sum(0) * n).sum(1) / n.sum()
        w = np.maximum(w, [0, LEAST_WEIGHT, LEAST_WEIGHT])
        if k == 0:
            w[0] = 0.0
        out[k] = w / w.sum()
    return out


def lm_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """One row per row of ``docs``: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows for which ``held_out`` is not true. Null and empty texts are one end token; texts of any length
    are scored whole. base_score is that of word counts with ``ADDED`` added to each, score the model's, both as log10 of the
    probability of all tokens. Without training rows both are 0 but for the base's own arithmetic. Rows with equal or null
    ids stay apart; other columns are ignored; an empty table gives an empty result. Blocks that are lost with an executor are
    made again from ``docs``, which must give the same rows in the same order then, as tables do; else an error is raised.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("bigint", "int", "string"):
        raise ValueError(f"ids of type {kind}")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    tokens = slim.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) / 6 + 1)).head()[0] or 0  # about; it only sets the number of buckets
    blocks = _blocks(slim, block_tokens).repartition("block")  # one exchange, read for the requests and again to meet the replies
    bits = max(1, math.ceil(math.log2(max(2, tokens / bucket_tokens))))
    counted = checkpointed(_counted(blocks, _replies(blocks, bits, int(tokens // block_tokens)), kind))
    about = counted.agg(F.sum("train"), F.sum("seen")).head()
    n, v = about[0] or 0, about[1] or 0
    uniform = 1.0 / (v + 1)

    def slices(b: _Counts) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        for s in range(0, len(b.c_word), SLICE):
            at = slice(s, s + SLICE)
            yield at, b.c_pair[at], b.c_context[at], b.c_word[at]

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                b = _Counts(row)
                for at, *counts in slices(b):
                    if not b.trained[at].any():
                        continue
                    pair, context, word = (x[b.trained[at]] - 1 for x in counts)  # each occurrence is held out
                    p2 = np.where(context > 0, pair / np.maximum(context, 1), 0.0) / uniform
                    p1 = word / max(n - 1, 1) / uniform
                    cell, where = np.unique((context_bucket(context) * 1000 + _ratio_bin(p2)) * 1000 + _ratio_bin(p1), return_inverse=True)
                    sums = [np.bincount(where, x, len(cell)) for x in (p2, p1, np.ones(len(where)))]
                    yield pa.RecordBatch.from_arrays([pa.array(cell), *map(pa.array, sums)], ["cell", "pair", "word", "n"])
        release()

    bins = counted.drop("ids", "rows").mapInArrow(histogram, "cell long, pair double, word double, n double")
    bins = bins.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("pair", "word", "n")])
    bins = bins.select("cell", F.expr("cell div 1000000").alias("bucket"), (F.col("pair") / F.col("n")).alias("pair"), (F.col("word") / F.col("n")).alias("word"), "n")
    weights = learn_weights(bins.orderBy("cell").toPandas())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(_rows(batch.drop_columns(["ids"]))):
                b = _Counts(row)
                base, own = np.empty(len(b.c_word)), np.empty(len(b.c_word))
                for at, pair, context, word in slices(b):
                    w = weights[context_bucket(context)]
                    p = w[:, 0] * np.where(context > 0, pair / np.maximum(context, 1), 0.0) + w[:, 1] * (word / max(n, 1)) + w[:, 2] * uniform
                    base[at] = np.log10((word + ADDED) / (n + ADDED * (v + 1)))
                    own[at] = np.log10(p)
                add = lambda x, b=b: np.add.reduceat(x, b.starts)
                columns = [np.array(row["rows"], np.int64), b.held, b.lengths, add((b.c_word > 0).astype(np.int64)), add(base), add(own)]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, *map(pa.array, columns)], ["id", "row", "held_out", "n_tokens", "n_known", "base_score", "score"])
        release()

    out = counted.mapInArrow(score, f"id {kind}, row long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known")], [F.sum(c).alias(c) for c in ("base_score", "score")]
    out = out.groupBy("row", "id", "held_out").agg(*sums[0], F.lit(n).cast("long").alias("train_tokens"), *sums[1])  # the parts of long texts
    return out.drop("row").withColumnRenamed("id", id_col)
