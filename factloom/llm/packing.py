"""Problem 6: fill fixed-capacity containers with documents, by lexical retrieval.

Documents are put into shards of about equal weight (their number and their tokens) by content: the sides of random planes on which their terms lie make a topic, and
neighbouring topics share a shard; a topic larger than a shard is spread over several. A shard scores every document against every other
by BM25 over all their token ids and fills, for every pack, one container after another: the largest unused document is the seed, its
unused neighbours that fit go in best first until none is left that fits, and only then do documents that share nothing with the seed,
largest first. A document longer than a container is divided into full containers and a rest, which is packed like any other item;
nothing else is divided.

Cases: documents without tokens (null, empty) go into the shard's first container; a document of exactly the capacity fills one; equal
documents are items of their own; packs without a positive capacity are left out; an empty table gives an empty result. Shards depend on
the documents only, so the result does not depend on the order or the splits of the input, and no source, language or topic is a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import materialize
from .tokens import VOCABULARY, token_counts

#: documents of a shard, about, and their tokens: the index of a shard is held by one task
SHARD, SHARD_TOKENS = 4096, 1 << 24
#: bits of a topic
TOPIC = 16
#: neighbours that are put in order at a time; the walk goes on until none is left
STEP = 32
#: terms of a dense product at a time
DENSE = 2048
#: places that shards are spread over, at most
MOST_PLACES = 50_000
K1, B = 1.2, 0.75
PACKED = "pack_name string, doc_id bigint, piece int, tokens int, container bigint"


class Index:
    """BM25 of every document of a shard as a query, with all its terms, against every document of the shard."""

    def __init__(self, terms: list[np.ndarray], tfs: list[np.ndarray], lengths: np.ndarray):
        self.n = n = len(terms)
        docs = np.repeat(np.arange(n), [len(t) for t in terms])
        flat = np.concatenate(terms) if terms else np.empty(0, np.int32)
        tf = np.concatenate(tfs).astype(np.float32) if tfs else np.empty(0, np.float32)
        _, ids, df = np.unique(flat, return_inverse=True, return_counts=True)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32)
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean() if n else 1.0)).astype(np.float32)
        weight = (idf[ids] * tf * (K1 + 1) / (tf + norm[docs])).astype(np.float32)
        order = np.argsort(ids, kind="stable")
        posted, weights = docs[order], weight[order]
        start = np.concatenate([[0], np.cumsum(df)])
        self.scores = np.zeros((n, n), np.float32)
        # frequent terms by dense products, the others along their postings; terms of one document reach no neighbour
        common = np.flatnonzero(df > max(1, n // 32))
        for lo in range(0, len(common), DENSE):
            part = common[lo : lo + DENSE]
            at = np.concatenate([np.arange(start[t], start[t + 1]) for t in part])
            col = np.repeat(np.arange(len(part)), df[part])
            has, gives = np.zeros((n, len(part)), np.float32), np.zeros((len(part), n), np.float32)
            has[posted[at], col] = 1
            gives[col, posted[at]] = weights[at]
            self.scores += has @ gives
        useful = (df[ids] > 1) & (df[ids] <= max(1, n // 32))
        ids, docs = ids[useful], docs[useful]
        first = np.searchsorted(docs, np.arange(n + 1))
        for i in range(n):
            spans = [slice(start[t], start[t + 1]) for t in ids[first[i] : first[i + 1]]]
            if spans:
                self.scores[i] += np.bincount(np.concatenate([posted[x] for x in spans]), np.concatenate([weights[x] for x in spans]), n)

    def neighbours(self, seed: int, allowed: np.ndarray, least: int | None = None) -> np.ndarray:
        """Allowed documents that share a term with the seed, best first, then by position: all, or the best `least` and what ties with them."""
        row = self.scores[seed]
        found = np.flatnonzero((row > 0) & allowed)
        if least is not None and len(found) > least:
            score = row[found]
            found = found[score >= np.partition(score, len(score) - least)[len(score) - least]]
        return found[np.argsort(-row[found], kind="stable")]


def fill(sizes: np.ndarray, capacity: int, index: Index) -> np.ndarray:
    """Container number of every item (-1 for size -1, which is no item); sizes are at most the capacity."""
    out = np.full(len(sizes), -1, np.int64)
    free = sizes > 0
    stock: dict[int, list[int]] = {}
    count = np.zeros(capacity + 1, np.int64)
    for i in range(len(sizes) - 1, -1, -1):
        if free[i]:
            stock.setdefault(int(sizes[i]), []).append(i)
            count[sizes[i]] += 1
    have = sum(1 << s for s in stock)  # bit s: an unused item of size s
    size = sizes.tolist()
    box = 0

    def take(i: int) -> None:
        nonlocal have
        free[i] = False
        out[i] = box
        s = size[i]
        count[s] -= 1
        if not count[s]:
            have &= ~(1 << s)

    def largest(space: int) -> int:
        fits = have & ((1 << (space + 1)) - 1)
        if not fits:
            return -1
        shelf = stock[fits.bit_length() - 1]
        while not free[shelf[-1]]:
            shelf.pop()
        return shelf.pop()

    while have:
        seed = largest(capacity)
        take(seed)
        space = capacity - size[seed]
        if have & ((1 << (space + 1)) - 1):
            while space and len(near := index.neighbours(seed, free & (sizes <= space), STEP)):
                for j in near.tolist():
                    if size[j] <= space:
                        take(j)
                        space -= size[j]
            while space and (j := largest(space)) >= 0:
                take(j)
                space -= size[j]
        box += 1
    out[sizes == 0] = 0
    return out


def _pack(packs: list[tuple[str, int]]):
    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("doc_id")
        number = shard.column("shard")[0].as_py()
        ids, tokens = shard.column("doc_id"), shard.column("n_tokens").to_numpy().astype(np.int64)
        terms = [np.frombuffer(x, np.int32) for x in shard.column("terms").to_pylist()]
        index = Index(terms, [np.frombuffer(x, np.int32) for x in shard.column("tfs").to_pylist()], tokens)
        parts = []
        for name, capacity in packs:
            whole = np.where(tokens > capacity, tokens // capacity, 0)  # full containers of documents that are divided
            rest = np.where(tokens > capacity, tokens % capacity, tokens)
            rest = np.where((rest == 0) & (whole > 0), -1, rest)
            box = fill(rest, capacity, index)
            some = np.flatnonzero(rest >= 0)
            full = np.repeat(np.arange(len(tokens)), whole)
            piece = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
            rows = np.concatenate([full, some])
            boxes = np.concatenate([box.max(initial=-1) + 1 + np.arange(len(full)), box[some]])
            parts.append(
                pa.table(
                    [
                        pa.array([name] * len(rows), pa.string()),
                        ids.take(pa.array(rows)),
                        pa.array(np.concatenate([piece, whole[some]]).astype(np.int32)),
                        pa.array(np.concatenate([np.full(len(full), capacity), rest[some]]).astype(np.int32)),
                        pa.array((number << 32) + boxes),
                    ],
                    names=[c.split()[0] for c in PACKED.split(", ")],
                )
            )
        return pa.concat_tables(parts)

    return run


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t, n = np.unique(np.frombuffer(b"".join(b.column("terms").to_pylist()), np.int32), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n.astype(np.int64))], names=["term", "df"])


@cache
def _random(terms: int) -> np.ndarray:
    return np.random.default_rng(8).standard_normal((terms, TOPIC))


def _planes(idf: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Random planes through the mean of all documents (so that long ones, which are near it, part too), terms weighted by rarity."""
    weight = idf * df
    return idf[:, None] * (_random(len(idf)) - weight @ _random(len(idf)) / max(1e-9, weight.sum()))


def _weights(b: pa.RecordBatch) -> np.ndarray:
    """What a document takes of a shard: one of its documents and a share of its tokens."""
    return 1 + b.column("n_tokens").to_numpy().astype(np.int64) * SHARD // SHARD_TOKENS


def _topics(b: pa.RecordBatch, planes: np.ndarray) -> np.ndarray:
    """The topic of every document: on which sides of the planes its terms lie together."""
    bits = 1 << np.arange(TOPIC)
    return np.array([(planes[np.frombuffer(t, np.int32)].sum(axis=0) > 0) @ bits for t in b.column("terms").to_pylist()], np.int64)


def _with_shard(idf: np.ndarray, df: np.ndarray, many: np.ndarray | None = None, shards: int = 1):
    """topic and weight of every document, or (many: weight of every topic) its columns with its shard: an equal part of the ranks by topic."""
    if many is not None:
        start, n = np.cumsum(many) - many, max(1, int(many.sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = _planes(idf, df)
        for b in batches:
            topic = _topics(b, planes)
            if many is None:
                yield pa.RecordBatch.from_arrays([pa.array(topic), pa.array(_weights(b))], names=["topic", "weight"])
            else:
                part = b.column("part").to_numpy() * many[topic] >> 20
                shard = (start[topic] + np.where(many[topic] * shards > n, part, 0)) * shards // n
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in COUNTED), pa.array(shard)], names=[*COUNTED, "shard"])

    return run


COUNTED = ("doc_id", "n_tokens", "terms", "tfs")


def sharded(counted: DataFrame, shard_docs: int) -> DataFrame:
    """counted(doc_id, n_tokens, terms, tfs) with the shard of every document. Counts of terms and topics come to the driver: as many rows
    as the vocabulary has, and 2 ** TOPIC."""
    got = counted.select("terms").mapInArrow(_term_counts, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    n = counted.count()
    df = np.zeros(int(got.column("term").to_numpy().max(initial=-1)) + 1, np.int64)
    df[got.column("term").to_numpy()] = got.column("df").to_numpy()
    idf = np.where(df > 0, np.log(1 + (n - df + 0.5) / (df + 0.5)), 0.0)
    got = counted.select("terms", "n_tokens").mapInArrow(_with_shard(idf, df), "topic bigint, weight bigint").groupBy("topic").agg(F.sum("weight").alias("weight")).toArrow()
    many = np.zeros(1 << TOPIC, np.int64)
    many[got.column("topic").to_numpy()] = got.column("weight").to_numpy()
    shards = max(1, -(-int(many.sum()) // shard_docs))
    run = _with_shard(idf, df, many, shards)
    kinds = dict(counted.dtypes)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).cast("bigint").alias("part")
    out = counted.select(*COUNTED, part).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in COUNTED) + ", shard bigint")
    # a task for every shard, whatever their number: twice as many places, so that few shards share one
    return out.repartition(min(2 * shards, MOST_PLACES), "shard")


def pack_documents(docs: DataFrame, packs: DataFrame, vocabulary: str = VOCABULARY, shard_docs: int = SHARD) -> DataFrame:
    """pack_name, doc_id, piece, tokens, container of every piece of docs(doc_id, text) for every row of
    packs(pack_name, capacity_tokens), a table of fixed size."""
    rows = packs.where("capacity_tokens > 0").select("pack_name", "capacity_tokens").distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("pack_sizes is larger than a list of packs may be")
    sizes = sorted((r.pack_name or "", r.capacity_tokens) for r in rows)
    if not sizes:
        return docs.sparkSession.createDataFrame([], PACKED)
    docs = docs.where(F.col("doc_id").isNotNull())
    counted = materialize(token_counts(docs, ["doc_id"], vocabulary, terms=True), "pack-counts")
    return sharded(counted, shard_docs).groupBy("shard").applyInArrow(_pack(sizes), PACKED)


def unused_space(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """Per pack: containers, documents, tokens and the unused share of the capacity."""
    boxes = packed.groupBy("pack_name", "container").agg(F.sum("tokens").alias("used"), F.count("*").alias("pieces"))
    totals = boxes.groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("used").alias("used_tokens"), F.min("used").alias("least_used"), F.max("used").alias("most_used"))
    out = packs.select("pack_name", "capacity_tokens").distinct().join(totals, "pack_name")
    room = F.col("containers") * F.col("capacity_tokens")
    return out.withColumn("unused_tokens", room - F.col("used_tokens")).withColumn("unused_share", F.round(1 - F.col("used_tokens") / room, 6))
