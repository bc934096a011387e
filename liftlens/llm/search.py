"""Ranked search over bit-sliced Bloom signatures, with exact scores.

Documents of like size stand together in blocks. A block holds a Bloom filter for each of its documents, stored by bit: row b
is a bitmap of the documents that have bit b. The documents that may hold a term are the AND of the term's rows, and there are
none that hold it beside them. Terms that occur twice or more in a document are entered a second time, under another key.

A search adds the weights of an item's terms over these bitmaps, so that each document gets an upper bound of its score: a term
found once adds its weight times the part of one occurrence, and one found twice or more that of the document's most frequent
term. The exact scores of the documents with the largest bounds give a score that the k-th best reaches at least. All documents
whose bound is not below it are scored exactly, each in its block. Texts never leave their block, which no shuffle moves.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftlens.llm import words as W
from liftlens.session import materialize, small_batches

#: Documents and bytes of text in a block, at the most (one text may be longer).
BLOCK_DOCS, BLOCK_BYTES = 1024, 2 << 20
#: Bits of a signature for each key of the block's size class, and rows that a key sets.
BITS, PROBES = 8, 3
#: Bytes of query texts that are searched together.
QUERY_BYTES = 4 << 20
TWICE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64
BLOCK = ("ids binary, known binary, sizes binary, most binary, terms long, bits long, slices binary, "
         "dict_terms binary, dict_docs binary, texts array<binary>")


def term_hasher() -> W.Hasher:
    """Hashes of maximal runs of 0-9, A-Z (as a-z), a-z and characters beyond ASCII."""
    hasher = W.Hasher(20, lower=True)
    byte = np.arange(256)
    alnum = ((byte >= 48) & (byte <= 57)) | ((byte >= 65) & (byte <= 90)) | ((byte >= 97) & (byte <= 122))
    hasher.space = ~(alnum | (byte >= 128))
    return hasher


def bit_rows(terms: np.ndarray, bits: int) -> np.ndarray:
    """The rows that each term sets: (probes, terms)."""
    with np.errstate(over="ignore"):
        return np.stack([W.mix(terms + _U(p + 1) * _U(0xD1342543DE82EF95)) % _U(bits) for p in range(PROBES)]).astype(np.int64)


class _Open:
    """A block that is being filled."""

    def __init__(self):
        self.ids, self.known, self.sizes, self.most, self.keys, self.terms, self.texts, self.bytes = [], [], [], [], [], [], [], 0

    def row(self, bits: int) -> dict:
        d = len(self.ids)
        slices = np.zeros((bits, d), bool)
        for at, keys in enumerate(self.keys):
            slices[bit_rows(keys, bits).ravel(), at] = True
        terms, docs = np.unique(np.concatenate(self.terms), return_counts=True)
        return {"ids": np.array(self.ids, np.int64).tobytes(), "known": np.array(self.known, np.int8).tobytes(),
                "sizes": np.array(self.sizes, np.int64).tobytes(), "most": np.array(self.most, np.int64).tobytes(),
                "terms": sum(self.sizes), "bits": bits, "slices": np.packbits(slices, axis=1).tobytes(),
                "dict_terms": terms.tobytes(), "dict_docs": docs.astype(np.int32).tobytes(), "texts": self.texts}


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of signatures of all documents that hold a term, stored; a narrow pass that knows no query."""
    small_batches(docs.sparkSession)
    fields = {name: {"binary": pa.binary(), "long": pa.int64(), "array<binary>": pa.list_(pa.binary())}[kind]
              for name, kind in (f.split(" ") for f in BLOCK.split(", "))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, blocks = term_hasher(), defaultdict(_Open)
        squeeze = zstandard.ZstdCompressor(level=1).compress

        def table(size: int) -> pa.RecordBatch:
            row = blocks.pop(size).row(BITS * size)
            return pa.RecordBatch.from_arrays([pa.array([row[name]], kind) for name, kind in fields.items()], names=list(fields))

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for chunk in W.chunks(texts, hasher):
                for at, (a, b) in enumerate(zip(chunk.begins.tolist(), chunk.ends.tolist())):
                    if a == b:
                        continue
                    terms, counts = np.unique(chunk.words[a:b], return_counts=True)
                    keys = np.concatenate([terms, terms[counts > 1] ^ TWICE])
                    size = max(1 << (len(keys) - 1).bit_length(), 16)
                    block, key, data = blocks[size], ids[chunk.first + at], texts[chunk.first + at].as_buffer()
                    block.ids.append(0 if key is None else key)
                    block.known.append(key is not None)
                    block.sizes.append(b - a)
                    block.most.append(int(counts.max()))
                    block.keys.append(keys)
                    block.terms.append(terms)
                    block.texts.append(squeeze(data))
                    block.bytes += len(data)
                    if len(block.ids) >= BLOCK_DOCS or block.bytes >= BLOCK_BYTES:
                        yield table(size)
        for size in list(blocks):
            yield table(size)

    blocks = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, BLOCK)
    return materialize(blocks.withColumn("block", F.monotonically_increasing_id()), "signatures")


@dataclass
class Queries:
    """Items of one search: distinct terms, and for each item the places of its terms among them and how often it has them."""

    terms: np.ndarray
    places: list[np.ndarray]
    times: list[np.ndarray]
    weights: np.ndarray | None = None
    docs: int = 0
    words: int = 0

    def lengths(self, sizes: np.ndarray) -> np.ndarray:
        """m of documents with so many terms."""
        return np.array([25 + 75 * n * self.docs // self.words for n in sizes.tolist()], np.int64)


def _read_queries(texts: list[str | None]) -> Queries:
    hasher, found = term_hasher(), []
    for chunk in W.chunks(pa.array(texts, pa.large_string()), hasher):
        found += [np.unique(chunk.words[a:b], return_counts=True) for a, b in zip(chunk.begins, chunk.ends)]
    terms = np.unique(np.concatenate([t for t, _ in found])) if found else np.empty(0, np.uint64)
    return Queries(terms, [np.searchsorted(terms, t) for t, _ in found], [n.astype(np.int64) for _, n in found])


def _weigh(blocks: DataFrame, queries: Queries) -> None:
    """Exact document counts of the items' terms, from the blocks' dictionaries, and the weights that follow."""
    terms = queries.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for own, docs in zip(batch.column(0), batch.column(1)):
                own, docs = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(docs.as_buffer(), np.int32)
                at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                total += np.where(own[at] == terms, docs[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "df"])

    df = np.zeros(len(terms), np.int64)
    for r in blocks.select("dict_terms", "dict_docs").mapInArrow(run, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).collect():
        df[r["at"]] = r["df"]
    queries.weights = np.array([math.floor(1000 * math.log((2 * queries.docs + 2) / (2 * n + 1))) if n else 0 for n in df.tolist()], np.int64)


def _part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _bounds(row: dict, queries: Queries) -> Iterator[tuple[int, np.ndarray]]:
    """(item, upper bounds of the block's documents)."""
    m = queries.lengths(np.frombuffer(row["sizes"], np.int64))
    d, bits = len(m), row["bits"]
    slices = np.frombuffer(row["slices"], np.uint8).reshape(bits, -1)

    def present(terms: np.ndarray) -> np.ndarray:
        rows = bit_rows(terms, bits)
        hit = slices[rows[0]]
        for other in rows[1:]:
            hit = hit & slices[other]
        return hit

    once = present(queries.terms)
    twice = once & present(queries.terms ^ TWICE)
    known = once.any(axis=1)
    one = _part(np.int64(1), m).astype(float)
    more = _part(np.frombuffer(row["most"], np.int64), m) - one
    for item, (places, times) in enumerate(zip(queries.places, queries.times)):
        held = known[places]
        at = places[held]
        if len(at):
            w = (times[held] * queries.weights[at]).astype(float)
            a, b = (w @ np.unpackbits(x[at], axis=1, count=d) for x in (once, twice))
            yield item, a * one + b * more


class _Scorer:
    """Exact scores of the documents of a block; a text is read once for all items that ask for it."""

    def __init__(self, queries: Queries):
        self.queries, self.hasher, self.expand = queries, term_hasher(), zstandard.ZstdDecompressor().decompress

    def parts(self, text: bytes, size: int) -> np.ndarray:
        """Weight times part of each term of the queries."""
        terms = self.queries.terms
        hashes, _ = self.hasher(np.frombuffer(self.expand(text), np.uint8), np.array([0, 0]))
        at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
        tf = np.bincount(at[terms[at] == hashes], minlength=len(terms)).astype(np.int64)
        return self.queries.weights * _part(tf, self.queries.lengths(np.array([size])))

    def score(self, item: int, parts: np.ndarray) -> int:
        return int((self.queries.times[item] * parts[self.queries.places[item]]).sum())


def _rows(found: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * len(names), types)], names=names)


def _likely(blocks: DataFrame, queries: Queries, k: int) -> DataFrame:
    """(item, block, at, bound): the ``k`` documents of each item with the largest bounds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = defaultdict(list)
        for batch in batches:
            for row in batch.to_pylist():
                for item, bound in _bounds(row, queries):
                    top = np.argpartition(-bound, k - 1)[:k] if len(bound) > k else np.arange(len(bound))
                    best[item] = sorted(best[item] + [(float(bound[i]), row["block"], int(i)) for i in top if bound[i] > 0], reverse=True)[:k]
        found = [(item, block, at, bound) for item, rows in best.items() for bound, block, at in rows]
        yield _rows(found, ["item", "block", "at", "bound"], [pa.int32(), pa.int64(), pa.int32(), pa.float64()])

    found = blocks.select("block", "sizes", "most", "bits", "slices").mapInArrow(run, "item int, block long, at int, bound double")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "block", "at")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def _least_scores(blocks: DataFrame, queries: Queries, likely: list, k: int) -> list[int]:
    """For each item a score that its k-th best document reaches at least: the least exact score of ``k`` likely ones."""
    wanted = defaultdict(lambda: defaultdict(list))
    for r in likely:
        wanted[r["block"]][r["at"]].append(r["item"])
    wanted = {block: dict(rows) for block, rows in wanted.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, found = _Scorer(queries), []
        for batch in batches:
            for block, sizes, texts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                sizes = np.frombuffer(sizes.as_buffer(), np.int64)
                for at, items in wanted.get(block, {}).items():
                    parts = scorer.parts(texts[at].as_buffer(), int(sizes[at]))
                    found += [(item, scorer.score(item, parts)) for item in items]
        yield _rows(found, ["item", "score"], [pa.int32(), pa.int64()])

    scored = blocks.select("block", "sizes", "texts").mapInArrow(run, "item int, score long")
    out = [1] * len(queries.places)
    for r in scored.groupBy("item").agg(F.min("score").alias("least"), F.count("*").alias("n")).collect():
        if r["n"] >= k:
            out[r["item"]] = max(r["least"], 1)
    return out


def _best(blocks: DataFrame, queries: Queries, least: list[int], k: int) -> DataFrame:
    """(item, known, doc, score) of the ``k`` best of each item in each task, out of all documents whose bound allows it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, best = _Scorer(queries), defaultdict(list)
        for batch in batches:
            texts = batch.column("texts")
            for i, row in enumerate(batch.drop_columns(["texts"]).to_pylist()):
                ids, known, sizes = (np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("known", np.int8), ("sizes", np.int64)))
                asked = defaultdict(list)
                for item, bound in _bounds(row, queries):
                    for at in np.flatnonzero(bound >= least[item]).tolist():
                        asked[at].append(item)
                for at, items in asked.items():
                    parts = scorer.parts(texts[i][at].as_buffer(), int(sizes[at]))
                    for item in items:
                        score = scorer.score(item, parts)
                        if score >= least[item]:
                            best[item].append((-score, int(known[at]), int(ids[at])))
                            if len(best[item]) > 50 * k:
                                best[item] = sorted(best[item])[:k]
        found = [(item, known, doc, -score) for item, rows in best.items() for score, known, doc in sorted(rows)[:k]]
        yield _rows(found, ["item", "known", "doc", "score"], [pa.int32(), pa.int32(), pa.int64(), pa.int64()])

    columns = ["ids", "known", "sizes", "most", "bits", "slices", "texts"]
    return blocks.select(*columns).mapInArrow(run, "item int, known int, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item id, rank, doc id, score): the ``k`` best documents of each item, all with a score above 0 if they are fewer.

    A null or empty text, or one without a term, is no document and finds nothing as an item. Rows are documents and items of
    their own, also when ids or texts repeat; equal scores are ordered by id, a null id first. An empty table gives no rows.
    Ids of documents are whole numbers. Other columns are left out, so their names cannot clash. Terms are equal when
    64 bits of hashes agree. Items are searched in groups of ``QUERY_BYTES``, one after the other, over the same index.
    """
    spark = docs.sparkSession
    blocks = index(docs, id_col, text_col)
    total = blocks.agg(F.sum(F.octet_length("sizes") / 8).cast("long").alias("docs"), F.sum("terms").alias("words")).first()
    kind = items.schema[item_col].dataType.simpleString()
    names = f"item int, {item_col} {kind}"
    asked = items.select(F.col(item_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    groups = -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // QUERY_BYTES)
    out = None
    for group in range(groups if total["docs"] else 0):
        own = asked.where(F.pmod(F.xxhash64("id", "text"), F.lit(groups)) == group).collect()
        queries = _read_queries([r["text"] for r in own])
        if not len(queries.terms):
            continue
        queries.docs, queries.words = total["docs"], total["words"]
        _weigh(blocks, queries)
        least = _least_scores(blocks, queries, _likely(blocks, queries, k).collect(), k)
        best = _best(blocks, queries, least, k)
        doc = F.when(F.col("known") == 1, F.col("doc"))
        order = Window.partitionBy("item").orderBy(F.desc("score"), "known", "doc")
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        labels = F.broadcast(spark.createDataFrame([(i, r["id"]) for i, r in enumerate(own)], names))
        found = ranked.join(labels, "item").select(item_col, "rank", doc.alias(id_col), "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"{item_col} {kind}, rank int, {id_col} long, score long")
