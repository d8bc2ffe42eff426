"""A stored inverted index with positions: written once, extended by appending, read by lexeme.

Documents are numbered in the order of their files; BLOCK consecutive numbers are a block. A row of ``postings`` holds one lexeme's
documents of one block as arrays: their places in the block, occurrences and positions, with the block's largest number of
occurrences. The rows are dealt by ranges of (lexeme, block), so that files and their row groups hold few lexemes each and a filter
on lexemes reads only theirs; Parquet's second format stores the ascending numbers as packed differences. A lexeme of a third of
all documents is many rows, and no row grows beyond its block. Lists are made where documents are read; only a block whose
tokens exceed HELD bytes has several rows for a lexeme.

Tables under a path: ``documents`` (ordinal, id, n_tokens) and ``postings`` (lexeme, block, n, most, places, counts, positions).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fulltext
from ..plans.lineage import discard, stored
from ..plans.sizes import bounded_bytes

#: Documents of a block: a power of two.
BITS = 10
#: Bytes of tokens that a task holds of an incomplete block.
HELD = 64 << 20
#: An occurrence counts so much.
WEIGHT = fulltext.UNIFORM_WEIGHT


def write(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", first: int = 0, lexemes: Callable[[Column], Column] | None = None) -> None:
    """Append ``docs`` (key, text) to the index under ``path``, numbered from ``first`` on. Null texts have no lexemes; repeated keys are
    documents of their own. ``lexemes`` may map arrays of tokens to what is indexed in their places; nulls are left out."""
    ordinal = F.monotonically_increasing_id() + F.lit(first)
    ts = fulltext.tokens(F.col(text))
    cut = stored(_lists(docs.select(ordinal.alias("ordinal"), F.col(key).alias("id"), (lexemes(ts) if lexemes else ts).alias("ts"))), "lists")
    cut.where("docs IS NOT NULL").select(F.inline("docs")).write.mode("append").parquet(f"{path}/documents")
    rows = cut.where("lexeme IS NOT NULL").select("lexeme", "block", "n", "most", "places", "counts", "positions")
    sorted_ = rows.repartitionByRange("lexeme", "block").sortWithinPartitions("lexeme", F.col("most").desc(), "block")
    sorted_.write.mode("append").options(**{"parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(8 << 20), "compression": "zstd"}).parquet(f"{path}/postings")
    discard(cut)


def add(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", lexemes: Callable[[Column], Column] | None = None) -> None:
    """Append new documents, in blocks of their own; what is stored stays as it is."""
    last = docs.sparkSession.read.parquet(f"{path}/documents").agg(F.max("ordinal")).first()[0]
    write(docs, path, key, text, 0 if last is None else ((last >> BITS) + 1) << BITS, lexemes)


def _postings_of(docs: pa.Table, block_bits: int) -> tuple[list[str], list[pa.Array]]:
    """The columns of ``postings`` for (ordinal, id, ts), ascending ordinals."""
    ordinal, ts = docs["ordinal"].to_numpy(), docs["ts"].combine_chunks()
    size = pc.fill_null(pc.list_value_length(ts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    token = ts.flatten().dictionary_encode()
    known = pc.is_valid(token.indices).to_numpy(zero_copy_only=False)
    code = pc.fill_null(token.indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)[known]
    doc = np.repeat(np.arange(len(size)), size)[known]
    pos = (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + 1)[known].astype(np.int32)
    lists = ((ordinal >> block_bits) - (ordinal[:1] >> block_bits))[doc] * max(1, len(token.dictionary)) + code
    bits = len(doc).bit_length()
    placed = np.sort(lists << bits | np.arange(len(doc)))  # by list; documents and positions ascend in it
    order, lists = placed & ((1 << bits) - 1), placed >> bits
    doc = doc[order]
    new_list = np.append(True, lists[1:] != lists[:-1])[: len(doc)]
    new_doc = new_list | np.append(True, doc[1:] != doc[:-1])[: len(doc)]
    at, heads = np.flatnonzero(new_doc), np.flatnonzero(new_list)
    counts = np.diff(np.append(at, len(doc))).astype(np.int32)
    first = np.flatnonzero(new_list[at])
    ends = pa.array(np.append(first, len(at)), pa.int32())
    most = np.maximum.reduceat(counts, first) if len(first) else counts
    positions = pa.ListArray.from_arrays(pa.array(np.append(at, len(doc)), pa.int32()), pa.array(pos[order]))
    places = pa.array((ordinal[doc[at]] & ((1 << block_bits) - 1)).astype(np.int32))
    return ["lexeme", "block", "n", "most", "places", "counts", "positions"], [
        token.dictionary.take(pa.array(code[order][heads])), pa.array(ordinal[doc[heads]] >> block_bits), pa.array(np.diff(np.append(first, len(at))).astype(np.int32)), pa.array(most),
        *(pa.ListArray.from_arrays(ends, x) for x in (places, pa.array(counts), positions)),
    ]


def _lists(docs: DataFrame) -> DataFrame:
    """Rows of two kinds from (ordinal, id, ts), ascending ordinals in a partition: those of ``postings``; and, beside nulls, arrays of
    documents (ordinal, id, n_tokens). A token is no row of its own.

    A task holds the rows of a block until it is complete; one of more than HELD bytes has several rows for a lexeme.
    """
    block_bits, most = BITS, HELD

    def rows(docs: pa.Table) -> Iterator[pa.RecordBatch]:
        size = pc.fill_null(pc.list_value_length(docs["ts"].combine_chunks()), 0)
        own = pa.StructArray.from_arrays([docs["ordinal"].combine_chunks(), docs["id"].combine_chunks(), size.cast(pa.int32())], names=["ordinal", "id", "n_tokens"])
        every = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
        names, cols = _postings_of(docs, block_bits)
        for k in range(0, len(cols[0]), 10_000):
            some = [c.slice(k, 10_000) for c in cols]
            yield pa.RecordBatch.from_arrays([*some, pa.nulls(len(some[0]), every.type)], names=[*names, "docs"])
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, c.type) for c in cols), every], names=[*names, "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            one = pa.Table.from_batches([batch])
            held = one if held is None else pa.concat_tables([held, one])
            block = held["ordinal"].to_numpy() >> block_bits
            done = len(held) if held.nbytes > most else int(np.searchsorted(block, block[-1]))
            if done:
                yield from rows(held.slice(0, done))
                held = held.slice(done) if done < len(held) else None
        if held is not None:
            yield from rows(held)

    bounded_bytes(docs.sparkSession)
    kind = docs.schema["id"].dataType.simpleString()
    postings = "lexeme string, block long, n int, most int, places array<int>, counts array<int>, positions array<array<int>>"
    return docs.mapInArrow(run, f"{postings}, docs array<struct<ordinal: bigint, id: {kind}, n_tokens: int>>")


@dataclass(frozen=True)
class Index:
    documents: DataFrame
    postings: DataFrame

    def of(self, lexemes: list[str]) -> DataFrame:
        """The rows of some lexemes: the filter reaches the scan."""
        return self.postings.where(F.col("lexeme").isin(*sorted(set(lexemes))))


def read(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/postings"))


def _ordinal(place: str = "place") -> Column:
    return F.shiftleft("block", BITS) + F.col(place)


def top_by_term(index: Index, words: dict[int, str], k: int) -> DataFrame:
    """(qid, id, score, rank): the k documents in which a question's word occurs most often; ties go to the least id.

    A block's largest count is that of some document, so the k-th largest of the blocks is at most the k-th best count: it comes
    from the blocks' maxima alone and goes into the filter of the scan, where a lexeme's rows lie by falling maxima.
    """
    asked = F.broadcast(index.postings.sparkSession.createDataFrame(list(words.items()), "qid long, lexeme string"))
    heads = index.of(list(words.values())).select("lexeme", "most").join(asked, "lexeme")
    reached = F.sum("count").over(Window.partitionBy("qid").orderBy(F.col("most").desc()))
    sizes = heads.groupBy("qid", "most").count().withColumn("blocks", reached)  # as many rows as counts differ
    least = {r.qid: r.least for r in sizes.groupBy("qid").agg(F.coalesce(F.max(F.when(F.col("blocks") >= k, F.col("most"))), F.lit(1)).alias("least")).collect()}  # one row a question
    floors = {words[q]: min(m for p, m in least.items() if words[p] == words[q]) for q in least}
    wanted = [(F.col("lexeme") == w) & (F.col("most") >= m) for w, m in floors.items()]
    live = index.postings.where(reduce(or_, wanted) if wanted else F.lit(False)).join(asked, "lexeme").withColumn("least", F.element_at(F.create_map(*[F.lit(x) for x in sum(least.items(), ())]), F.col("qid")) if least else F.lit(1))
    each = live.select("qid", "least", "block", F.inline(F.arrays_zip("places", "counts"))).where(F.col("counts") >= F.col("least"))
    named = each.select("qid", _ordinal("places").alias("ordinal"), "counts").join(index.documents, "ordinal")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("counts").desc(), F.col("id")))
    return named.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "id", (F.col("counts") * WEIGHT).alias("score"), "rank")


# ---- positional trees ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Phrase:
    """Lexemes at given distances from the first one; a single one is a word. Words that were left out leave their distance."""

    parts: tuple[tuple[int, str], ...]

    def lexemes(self) -> set[str]:
        return {w for _, w in self.parts}

    def holds(self, at: Callable[[str], Column]) -> Column:
        there = reduce(and_, [at(w).isNotNull() for w in sorted(self.lexemes())])
        if len(self.parts) == 1:
            return there
        start, *rest = self.parts
        follows = lambda p: reduce(and_, [F.array_contains(at(w), p + (d - start[0])) for d, w in rest])
        return F.coalesce(there & F.exists(at(start[1]), follows), F.lit(False))

    def may(self, there: Callable[[str], Column]) -> Column:
        return reduce(and_, [there(w) for w in sorted(self.lexemes())])


@dataclass(frozen=True)
class Not:
    part: Tree

    def lexemes(self) -> set[str]:
        return self.part.lexemes()

    def holds(self, at: Callable[[str], Column]) -> Column:
        return ~self.part.holds(at)

    def may(self, there: Callable[[str], Column]) -> Column:
        return F.lit(True)  # a lexeme of the block need not be in each of its documents


@dataclass(frozen=True)
class All:
    parts: tuple[Tree, ...]

    def lexemes(self) -> set[str]:
        return set().union(*(p.lexemes() for p in self.parts))

    def holds(self, at: Callable[[str], Column]) -> Column:
        return reduce(and_, [p.holds(at) for p in self.parts])

    def may(self, there: Callable[[str], Column]) -> Column:
        return reduce(and_, [p.may(there) for p in self.parts])


@dataclass(frozen=True)
class Any(All):
    def holds(self, at: Callable[[str], Column]) -> Column:
        return reduce(or_, [p.holds(at) for p in self.parts])

    def may(self, there: Callable[[str], Column]) -> Column:
        return reduce(or_, [p.may(there) for p in self.parts])


Tree = Phrase | Not | All | Any


def word(w: str) -> Phrase:
    return Phrase(((0, w),))


def phrase(words: str, left_out: frozenset[str] = frozenset(), lexeme: Callable[[str], str] = str) -> Phrase | None:
    """A phrase of words one after the other; those of ``left_out`` leave a gap. None where nothing is left."""
    parts = [(k, lexeme(w)) for k, w in enumerate(words.split()) if w not in left_out]
    return Phrase(tuple((k - parts[0][0], w) for k, w in parts)) if parts else None


def web_tree(query: str, left_out: frozenset[str] = frozenset(), lexeme: Callable[[str], str] = str) -> Tree | None:
    """The tree of a web query: quotes make phrases, ``or`` separates, a leading - negates, bare words are ANDed."""
    groups = []
    for group in fulltext.parse_web_query(query):
        own = [(wanted, phrase(" ".join(words), left_out, lexeme)) for wanted, words in group]
        parts = tuple(p if wanted else Not(p) for wanted, p in own if p is not None)
        if parts:
            groups.append(All(parts))
    return Any(tuple(groups)) if groups else None


def _by_document(index: Index, tree: Tree) -> tuple[DataFrame, Callable[[str], Column]]:
    """(ordinal, one column of positions per lexeme of the tree, null where it does not occur), of blocks that may match."""
    names = {w: f"_{k}" for k, w in enumerate(sorted(tree.lexemes()))}
    at = lambda w: F.col(names[w])
    own = index.of(list(names))
    there = own.select("lexeme", "block").groupBy("block").agg(*[F.max(F.col("lexeme") == w).alias(c) for w, c in names.items()])
    live = there.where(tree.may(at)).select("block")
    each = own.join(live, "block", "left_semi").select("lexeme", "block", F.inline(F.arrays_zip("places", "positions")))
    rows = each.groupBy(_ordinal("places").alias("ordinal")).agg(*[F.first(F.when(F.col("lexeme") == w, F.col("positions")), ignorenulls=True).alias(c) for w, c in names.items()])
    return rows, at


def matching(index: Index, tree: Tree | None) -> DataFrame:
    """(ordinal, id) of the documents that satisfy a tree; none for no tree.

    Only the rows of its lexemes are read, and only in blocks whose lexemes allow a match; a tree that holds for documents
    without any of them, such as a lone negation, goes over the table of documents as well.
    """
    if tree is None:
        return index.documents.where(F.lit(False)).select("ordinal", "id")
    rows, at = _by_document(index, tree)
    absent = index.documents.sparkSession.range(1).select(tree.holds(lambda w: F.lit(None).cast("array<int>")).alias("x")).first().x
    both = index.documents.join(rows, "ordinal", "left" if absent else "inner")
    return both.where(tree.holds(at)).select("ordinal", "id")


def occurrences(index: Index, lexemes: list[str], within: DataFrame | None = None) -> DataFrame:
    """(id, lexeme, pos) of some lexemes, in the documents ``within`` (ordinal) if given: what cover density ranks."""
    each = index.of(lexemes).select("lexeme", "block", F.inline(F.arrays_zip("places", "positions"))).select(_ordinal("places").alias("ordinal"), "lexeme", "positions")
    each = each if within is None else each.join(within.select("ordinal"), "ordinal", "left_semi")
    return each.join(index.documents, "ordinal").select("ordinal", "id", "lexeme", F.explode("positions").alias("pos"))
