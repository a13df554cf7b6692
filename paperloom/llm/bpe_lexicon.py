"""BPE encoding and decoding with a lexicon of the corpus's frequent words.

One pass over all texts counts words; a word reaches the driver only if its share of some block of
text is at least `share` (what blocks hold in which its share is smaller is not added), so the words
of the corpus's largest shares are found, and at most 1/share of a task are. They are compiled with their ids into a minimal acyclic automaton that workers
memory-map from the shared folder. A second pass encodes: words of the automaton by walking it,
all others by exact merges. Which words it holds changes the speed and never a result.

Defined results: null text is empty and has no ids; repeated rows each have a result; very long
texts are encoded whole; extra columns are ignored; empty input gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import bpe, lexicon, shared, words

SHARE = 1 / 65536


def frequent_words(docs: DataFrame, vocabulary: str, text_col: str = "text", share: float = SHARE) -> list[bytes]:
    """Every word that makes up `share` of the pieces of all texts (and some just below), sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special, found, total = bpe.vocabulary(vocabulary).special, {}, 0
        for batch in batches:
            for block in words.blocks(batch, "text"):
                p = bpe.Pieces(block.column(0), special)
                total += len(p.inverse)
                for i in np.flatnonzero(p.counts >= share * len(p.inverse)):
                    piece = p.data[p.starts[p.first[i]] : p.ends[p.first[i]]].tobytes()
                    found[piece] = found.get(piece, 0) + int(p.counts[i])
        kept = [(k, v) for k, v in found.items() if v >= share * total and k not in special]
        if kept:
            pieces, counts = zip(*kept, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary()), pa.array(counts, pa.int64())], ["piece", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "piece binary, n long")
    ranked = counted.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(int(1 / share))
    return sorted(bytes(row.piece) for row in ranked.collect())


def build(docs: DataFrame, vocabulary: str, text_col: str = "text", share: float = SHARE) -> str:
    """Compile the lexicon of a corpus into the shared folder; its URI."""
    found = frequent_words(docs, vocabulary, text_col, share)
    ends = np.cumsum([len(w) for w in found]) if found else np.empty(0, np.int64)
    starts = ends - np.array([len(w) for w in found], np.int64)
    flat, offsets = bpe.vocabulary(vocabulary).merge(np.frombuffer(b"".join(found), np.uint8), starts, ends)
    uri = shared.folder(docs.sparkSession, "lexicon")
    lexicon.save(uri, lexicon.compiled(found) | {"flat": flat, "offsets": offsets})
    return uri


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lexicon_uri: str | None = None) -> DataFrame:
    """id and ids (array of int) of every row."""
    return _mapped(docs, vocabulary, id_col, text_col, lexicon_uri, _lists, "ids array<int>")


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lexicon_uri: str | None = None) -> DataFrame:
    """id, n_tokens, sha256 of the ids joined by commas, sha256 of the text decoded from the ids."""
    return _mapped(docs, vocabulary, id_col, text_col, lexicon_uri, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(rows: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of every row of ids; bytes that are no UTF-8 become the replacement sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bpe.vocabulary(vocabulary).bytes
        for batch in batches:
            texts = [text_of(np.array(x or [], np.int64), table) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    chosen = rows.select(id_col, ids_col)
    return chosen.mapInArrow(run, f"`{id_col}` {chosen.schema[id_col].dataType.simpleString()}, text string")


def text_of(ids: np.ndarray, table: np.ndarray) -> str:
    return b"".join(table[ids].tolist()).decode("utf-8", "replace")


def _mapped(docs, vocabulary, id_col, text_col, lexicon_uri, make, schema) -> DataFrame:
    chosen = docs.select(F.col(id_col), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe.vocabulary(vocabulary)
        encoder = bpe.Encoder(vocab, lexicon.load(lexicon_uri) if lexicon_uri else None)
        for batch in batches:
            for block in words.blocks(batch, "text"):
                arrays = make(encoder, vocab, block.column(1))
                yield pa.RecordBatch.from_arrays([block.column(0), *arrays.values()], [id_col, *arrays])

    return chosen.mapInArrow(run, f"`{id_col}` {chosen.schema[id_col].dataType.simpleString()}, {schema}")


def _lists(encoder, vocab, column) -> dict[str, pa.Array]:
    ids, offsets = encoder.rows(column)
    return {"ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))}


def _digests(encoder, vocab, column) -> dict[str, pa.Array]:
    ids, offsets = encoder.rows(column)
    table, numbers, out = vocab.bytes, _numbers(len(vocab.bytes)), []
    for start, end in zip(offsets[:-1], offsets[1:], strict=True):
        own = ids[start:end]
        joined = hashlib.sha256(b",".join(numbers[own].tolist())).hexdigest()
        out.append((end - start, joined, hashlib.sha256(text_of(own, table).encode()).hexdigest()))
    count, first, second = zip(*out, strict=True) if out else ((), (), ())
    return {"n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(first, pa.string()), "decoded_sha256": pa.array(second, pa.string())}


def _numbers(n: int, kept: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    if n not in kept:
        kept[n] = np.array([str(i).encode() for i in range(n)], object)
    return kept[n]
