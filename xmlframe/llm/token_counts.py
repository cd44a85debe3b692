"""Token counts without token ids: each distinct pre-token is counted once by the library, documents
only bring their pre-token frequencies, and a join and a sum do the rest.

Pre-tokens are the chunks of `sentencepiece_bpe`: no piece goes past a chunk's border, so the pieces of
a text are those of its chunks. The commonest HEAVY chunks are looked up in a broadcast table of that
bounded size while a document's frequencies are taken; only its rare chunks are shuffled to their counts,
and no rare chunk is a hot key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, strings
from .sentencepiece_bpe import MARK, chunks

#: Chunks in the broadcast table; distinct chunks that a task holds before it passes them on.
HEAVY, HELD = 100_000, 400_000


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(chunk, freq): the distinct chunks of all texts with their number of occurrences."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for part in slices(batches, text):
            for t in strings(part.column(0)):
                total.update(chunks(t or ""))
            if len(total) >= HELD:
                yield _pairs(total)
                total.clear()
        yield _pairs(total)

    return docs.select(text).mapInArrow(work, "chunk string, freq long").groupBy("chunk").agg(F.sum("freq").alias("freq"))


def _pairs(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["chunk", "freq"])


_models: dict = {}


def _model(path: str):
    """The worker's model; PrefixTable checks that chunks may be counted on their own."""
    if path not in _models:
        import sentencepiece

        from .sentencepiece_bpe import table

        table(path)
        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def count_pieces(vocab: DataFrame, model: str) -> DataFrame:
    """Add n, the number of pieces of each chunk as the library counts them. The library puts a space mark
    before a text; a chunk that begins otherwise is counted behind a line feed, which is two pieces then."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model)
        lead = len(m.encode("\n", num_threads=1))
        for part in slices(batches, "chunk", rows=20_000):
            found = part.column(0).to_pylist()
            n = [len(x) for x in m.encode([c[1:].replace(MARK, " ") if c[0] == MARK and len(c) > 1 else "\n" + c for c in found], num_threads=1)]
            n = [k if c[0] == MARK and len(c) > 1 else k - lead for k, c in zip(n, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64())], ["chunk", "freq", "n"])

    return vocab.mapInArrow(work, "chunk string, freq long, n long")


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row's whole text; null counts as empty, which has
    0 tokens. Rows with equal ids stay rows of their own."""
    vocab = materialize(count_pieces(vocabulary(docs), model), "token-vocabulary")
    top = vocab.orderBy(F.desc("freq"), "chunk").limit(HEAVY)
    heavy = docs.sparkSession.sparkContext.broadcast({r["chunk"]: r["n"] for r in top.toLocalIterator()})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = heavy.value
        for part in slices(batches, "text"):
            size, sure, rare, times = [], [], [], []
            for t in strings(part.column(1)):
                freq = Counter(chunks(t or ""))
                size.append(len((t or "").encode("utf-8", "replace")))
                left = [c for c in freq if c not in known]
                sure.append(sum([n * known[c] for c, n in freq.items() if c in known]))
                rare.append(left)
                times.append([freq[c] for c in left])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(sure, pa.int64()), pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))], ["doc_id", "n_bytes", "sure", "rare", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    freqs = docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_bytes long, sure long, rare array<string>, times array<int>")
    freqs = materialize(freqs.withColumn("row", F.monotonically_increasing_id()), "token-frequencies")
    rare = freqs.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("chunk"), F.col("x.times").alias("times"))
    summed = rare.join(vocab.select("chunk", "n"), "chunk").groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("more"))
    out = freqs.select("row", "doc_id", "n_bytes", "sure").join(summed, "row", "left").withColumn("n_tokens", F.col("sure") + F.coalesce("more", F.lit(0)))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
