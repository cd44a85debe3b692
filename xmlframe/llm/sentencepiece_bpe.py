"""SentencePiece BPE encoding and decoding with a prefix table.

For each prefix of a chunk the table holds the one last token that the prefix's encoding can have. A
token that an automaton finds at the end of a prefix is that token if the chunk starts with it or if it
is compatible with the last token of the prefix before it; two tokens are compatible if encoding their
concatenation by merges gives the two back. The ids are read from the table backwards.

Chunks are runs of the space mark with what follows them, and single line feeds. No piece of a supported
model goes on past such a border (checked when a model is loaded), so the chunks of a text are encoded
on their own, and a worker keeps the results of the latest ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, strings

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
#: Chunks and pairs that a worker remembers.
CHUNKS_KEPT, PAIRS_KEPT, LONGEST_KEPT = 100_000, 500_000, 64


def chunks(text: str) -> list[str]:
    """The chunks of a text as the model sees it: with the mark for spaces and before the first word."""
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


class PrefixTable:
    """Encoder and decoder for one BPE model file with byte fallback and no text normalization."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        special = [m.is_unknown(i) or m.is_control(i) or m.is_unused(i) for i in range(len(self.pieces))]
        self.byte_of = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if m.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i] and i not in self.byte_of}
        self.score = [m.get_score(i) for i in range(len(self.pieces))]
        self.end, self.unknown = m.eos_id(), m.unk_id()
        self.silent = {i for i in range(len(self.pieces)) if m.is_control(i)}
        if len(self.id_of_byte) != 256 or any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in self.ids) or m.encode("ﬁ  x ") != m.encode("ﬁ  x ") or any(len(c) == 1 and c not in self.ids for p in self.ids for c in p):
            raise ValueError(f"{path}: needs byte fallback, no normalization, pieces that end before a space mark or line feed, and a piece for each of their characters")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.merge(p) == [p]:  # else no text's encoding has it
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.text = [None if i in self.byte_of else " ⁇ " if i == self.unknown else "" if i in self.silent else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        #: Chunks, to their ids as text and what these decode to, if that is not the chunk itself.
        self.known: dict[str, tuple[str, str | None]] = {}
        self.older: dict[str, tuple[str, str | None]] = {}

    def merge(self, text: str) -> list[str]:
        """The encoding of a short text by its definition: the best adjacent pair, leftmost first, is merged."""
        parts, get = list(text), self.ids.get
        found = [get(x + y) for x, y in zip(parts, parts[1:], strict=False)]
        while found:
            best, at = None, -1
            for k, i in enumerate(found):
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = get(parts[at - 1] + parts[at])
            if at < len(found):
                found[at] = get(parts[at] + parts[at + 1])
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether the two tokens stay apart when their concatenation is encoded."""
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        x, y = self.pieces[a], self.pieces[b]
        got = self.pairs[a << 20 | b] = self.merge(x + y) == [x, y]
        return got

    def encode_chunk(self, chunk: str) -> list[int]:
        """The ids of one chunk. A character that no piece has is a token of its own, -1 in the table."""
        size = len(chunk) + 1
        last, back = [-1] * size, list(range(-1, size - 1))
        done, known = 0, self.pairs.get
        for end, (i, n) in self.automaton.iter(chunk):
            if end == done - 1:
                continue
            before = end + 1 - n
            if before:
                prior = last[before]
                if prior >= 0:
                    ok = known(prior << 20 | i)
                    if not ok and (ok is False or not self.compatible(prior, i)):
                        continue
            done = end + 1
            last[done], back[done] = i, before
        out, at = [], size - 1
        while at > 0:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out.extend([self.id_of_byte[b] for b in reversed(chunk[at - 1].encode("utf-8", "replace"))])
            at = back[at]
        return out[::-1]

    def decode_pieces(self, ids: list[int]) -> str:
        """The text of ids, the mark of the first word included. Bytes that are not UTF-8 give U+FFFD each."""
        texts = [self.text[i] for i in ids]
        if None not in texts:
            return "".join(texts)
        out, k = [], 0
        while k < len(ids):
            start = k
            while k < len(ids) and texts[k] is None:
                k += 1
            out.append(utf8(bytes([self.byte_of[i] for i in ids[start:k]])) if k > start else texts[k])
            k += k == start
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.decode_pieces(ids)
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and self.pieces[first].startswith(MARK) else text

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text and the end id."""
        return [i for c in chunks(text) for i in self.encode_chunk(c)] + [self.end]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the text decoded from them. Chunks are encoded and
        decoded one by one, as the bytes of a character never lie in two of them."""
        parts = chunks(text)
        if len(self.known) >= CHUNKS_KEPT:  # the last two generations of results are kept
            self.older, self.known = self.known, {}
        known, back = self.known, {}
        for c in set(parts):
            if c not in known:
                if (found := self.older.get(c)) is None:
                    ids = self.encode_chunk(c)
                    decoded = self.decode_pieces(ids)
                    found = " ".join(map(str, ids)), decoded if decoded != c.replace(MARK, " ") else None
                known[c] = found
            if known[c][1] is not None:
                back[c] = known[c][1]
        joined = " ".join([*[known[c][0] for c in parts], str(self.end)])
        decoded = "".join([back.get(c, c) for c in parts] if back else parts).replace(MARK, " ")[1:]
        for c in [c for c in set(parts) if len(c) > LONGEST_KEPT]:
            del known[c]
        return joined.count(" ") + 1, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest()


def utf8(data: bytes) -> str:
    """Bytes as text; each byte that starts no valid sequence gives one U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[k : k + n].decode())
                    k += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        return "".join(out)


_tables: dict[str, PrefixTable] = {}


def table(path: str) -> PrefixTable:
    """The worker's table of a model file, which must be at the same path on all machines."""
    if path not in _tables:
        _tables[path] = PrefixTable(path)
    return _tables[path]


def encode_ids(docs: DataFrame, model: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of each whole text, the end id last, as array<int>. Null text counts as empty. A column of
    docs with the name of the new one gives way."""
    docs = docs.drop(out)
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            ids = [table(model).encode(t or "") for t in strings(part.column(names.index(text)))]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(work, f"{schema}, `{out}` array<int>")


def decode_ids(encoded: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text that the ids decode to. Null ids give null. A column with the name of the new one gives way."""
    encoded = encoded.drop(out)
    names = encoded.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, ids):
            texts = [None if x is None else table(model).decode(x) for x in part.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(work, f"{schema}, `{out}` string")


def encode_digests(docs: DataFrame, model: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, in one map step without a
    shuffle; the ids never leave the worker. Null text counts as empty: the end id alone. Columns of docs named in
    `keep` stand behind these."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *keep]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [table(model).digest(t or "") for t in strings(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))), *part.columns[2:]], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("doc_id", F.col("text").alias("text"), *keep).mapInArrow(work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{kept}")
