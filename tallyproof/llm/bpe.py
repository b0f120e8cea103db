"""Encoding and decoding with a public BPE vocabulary by a table of distinct words.

A word is a run of bytes without ASCII white space, without an end of punctuation behind a Latin
letter or digit, which is the next word. The vocabulary's splitting pattern never matches white
space nor such a border, its normaliser (NFC, lower case) never joins characters across them, and
its special tokens hold none, so a text's ids are those of its words in order.

1. Texts are split in tasks and gathered into blocks of some BLOCK_BYTES. A block gives one
   row of its documents, each word as a number of the block's own (frequent words first,
   compressed), and one row for each of its distinct words.
2. The distinct-word table: rows meet by word, and each distinct word of the corpus is encoded
   once. However often a word occurs, it has one row a block, so no key is hot.
3. The ids go back to the blocks by (block, number) and are put in every position of the word.

decode() joins ids to their pieces; the vocabulary has a fixed size, so it is sent to every task.

ids are packed as token files hold them: little-endian unsigned 32-bit integers. Null and empty
texts have none, and decode to the empty text, as do texts of white space. Bytes that aren't
UTF-8 count as U+FFFD. Rows are coded one by one, whatever ids repeat or are null; a word of any
length is one word. An empty table gives no rows. Other columns are not read.

docs is read twice and must give the same rows in the same order each time, as tables of files
do; if it doesn't, the run fails with a message.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .groups import bounds_of, runs

#: Bytes of text in a block (a longer document is a block of its own), and that are split at once.
BLOCK_BYTES = 64 << 20
PIECE_BYTES = 4 << 20
#: Words that are put together at once when documents are assembled.
SLICE = 1 << 20
#: Vocabularies up to this size are sent to every task.
VOCABULARY = 1 << 22

_CODED = "block bigint, code int, word string, documents binary"
_loaded: dict[int, Tokenizer] = {}


def _tokenizer(spec: str) -> Tokenizer:
    """The tokenizer of a specification's text, made once a worker."""
    key = zlib.crc32(spec.encode())
    if key not in _loaded:
        t = Tokenizer.from_str(spec)
        t.no_padding()
        t.no_truncation()
        _loaded[key] = t
    return _loaded[key]


def _id_size(tokenizer: Tokenizer) -> int:
    return 2 if max(tokenizer.get_vocab(True).values(), default=0) < 1 << 16 else 4


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


#: An end of punctuation that is a word of its own: the pattern never joins it with a letter or digit before it.
_END = r"^(?s)(?P<stem>.*[A-Za-z0-9À-ÖØ-öø-ÿ])(?P<end>[.,;:!?]+)$"


def _finer(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Distinct words -> number of what stays of each, number of its end or -1, and the distinct ones among them.

    Ends of punctuation are split off and ASCII words become lower case (as the normaliser makes
    them), so there are fewer words. Special tokens, which tell cases apart, stay as they are.
    """
    split = pc.extract_regex(words, _END)
    stem, end = pc.coalesce(pc.struct_field(split, 0), words), pc.struct_field(split, 1)
    lower = pc.and_(pc.string_is_ascii(stem), pc.invert(pc.match_substring(stem, "<|")))
    stem = pc.if_else(lower, pc.ascii_lower(stem), stem)
    coded = pa.concat_arrays([stem, end.drop_null()]).dictionary_encode()
    code = coded.indices.to_numpy()
    ends = np.full(len(words), -1, np.int32)
    ends[np.flatnonzero(end.is_valid().to_numpy(zero_copy_only=False))] = code[len(words) :]
    return code[: len(words)], ends, coded.dictionary


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Number of words of each text, and all words in order."""
    raw = pa.StringArray.from_buffers(len(texts), *texts.buffers()[1:], texts.buffers()[0], -1, texts.offset)
    lists = pc.ascii_split_whitespace(pc.fill_null(raw, ""))
    flat = lists.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0)  # the splitter gives empty words at the ends
    at = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    offs = lists.offsets.to_numpy()
    coded = flat.filter(full).dictionary_encode()
    stems, ends, words = _finer(coded.dictionary)
    codes = coded.indices.to_numpy()
    place = np.concatenate([[0], np.cumsum(1 + (ends >= 0)[codes])])
    out = np.empty(place[-1], np.int32)
    out[place[:-1]] = stems[codes]
    two = np.flatnonzero(ends[codes] >= 0)
    out[place[two] + 1] = ends[codes[two]]
    return np.diff(place[at[offs - offs[0]]]).astype(np.int32), pa.DictionaryArray.from_arrays(pa.array(out), words)


def _blocks(batches) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray, pa.Array]]:
    """(doc_ids, words of each document, all words as numbers, distinct words by number, frequent ones first) of some BLOCK_BYTES of texts."""

    def block():
        one = pa.chunked_array(words).unify_dictionaries()
        code, known = np.concatenate([c.indices.to_numpy() for c in one.chunks]), one.chunk(0).dictionary
        order = np.argsort(-np.bincount(code, minlength=len(known)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        return ids, np.concatenate(sizes), rank[code], known.take(pa.array(order))

    ids, sizes, words, held = [], [], [], 0
    for b in batches:
        text = b.column(1).cast(pa.binary())
        bytes_to = np.concatenate([[0], np.cumsum(np.nan_to_num(pc.binary_length(text).to_numpy(zero_copy_only=False)).astype(np.int64))])
        a = 0
        while a < len(text):
            e = min(max(int(np.searchsorted(bytes_to, bytes_to[a] + min(PIECE_BYTES, BLOCK_BYTES - held), "left")), a + 1), len(text))
            n, found = _words(text.slice(a, e - a))
            ids += b.column(0).slice(a, e - a).to_pylist()
            sizes.append(n)
            words.append(found)
            held += int(bytes_to[e] - bytes_to[a])
            if held >= BLOCK_BYTES:
                yield block()
                ids, sizes, words, held = [], [], [], 0
            a = e
    if ids:
        yield block()


def _squeeze(codes: np.ndarray) -> bytes:
    """uint32 numbers by byte planes, compressed."""
    return pa.compress(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unsqueeze(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def split_words(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of blocks: with code -1 a block's documents, with others its distinct words."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        schema = pa.schema([("block", pa.int64()), ("code", pa.int32()), ("word", pa.string()), ("documents", pa.binary())])
        for ids, sizes, codes, words in _blocks(batches):
            documents = pickle.dumps((ids, sizes, _squeeze(codes)))
            # The number of the block, and 16 bits that tell whether another reading gave the same block.
            block = (((part << 20) + n) << 16) + (zlib.crc32(documents, zlib.crc32(words.buffers()[2] or b"")) & 0xFFFF)
            n += 1
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((block, -1, None, documents), schema.types)], schema=schema)
            for a in range(0, len(words), 10_000):
                some = words.slice(a, 10_000)
                m = len(some)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), pa.array(np.arange(a, a + m, dtype=np.int32)), some, pa.nulls(m, pa.binary())], schema=schema)

    return docs.select(F.col(id).cast("bigint"), text).mapInArrow(run, _CODED)


def encode_words(words: DataFrame, spec: str, word: str = "word") -> DataFrame:
    """The distinct-word table: rows (word, ...) -> one row for each word, with `places` (the other columns of its rows) and packed `ids`
    (two bytes each where the vocabulary allows it, else four)."""
    spec_sent = words.sparkSession.sparkContext.broadcast(spec)

    def encoded(column: pa.Array) -> pa.Array:
        # A word that isn't UTF-8 comes with replacement characters.
        t = [w.decode("utf-8", "replace") for w in column.cast(pa.binary()).to_pylist()]
        tokenizer = _tokenizer(spec_sent.value)
        kind = f"<u{_id_size(tokenizer)}"
        return pa.array([np.array(e.ids, kind).tobytes() for e in tokenizer.encode_batch_fast(t, add_special_tokens=False)], pa.binary())

    others = [c for c in words.columns if c != word]
    table = words.repartition(word).groupBy(word).agg(F.collect_list(F.struct(*others)).alias("places"))
    return table.withColumn("ids", F.arrow_udf(encoded, "binary")(word))


def _pieces(spec: str) -> list[str | None]:
    """The pieces by id, None where there is none."""
    tokenizer = _tokenizer(spec)
    if tokenizer.decoder is not None:
        raise ValueError("this vocabulary has a decoder of its own")
    known = tokenizer.get_vocab(True)
    if max(known.values(), default=0) >= VOCABULARY:
        raise ValueError(f"ids beyond {VOCABULARY} can't be sent to every task")
    by_id: list[str | None] = [None] * (max(known.values(), default=-1) + 1)
    for piece, i in known.items():
        by_id[i] = piece
    return by_id


def _joined(ids: np.ndarray, offs: np.ndarray, pieces: pa.Array) -> pa.Array:
    """Each row's ids joined to their pieces, these in one text; ids without a piece are left out."""
    known = ids < len(pieces)
    if pieces.null_count:
        known &= np.append(pieces.is_valid().to_numpy(zero_copy_only=False), False)[np.minimum(ids, len(pieces))]
    if not known.all():
        offs, ids = np.concatenate([[0], np.cumsum(known)])[offs], ids[known]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pieces.take(pa.array(ids))), " ")


def _assembled(documents: list[tuple[int | None, int]], codes: np.ndarray, ids: pa.Array, size: int, pieces: pa.Array | None) -> Iterator[pa.RecordBatch]:
    """The packed ids of each document of a block, and with pieces its decoded text; ids: those of each of its words by number."""
    n_ids = pc.binary_length(ids).to_numpy().astype(np.int64) // size
    lo, hi = np.frombuffer(ids.buffers()[1], np.int32)[[ids.offset, ids.offset + len(ids)]] if len(ids) else (0, 0)
    flat = np.frombuffer(ids.buffers()[2] or b"", f"<u{size}", (hi - lo) // size, lo) if hi > lo else np.zeros(0, "<u4")
    first = np.concatenate([[0], np.cumsum(n_ids)])[:-1]
    bounds = np.concatenate([[0], np.cumsum([n for _, n in documents])])
    a = 0
    while a < len(documents):
        e = min(max(int(np.searchsorted(bounds, bounds[a] + SLICE, "right")) - 1, a + 1), len(documents))
        c = codes[bounds[a] : bounds[e]]
        n = n_ids[c]
        ends = np.cumsum(n)
        found = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[c] - (ends - n), n)].astype("<u4")
        offs = np.concatenate([[0], ends])[bounds[a : e + 1] - bounds[a]]
        packed = pa.BinaryArray.from_buffers(pa.binary(), e - a, [None, pa.py_buffer((4 * offs).astype(np.int32).tobytes()), pa.py_buffer(found.tobytes())])
        columns = [pa.array([i for i, _ in documents[a:e]], pa.int64()), packed] + ([] if pieces is None else [_joined(found, offs, pieces)])
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])
        a = e


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, ids (packed) of every whole text; path: the tokenizer's file on the driver.

    decoded: with the text that decode() gives, made where the ids are.
    """
    spec = _read(path)
    sent = docs.sparkSession.sparkContext.broadcast(_pieces(spec)) if decoded else None
    size = _id_size(_tokenizer(spec))
    coded = split_words(docs, id, text)
    places = encode_words(coded.where("code >= 0").select("word", "block", "code"), spec).select(F.explode("places").alias("p"), "ids").select("p.*", "ids")
    rows = coded.where("code < 0").select("block", "code", F.col("documents").alias("ids")).unionByName(places)

    def run(batches):
        pieces = None if sent is None else pa.array(sent.value, pa.string())
        for t in runs(batches, "block"):
            bounds = bounds_of(t["block"].to_numpy())
            for s, e in zip(bounds[:-1], bounds[1:]):
                n, ids = e - s - 1, t["ids"].slice(s + 1, e - s - 1)
                doc_ids, sizes, packed = pickle.loads(t["ids"][s].as_py()) if t["code"][s].as_py() < 0 else (None, None, None)
                codes = _unsqueeze(packed, int(sizes.sum())) if packed else None
                if codes is None or n != (int(codes.max()) + 1 if len(codes) else 0):
                    raise ValueError("docs gave other rows when it was read again; write it to a table first")
                yield from _assembled(list(zip(doc_ids, sizes)), codes, pa.concat_arrays(ids.chunks) if n else pa.array([], pa.binary()), size, pieces)

    dealt = rows.repartition("block").sortWithinPartitions("block", "code")
    return dealt.mapInArrow(run, "doc_id bigint, ids binary" + (", decoded string" if decoded else ""))


def decode(coded: DataFrame, path: str) -> DataFrame:
    """coded (doc_id, ids, ...) with `decoded`: the pieces of the ids, special ones too, joined by spaces.

    Holds for vocabularies without a decoder of their own. An id outside the vocabulary has no
    piece and is left out, as the library does.
    """
    sent = coded.sparkSession.sparkContext.broadcast(_pieces(_read(path)))

    def joined(column: pa.Array) -> pa.Array:
        packed = pc.fill_null(column, b"")
        offs = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1] if len(packed) else np.zeros(1, np.int32)
        ids = np.frombuffer((packed.buffers()[2] or b"")[offs[0] : offs[-1]] if offs[-1] > offs[0] else b"", "<u4")
        return _joined(ids, (offs - offs[0]) // 4, pa.array(sent.value, pa.string()))

    return coded.withColumn("decoded", F.arrow_udf(joined, "string")("ids"))
