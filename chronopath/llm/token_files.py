"""Token-id files: Simple-8b frames with block offsets, written and read as binary rows of Parquet.

Format of a frame (little-endian):

    8 bytes   magic "S8BTOK01"
    5 x u64   ids, documents, blocks, words, ids a block
    docs x i64   document ids (with bit set in the null map for null)
    docs x u64   ids of each document, its end id included
    docs x u8    1 where the document id is null
    (blocks + 1) x u64   first word of each block
    words x u64  Simple-8b words

A word has a selector in its top four bits and 60 bits of equal fields, the first id lowest. Selectors 3-15 take 60
fields of 1 bit down to one of 60, selector 2 two of 30; selector 0 is a run of 240 zeros; selector 1, a shorter run of
zeros elsewhere, is the escape here: the next word is one id as it is (ids of 2^60 and more). Blocks start on a word of their own, so they are coded and decoded side by side.
Frames travel through Spark's own writers, so a lost executor leaves no half file and any store works.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopath.llm.bpe import byte_characters
from chronopath.llm.common import materialize, shuffle_parts, texts

MAGIC, BLOCK, FRAME_IDS, END_ID = b"S8BTOK01", 1024, 1 << 20, 2
U = np.uint64
#: Fixed values of the format: fields and bits a field of each selector (selector 1: escape).
COUNT = np.array([240, 1, 2, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 1], np.int64)
BITS = np.array([0, 64, 30, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 60], np.int64)


def encode_words(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block and of the end) of non-negative ids."""
    v = ids.astype(U)
    n = len(v)
    if not n:
        return np.empty(0, U), np.zeros(1, np.int64)
    blocks = -(-n // block)
    width = np.zeros(n, np.int64)  # bits of each id
    width = np.where(v >> U(32) != 0, 32 + np.frexp((v >> U(32)).astype(np.float64))[1], np.frexp((v & U(0xFFFFFFFF)).astype(np.float64))[1]).astype(np.uint8)
    # Behind a block's end anything fits: a last word may be part filled. Widths are padded block by block.
    pad = np.zeros((blocks, block + 240), np.uint8)
    full = np.zeros(blocks * block, np.uint8)
    full[:n] = width
    pad[:, :block] = full.reshape(blocks, block)
    best = np.full(pad.shape, 1, np.uint8)  # escape unless something fits
    reach, w = {1: pad}, 1
    while w * 2 <= 240:
        m = reach[w].copy()
        m[:, :-w] = np.maximum(m[:, :-w], reach[w][:, w:])
        reach[w * 2], w = m, w * 2
    for s in np.argsort(COUNT, kind="stable").tolist():  # widest fields first, so that fuller words overwrite
        if s == 1:
            continue
        c, k = int(COUNT[s]), 1 << (int(COUNT[s]).bit_length() - 1)
        m = reach[k].copy()
        if c > k:
            m[:, : -(c - k)] = np.maximum(reach[k][:, : -(c - k)], reach[k][:, c - k :])
        best[m <= BITS[s]] = s
    best[:, :block][(pad[:, :block] > 60)] = 1
    size = np.full(blocks, block)
    size[-1] = n - (blocks - 1) * block
    at, rows, starts, owners = np.zeros(blocks, np.int64), np.arange(blocks), [], []
    while len(rows):  # all blocks step from word to word together
        starts.append(rows * block + at[rows])
        owners.append(rows)
        at[rows] += COUNT[best[rows, at[rows]]]
        rows = rows[at[rows] < size[rows]]
    start = np.concatenate(starts)
    start.sort()
    own, off = start // block, start % block
    sel = best[own, off]
    place = np.arange(len(start)) + np.r_[0, np.cumsum(sel == 1)[:-1]]
    words = np.zeros(len(start) + int((sel == 1).sum()), U)
    padded = np.zeros(blocks * block + 240, U)
    padded[:n] = v
    for s in np.unique(sel):
        k = np.flatnonzero(sel == s)
        word = np.full(len(k), int(s) << 60, U)
        if s == 1:
            words[place[k] + 1] = padded[start[k]]
        else:
            limit = np.minimum((own[k] + 1) * block, n)
            for j in range(int(COUNT[s]) if BITS[s] else 0):
                p = start[k] + j
                word |= np.where(p < limit, padded[p], U(0)) << U(j * int(BITS[s]))
        words[place[k]] = word
    first = np.searchsorted(own, np.arange(blocks))
    return words, np.r_[place[first], len(words)]


def decode_words(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """Ids of a frame's words; all words of a selector are unpacked together, each to its place."""
    out = np.zeros(max(0, len(offsets) - 1) * block + 240, U)
    if not n:
        return out[:0]
    sel = (words >> U(60)).astype(np.int64)
    raw = np.zeros(len(words) + 1, bool)
    for k in np.flatnonzero(sel == 1).tolist():  # escapes are rare; a raw word may look like one
        if not raw[k]:
            raw[k + 1] = True
    lead = np.flatnonzero(~raw[:-1])
    count = COUNT[sel[lead]]
    own = np.searchsorted(offsets, lead, "right") - 1
    total = np.cumsum(count) - count
    base = total[np.searchsorted(lead, offsets[:-1])]
    start = own * block + total - base[own]
    kind = sel[lead]
    ends = np.minimum((own + 1) * block, n)
    for s in np.unique(kind):
        k = np.flatnonzero(kind == s)
        if s == 1:
            out[start[k]] = words[lead[k] + 1]
        elif BITS[s]:
            b, mask, w = int(BITS[s]), U((1 << int(BITS[s])) - 1), words[lead[k]]
            for j in range(int(COUNT[s])):
                p = start[k] + j
                ok = p < ends[k]
                out[p[ok]] = ((w >> U(j * b)) & mask)[ok]
    return out[:n]


def pack_frame(doc_ids: list, lengths: list[int], ids: np.ndarray, block: int = BLOCK) -> bytes:
    words, offsets = encode_words(ids, block)
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = np.array([len(ids), len(doc_ids), len(offsets) - 1, len(words), block], "<u8")
    return b"".join([MAGIC, head.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<u8").tobytes(), null.tobytes(), offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def unpack_frame(frame: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, ids a document, all ids) of a frame."""
    if frame[:8] != MAGIC:
        raise ValueError("not a token frame")
    n, docs, blocks, words, block = np.frombuffer(frame, "<u8", 5, 8).astype(int)
    at = 48
    doc = np.frombuffer(frame, "<i8", docs, at)
    length = np.frombuffer(frame, "<u8", docs, at + 8 * docs).astype(np.int64)
    null = np.frombuffer(frame, np.uint8, docs, at + 16 * docs)
    at += 17 * docs
    offsets = np.frombuffer(frame, "<u8", blocks + 1, at).astype(np.int64)
    w = np.frombuffer(frame, "<u8", words, at + 8 * (blocks + 1))
    return [None if z else int(d) for d, z in zip(doc, null, strict=True)], length, decode_words(w, offsets, n, block)


# Fixed value: what the file must say of its pre-tokens for the rank coder's pattern to be the same.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


@cache
def byte_coder(json_path: str, rank_path: str):
    """Coder of texts for the byte-level file: the vocabulary's rank file does the work (about five times faster and
    with the same ids); texts with a special token's string or letters beyond U+024F go through the tokenizers library."""
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    spec = json.load(open(json_path, encoding="utf-8"))
    if spec["normalizer"] or spec["pre_tokenizer"] != PRE_TOKENIZER:
        raise ValueError(f"{json_path} cuts texts in another way than the rank coder does")
    library = Tokenizer.from_file(json_path)
    specials = [t.content for t in library.get_added_tokens_decoder().values()]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(rank_path, "rb"))}
    chars = byte_characters()
    specials_of = {t["content"] for t in spec["added_tokens"]}
    if {t: i for t, i in spec["model"]["vocab"].items() if t not in specials_of} != {"".join([chars[b] for b in raw]): i for raw, i in ranks.items()}:
        raise ValueError(f"{json_path} and {rank_path} are not one vocabulary")
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if text and (max(text) >= "ɐ" or any(s in text for s in specials)):
            return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast._core_bpe.encode_ordinary(text), np.uint32)

    return encode


def _write(json_path: str, rank_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq, before = byte_coder(json_path, rank_path), TaskContext.get().partitionId(), 0, 0
        docs, lengths, ids, held = [], [], [], 0

        def frame():
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "before": pa.array([before], pa.int64()), "n_ids": pa.array([held], pa.int64()), "frame": pa.array([pack_frame(docs, lengths, np.concatenate(ids))], pa.binary())})

        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                ids += [encode(t), np.array([end_id], np.uint32)]
                docs.append(d)
                lengths.append(len(ids[-2]) + 1)
                held += lengths[-1]
                if held >= FRAME_IDS:
                    yield frame()
                    docs, lengths, ids, held, seq, before = [], [], [], 0, seq + 1, before + held
        if docs:
            yield frame()

    return run


def write_token_files(docs: DataFrame, json_path: str | None = None, rank_path: str | None = None, end_id: int = END_ID) -> tuple[DataFrame, str]:
    """Token-id files of ``docs(doc_id, text)`` in ascending doc_id order: (frames, folder in the shared directory).

    Frames are rows ``(part, seq, before, n_ids, frame)``; (part, seq) is their order, ``before`` counts a part's earlier ids. Null doc_ids come first, equal ones in
    the order of their texts; a null text is empty; each document ends with ``end_id``; other columns are ignored.
    """
    import public_tokenizers

    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    rank_path = rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    dealt = docs.select("doc_id", "text").repartitionByRange(shuffle_parts(docs.sparkSession), F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    return materialize(dealt.mapInArrow(_write(json_path, rank_path, end_id), "part int, seq int, before long, n_ids long, frame binary"), "token-files")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for base, f in zip(b.column("base").to_pylist(), b.column("frame").to_pylist(), strict=True):
            docs, length, ids = unpack_frame(f)
            ids, ends = ids.astype("<u4"), np.cumsum(length)
            view = memoryview(ids.tobytes())
            crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "start": pa.array(base + ends - length, pa.int64()), "n_tokens": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})


def read_token_files(frames: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, decoded from its frame.

    A frame's first id is counted from the sums of the parts before its own: as many rows as the writer had
    partitions, which bounds what the driver sees and broadcasts.
    """
    spark = frames.sparkSession
    sums, parts = 0, []
    for r in frames.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        parts.append((r.part, sums))
        sums += r.n
    bases = spark.createDataFrame(parts, "part int, part_base long")
    placed = frames.join(F.broadcast(bases), "part").select((F.col("part_base") + F.col("before")).alias("base"), "frame")
    return placed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    frames, _ = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_token_files(frames)
