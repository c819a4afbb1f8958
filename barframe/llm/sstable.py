"""Token-ID output as sorted string tables.

A shard holds the documents of one range of identifiers in ascending order:

    block*  entries (varint shared key bytes, varint own key bytes, varint value
            bytes, own key bytes, value), then restart offsets (u32 each) and their
            number (u32); the whole is zstd-compressed behind its raw size and the
            CRC-32 of the compressed bytes (u32 each)
    index   per block: first key, file offset, stored bytes, entries, tokens before
    Bloom   bits over all keys, BLOOM_BITS a key
    footer  fixed size, magic last

Keys are 8 big-endian bytes of the identifier with its sign bit flipped (null: no
bytes, so first); values are token ids as little-endian integers of ``width`` bytes.
``TableReader.get`` needs the footer, the index, the Bloom filter and one block.

Defined results: null text counts as empty and holds the end id alone; repeated
identifiers keep all their entries, ordered by text; an empty table writes no shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import storage
from . import textkernel as tk

MAGIC = b"BFSSTAB1"
FOOTER = struct.Struct("<QQQQQQB7x8s")  # index offset, size; Bloom offset, size; documents, tokens; width; magic
#: Bytes of text whose pieces are encoded together.
PIECE_BYTES = 1 << 23
BLOCK_BYTES, RESTART, BLOOM_BITS, BLOOM_HASHES = 1 << 17, 16, 10, 7
MANIFEST = "shard int, uri string, n_docs long, n_tokens long, n_bytes long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _bloom_positions(keys: list[bytes], bits: int) -> np.ndarray:
    one = np.array([zlib.crc32(k) for k in keys], np.uint64)
    two = np.array([zlib.crc32(k, 0x5BD1E995) for k in keys], np.uint64) | np.uint64(1)
    return (one[:, None] + two[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(bits)


class TableWriter:
    """Streams entries in key order to ``sink``; holds one block, the index and the keys' 8 bytes."""

    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self.keys: list[bytes] = []
        self.at = self.tokens = 0
        self._open()

    def _open(self) -> None:
        self.block, self.restarts, self.count, self.first, self.last, self.before = bytearray(), [], 0, b"", b"", self.tokens

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        if not self.count:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.count = key, self.count + 1
        self.tokens += len(value) // self.width
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._close()

    def _close(self) -> None:
        if self.count:
            raw = bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            body = pa.compress(raw, "zstd", asbytes=True)
            self.sink.write(struct.pack("<II", len(raw), zlib.crc32(body)) + body)
            self.index.append((self.first, self.at, len(body) + 8, self.count, self.before))
            self.at += len(body) + 8
            self._open()

    def finish(self) -> None:
        self._close()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QIIQ", *rest) for k, *rest in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        filled = np.zeros((bits + 7) // 8 * 8, bool)
        for i in range(0, len(self.keys), 65536):
            filled[_bloom_positions(self.keys[i : i + 65536], bits).ravel()] = True
        bloom = struct.pack("<Q", bits) + np.packbits(filled, bitorder="little").tobytes()
        self.sink.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.keys), self.tokens, self.width, MAGIC))


class TableReader:
    def __init__(self, uri: str):
        fsys, path = storage.open_fs(uri)
        self.file = fsys.open_input_file(path)
        size = self.file.size()
        index_at, index_size, bloom_at, bloom_size, self.n_docs, self.n_tokens, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token table")
        data, at, self.index = self._read(index_at, index_size), 0, []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.index.append((data[at : at + n], *struct.unpack_from("<QIIQ", data, at + n)))
            at += n + 24
        bloom = self._read(bloom_at, bloom_size)
        self.bits, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        stored = self._read(*self.index[i][1:3])
        raw_size, crc = struct.unpack_from("<II", stored)
        if zlib.crc32(stored[8:]) != crc:
            raise ValueError(f"block {i} is damaged")
        raw = pa.decompress(stored[8:], raw_size, "zstd", asbytes=True)
        n = struct.unpack_from("<I", raw, len(raw) - 4)[0]
        return raw[: len(raw) - 4 * n - 4], list(struct.unpack_from(f"<{n}I", raw, len(raw) - 4 * n - 4))

    def _entries(self, raw: bytes, at: int = 0) -> Iterator[tuple[bytes, np.ndarray]]:
        key = b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            own, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + own]
            yield key, np.frombuffer(raw, f"<u{self.width}", size // self.width, at + own)
            at += own + size

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, tokens before it in this shard, ids) in key order."""
        for i, entry in enumerate(self.index):
            before = entry[4]
            for key, ids in self._entries(self._block(i)[0]):
                yield id_of(key), before, ids
                before += len(ids)

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in map(int, _bloom_positions([key_of(doc_id)], self.bits)[0]))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of each entry under ``doc_id``: Bloom filter, binary search of blocks, then of restarts."""
        if not self.may_hold(doc_id):
            return []
        key, found = key_of(doc_id), []
        lo, hi = 0, len(self.index)
        while lo < hi:  # blocks that begin before the key
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0] < key else (lo, mid)
        for i in range(max(lo - 1, 0), len(self.index)):
            if self.index[i][0] > key:
                break
            raw, restarts = self._block(i)
            a, b = 0, len(restarts)
            while a < b:
                mid = (a + b) // 2
                first = next(self._entries(raw, restarts[mid]))[0]
                a, b = (mid + 1, b) if first < key else (a, mid)
            for k, ids in self._entries(raw, restarts[max(a - 1, 0)]):
                if k == key:
                    found.append(ids)
                elif k > key:
                    break
        return found


def _flags(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


_MARKS = _flags(*((ord(c), ord(c)) for c in ".,;:!?"))
_LETTERS = _flags((65, 90), (97, 122))
#: Bytes that begin a character other than white space: all white space beyond ASCII begins with C2, E1, E2 or E3.
_SOLID_LEAD = _flags((0x21, 0x7E), (0xC3, 0xE0), (0xE4, 0xF4))
_SOLID = _flags((0x21, 0x7E))
_HASH = tuple(tk._mixed(256, seed) | np.uint64(1) for seed in (505, 606))


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts may be cut so that their parts have the same ids as the whole.

    The byte-level pre-tokeniser ends a run of letters, digits or other signs before
    white space, gives a single space to what follows it, keeps letters and other signs
    apart, and takes a lone line feed by itself. So a cut is safe before a single space,
    around a lone line feed, and between a letter and a stop or comma.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    x = data[lo:hi]
    n = len(x)
    cut = np.zeros(n + 1, bool)
    cut[offsets - lo] = True
    if n < 3:
        return np.flatnonzero(cut[:n]) + lo
    before, here, after = x[:-2], x[1:-1], x[2:]
    latin = np.zeros(n - 2, bool)  # the byte before ends a letter of C3 xx
    latin[1:] = (x[:-3] == 0xC3) & (before[1:] >= 0x80) & (before[1:] < 0xC0) & (before[1:] != 0x97) & (before[1:] != 0xB7)
    left, right = _SOLID[before] | latin, _SOLID_LEAD[after]
    # a text's own ends are white space to its neighbour
    inner = ~cut[1 : n - 1]
    left, right = left & inner, right & ~cut[2:n]
    space = (here == 0x20) & (left | right) & (before != 0x20) & (after != 0x20) & inner
    space &= ~(_WHITE[before] & ~right) & ~(_WHITE[after] & ~left)
    feed = (here == 0x0A) & left & right
    mark = _MARKS[here] & (_LETTERS[before] | latin) & inner
    cut[1 : n - 1] |= space | feed | mark
    cut[2:n] |= feed
    return np.flatnonzero(cut[:n]) + lo


_WHITE = _flags((0x00, 0x20), (0x7F, 0xC2))


#: Pieces that an encoder remembers; further ones are encoded anew in each batch.
REMEMBERED = 1 << 20


class PieceEncoder:
    """Byte-level BPE ids of texts: of each batch the distinct pieces are encoded once, and spread by index.

    Pieces of earlier batches are remembered, by two hashes, up to REMEMBERED of them.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a byte-level token has a character for each of its bytes
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)
        self.known = np.zeros((2, 0), np.uint64)  # sorted by the first hash
        self.places, self.pool = np.zeros((2, 0), np.int64), np.zeros(0, f"<u{self.width}")  # (start, number) of each one's ids

    def _recall(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each piece is remembered, its place)"""
        if not self.known.shape[1]:
            return np.zeros(len(one), bool), np.zeros(len(one), np.int64)
        at = np.minimum(np.searchsorted(self.known[0], one), self.known.shape[1] - 1)
        return (self.known[0, at] == one) & (self.known[1, at] == two), at

    def _remember(self, keys: np.ndarray, places: np.ndarray, pool: np.ndarray) -> None:
        if self.known.shape[1] + keys.shape[1] > REMEMBERED:
            return
        keys, places = np.concatenate([self.known, keys], 1), np.concatenate([self.places, places], 1)
        _, order = np.unique(keys[0], return_index=True)  # of two pieces with one first hash the earlier stays
        self.known, self.places, self.pool = keys[:, order], places[:, order], pool

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, f"<u{self.width}") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _row(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of ids of each)"""
        ids = self._plain(["".join(pieces)])[0]
        cuts = np.cumsum([len(p.encode()) for p in pieces]) if pieces else np.zeros(0, np.int64)
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), cuts, "left") + 1
        return ids, np.diff(ends, prepend=0)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of UTF-8 ``data``."""
        out: list[np.ndarray] = [np.zeros(0, f"<u{self.width}")] * (len(offsets) - 1)
        raw = data[offsets[0] : offsets[-1]].tobytes()
        texts = lambda rows: [raw[offsets[r] - offsets[0] : offsets[r + 1] - offsets[0]].decode() for r in rows]
        if any(a in raw for a in self.added):  # an added token may span pieces
            return self._plain(texts(range(len(out))))
        starts = piece_starts(data, offsets)
        if not len(starts):
            return out
        ends = np.append(starts[1:], offsets[-1])
        one, two = (tk.word_hashes(data, starts, ends, table=t) for t in _HASH)
        _, first, inverse = np.unique(one, return_index=True, return_inverse=True)
        if (two != two[first][inverse]).any():  # two pieces share a hash
            return self._plain(texts(range(len(out))))
        one, two = one[first], two[first]
        hit, place = self._recall(one, two)
        fresh = np.flatnonzero(~hit)
        cuts = zip((starts[first[fresh]] - offsets[0]).tolist(), (ends[first[fresh]] - offsets[0]).tolist(), strict=True)
        pieces = [raw[a:b].decode() for a, b in cuts]
        # words with their space keep apart when they stand in a row, so they are encoded as one text
        word = np.array([p[0] == " " and p[1:].isalpha() for p in pieces], bool)
        made = [self._row([pieces[k] for k in group]) for group in np.array_split(np.flatnonzero(word), word.sum() // 4096 + 1)]
        rest = self._plain([pieces[k] for k in np.flatnonzero(~word)])
        number = np.empty(len(pieces), np.int64)
        number[word] = np.concatenate([n for _, n in made])
        number[~word] = [len(m) for m in rest]
        begin = np.empty(len(pieces), np.int64)
        order = np.concatenate([np.flatnonzero(word), np.flatnonzero(~word)])
        begin[order] = len(self.pool) + np.cumsum(number[order]) - number[order]
        pool = np.concatenate([self.pool, *(ids for ids, _ in made), *rest])
        at, sizes = np.empty((2, len(one)), np.int64)
        at[hit], sizes[hit] = self.places[:, place[hit]]
        at[fresh], sizes[fresh] = begin, number
        self._remember(np.stack([one[fresh], two[fresh]]), np.stack([begin, number]), pool)
        lengths = sizes[inverse]
        edges = np.concatenate([[0], np.cumsum(lengths)])
        ids = pool[np.arange(edges[-1]) - np.repeat(edges[:-1] - at[inverse], lengths)]
        rows = edges[np.searchsorted(starts, offsets)]
        return [ids[a:b] for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def write_tables(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, shards: int) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into about ``shards`` sorted shards in ``folder``; one MANIFEST row for each.

    Shards are ranges of identifiers, so their order is the order of documents. A
    task writes its shard under a temporary name and renames it.
    """

    def write(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = _encoder(tokenizer_path)
        end = np.array([end_id], f"<u{encoder.width}").tobytes()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        uri, made = f"{folder}/shard-{shard:06d}.sst", []

        def fill(sink):
            table = TableWriter(sink, encoder.width)
            for batch in (x for part in ([first], batches) for x in part):
                data, off = tk.utf8(batch.column(1))
                ids = batch.column(0).to_pylist()
                for i, j in tk.slices(off, PIECE_BYTES):
                    for doc_id, got in zip(ids[i:j], encoder.encode(data, off[i : j + 1]), strict=True):
                        table.add(key_of(doc_id), got.tobytes() + end)
            table.finish()
            made.append(table)

        size = storage.put_file(uri, fill)
        row = {"shard": [shard], "uri": [uri], "n_docs": [len(made[0].keys)], "n_tokens": [made[0].tokens], "n_bytes": [size]}
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, MANIFEST)


def read_tables(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the shards of ``manifest``."""

    def read(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for doc_id, before, ids in TableReader(uri).scan():
                    rows.append((doc_id, base + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 8192:
                        yield _digest(rows)
                        rows = []
                yield _digest(rows)

    # one row a shard
    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spread = manifest.select("uri", base.alias("base")).repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "uri")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _digest(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op4_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = storage.read_table(spark, sf_dir, "documents")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = write_tables(docs, storage.new_folder(spark, "token-tables"), public_tokenizers.path("byte_bpe_50k.json"), 2, shards)
    return read_tables(storage.materialize(spark, made, "token-manifest"))
