"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds documents in ascending order of their ids. Layout: frames of token ids (little-endian unsigned 32-bit, whole
documents, about FRAME_TOKENS each), one skippable frame with the index of the documents, and the seek table of the public
zstd seekable format (compressed size, size and XXH64 checksum per frame), which closes the file. A reader takes the
last bytes, the table and the index, and then decompresses only the frames that hold the documents it was asked for.
"""

from __future__ import annotations

import re
import struct
import uuid
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from chatloom.llm.bpe import byte_letters
from chatloom.llm.common import Query, slices, table
from chatloom.session import scratch_dir

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
FRAME_TOKENS = 1 << 18
LEVEL = 3
# Words (twice this many) and pieces of words that a worker remembers.
REMEMBERED, REMEMBERED_PIECES = 200_000, 600_000
STEP_BYTES = 6_000_000
# Fixed values of the public seekable format.
INDEX_MAGIC = 0x184D2A50
TABLE_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80
NO_ID = -(1 << 63)  # stands for a null document id


# Words that the vocabulary's rules cut the same way as PIECE does: no control or white space, no letters that normalise.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


class WordTokens:
    """Ids from the tokenizers library, word by word.

    The vocabulary's own rules never join what a space or line end parts (its pattern drops white space, and special tokens hold
    none), so a text's ids are those of its words one after the other; each word is encoded once and then remembered. Words
    of plain letters, digits and marks are put together from the pieces into which the rules cut them, lower-cased.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model, self.letters = self.library.model, byte_letters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """The library's merges of one piece, written in the letters that stand for its bytes."""
        found = self.model.tokenize(piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode())))
        return array("I", [t.id for t in found]).tobytes()

    def _learn(self, words: Iterable[str]) -> None:
        whole, pieces = [], self.pieces
        if len(pieces) > REMEMBERED_PIECES:
            pieces.clear()
        for w in words:
            plain = w.isprintable() if w.isascii() else PLAIN.fullmatch(w)
            if not plain or ("<|" in w and any(s in w for s in self.special)):
                whole.append(w)
                continue
            parts = PIECE.findall(w.lower())
            for p in parts:
                if p not in pieces:
                    pieces[p] = self._piece(p)
            self.known[w] = pieces[parts[0]] if len(parts) == 1 else b"".join([pieces[p] for p in parts])
        found = self.library.encode_batch_fast(whole, add_special_tokens=False) if whole else ()
        self.known.update((w, array("I", e.ids).tobytes()) for w, e in zip(whole, found))

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of different words. What is in use moves from the older table to the newer one, the rest is forgotten."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        found = list(map(known.get, words))
        fresh = []
        for i, ids in enumerate(found):
            if ids is None:
                w = words[i]
                if (old := older.get(w)) is None:
                    fresh.append(i)
                else:
                    known[w] = found[i] = old
        self._learn([words[i] for i in fresh])
        for i in fresh:
            found[i] = known[words[i]]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's end; null has none.

        The words are told apart in Arrow, each different one is looked up once, and its ids are copied to all its places.
        """
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        found = self._ids(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        at = words.indices.to_numpy()
        lengths = sizes[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.arange(total) + np.repeat(starts[at] - (ends - lengths), lengths)]
        text_ends = np.cumsum(pc.list_value_length(split).to_numpy())
        return ids, np.concatenate([[0], ends])[text_ends]


@lru_cache(maxsize=4)
def tokenizer(path: str) -> WordTokens:
    return WordTokens(path)


def open_store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a shared folder (file, HDFS or an object store) and the path in it."""
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


class FrameWriter:
    """Writes one file; documents must come in the order they are to have."""

    def __init__(self, sink, level: int = LEVEL, frame_tokens: int = FRAME_TOKENS):
        self.sink, self.pack, self.limit = sink, zstandard.ZstdCompressor(level=level, write_checksum=True), 4 * frame_tokens
        self.held: list[bytes] = []
        self.size = 0
        self.table: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, tokens: bytes) -> None:
        if self.held and self.size + len(tokens) > self.limit:
            self._frame()
        self.held.append(tokens)
        self.size += len(tokens)
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.lengths.append(len(tokens) // 4)

    def _frame(self) -> None:
        raw = b"".join(self.held)
        packed = self.pack.compress(raw)
        self.sink.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        index = self.pack.compress(np.array(self.ids, "<i8").tobytes() + np.array(self.lengths, "<u8").tobytes())
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.table.append((len(index) + 8, 0, 0))
        body = b"".join(struct.pack("<III", *row) for row in self.table)
        body += struct.pack("<IBI", len(self.table), CHECKSUMS, FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", TABLE_MAGIC, len(body)) + body)
        self.sink.close()


class FrameReader:
    """Reads documents of one file by their place in it."""

    def __init__(self, source):
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        size = source.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or flags != CHECKSUMS:
            raise ValueError("not a file of seekable frames")
        rows = np.frombuffer(self._at(size - 9 - 12 * frames, 12 * frames), "<u4").reshape(frames, 3)
        starts = np.concatenate([[0], np.cumsum(rows[:, 0], dtype=np.int64)])
        index = self.unpack.decompress(self._at(int(starts[frames - 1]) + 8, int(rows[-1, 0]) - 8))
        n = len(index) // 16
        self.ids, lengths = np.frombuffer(index, "<i8", n), np.frombuffer(index, "<u8", n, 8 * n).astype(np.int64)
        self.rows, self.starts = rows[:-1], starts
        self.ends = np.cumsum(lengths)
        self.frame_ends = np.cumsum(self.rows[:, 1], dtype=np.int64) // 4
        self.current: tuple[int, bytes] = (-1, b"")

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def __len__(self) -> int:
        return len(self.ids)

    def tokens(self, i: int) -> bytes:
        """Ids of document `i` of the file; its frame alone is decompressed, and checked."""
        end = int(self.ends[i])
        start = int(self.ends[i - 1]) if i else 0
        if start == end:
            return b""
        frame = int(np.searchsorted(self.frame_ends, start, "right"))
        if self.current[0] != frame:
            packed, size, check = map(int, self.rows[frame])
            raw = self.unpack.decompress(self._at(int(self.starts[frame]), packed), max_output_size=size)
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {frame} is damaged")
            self.current = (frame, raw)
        base = int(self.frame_ends[frame - 1]) if frame else 0
        return self.current[1][4 * (start - base) : 4 * (end - base)]


def write_tokens(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID
) -> DataFrame:
    """Encode all whole texts, write them below `folder` in ascending order of the ids, return one row per file.

    file, first (tokens of all files before it), tokens, docs, part. Null and empty texts have the end id alone; null ids come
    first; rows with equal ids are ordered by text. Ranges of ids (and texts, should one id be very common) go to one task
    each, which writes under a name of its own and renames when whole, so a repeated task does no harm. An empty
    table gives no file. Other columns are not read.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    end = int(end_id).to_bytes(4, "little")
    run_id = uuid.uuid4().hex
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    rows = rows.withColumn("_tie", tie).repartitionByRange("id", "_tie").sortWithinPartitions("id", "_tie", "text")
    rows = rows.select(F.spark_partition_id().cast("bigint").alias("part"), "id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, out = tokenizer(path), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                part = batch.column(0)[0].as_py()
                store, root = open_store(folder)
                store.create_dir(root, recursive=True)
                name = f"tokens-{run_id}-{part:06d}.zst"
                made = f"{root}/.{name}.{uuid.uuid4().hex}"
                out = FrameWriter(store.open_output_stream(made, compression=None))
            for some in slices(batch, 2, STEP_BYTES):
                ids, ends = words.encode(some.column(2))
                begins = [0, *ends[:-1].tolist()]
                for doc_id, a, b in zip(some.column(1).to_pylist(), begins, ends.tolist()):
                    out.add(doc_id, ids[a:b].tobytes() + end)
        if out is not None:
            out.close()
            if store.get_file_info(f"{root}/{name}").type != pa.fs.FileType.NotFound:
                store.delete_file(f"{root}/{name}")  # of an attempt that was lost after its move
            store.move(made, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "tokens": [sum(out.lengths)], "docs": [len(out.ids)], "part": [part]})

    listed = rows.mapInArrow(write, "file string, tokens bigint, docs bigint, part bigint")
    listed.write.mode("overwrite").parquet(f"{folder}/_files")
    listed = docs.sparkSession.read.parquet(f"{folder}/_files")
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return listed.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """One row per document of the listed files: id, start (tokens of all documents before it), ids (binary)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['file']}") as source:
                    reader = FrameReader(source)
                    for a in range(0, len(reader), 500):
                        found = range(a, min(a + 500, len(reader)))
                        tokens = [reader.tokens(i) for i in found]
                        ends = reader.ends[found.start : found.stop] + row["first"]
                        ids = [None if i == NO_ID else int(i) for i in reader.ids[found.start : found.stop]]
                        starts = [int(e) - len(t) // 4 for e, t in zip(ends, tokens)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(tokens, pa.binary())],
                            names=["id", "start", "ids"],
                        )

    files = files.select("file", "first", "part")
    # a row is a whole file, so the parts follow the number of files and not the few bytes of their rows
    return files.repartition(max(1, files.count()), "part").mapInArrow(read, "id bigint, start bigint, ids binary")


def read_documents(folder: str, file: str, wanted: Iterable[int]) -> dict[int, list[np.ndarray]]:
    """Ids of the documents of one file whose id is wanted; only their frames are decompressed."""
    store, root = open_store(folder)
    with store.open_input_file(f"{root}/{file}") as source:
        reader = FrameReader(source)
        found: dict[int, list[np.ndarray]] = {}
        for i in np.flatnonzero(np.isin(reader.ids, np.fromiter(wanted, np.int64))):
            found.setdefault(int(reader.ids[i]), []).append(np.frombuffer(reader.tokens(int(i)), "<u4"))
        return found


def op9_frames(spark, sf_dir: str) -> DataFrame:
    """All documents, written and read back."""
    folder = scratch_dir(spark, "token-frames")
    files = write_tokens(table(spark, sf_dir, "documents"), folder)
    rows = read_tokens(files, folder)
    return rows.select(
        F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


QUERIES = {"op9_frames": Query(op9_frames)}
