"""Token ids as flat unsigned integer files with 64-bit document offsets.

Documents are dealt out by ranges of (doc_id, hash of the text), sorted, encoded and written by one task per range as three files:
.ids (unsigned 16 or 32 bit, little-endian, by the size of the vocabulary), .off (unsigned 64 bit: the ids before each document of the file, and their
number) and .doc (signed 64 bit doc_ids; null ids come first and are counted in the manifest). A file's place in the whole is its base: the
prefix sum of the id counts of the files before it. Files get names of their own for each attempt of a task; those count that the
manifest names, and Spark commits one manifest row per task. Readers map the files into memory.

Encoding is that of the tokenizers library. Where a vocabulary's normalizer and pre-tokenizer are those of BY_WORD, they never look across ASCII blanks, so each blank-separated word is
encoded by the library's own parts once and then found in a cache of CACHE_WORDS words; a word with one of the
vocabulary's added tokens in it is encoded as a whole. Texts are encoded whole by the library with any other vocabulary.

Defined results: a null or empty text has the end id alone; null doc_ids come first; repeated doc_ids stand together, ordered by the hash of their texts;
an empty table gives empty results; texts of any length are encoded whole; extra columns of any name are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, scratch, slices
from .files import fresh, make_folder, opened

END_ID, CACHE_WORDS = 1, 600_000
#: Fixed by the vocabulary file's format: the normalizer and splitter whose work can be done word by word.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
MANIFEST = "part int, stem string, n_docs long, n_null long, n_tokens long, width int"
#: ASCII punctuation without the apostrophe: a run of it at a word's end is a piece of its own.
_PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The byte-level alphabet: printable Latin-1 stands for itself, other bytes for U+0100 on, in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LEVEL = dict(zip((b for b in range(256) if b not in _PRINTABLE), map(chr, range(256, 512)), strict=False))


class Encoder:
    def __init__(self, vocabulary: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.width = 2 if max(self.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.type = np.dtype(f"<u{self.width}")
        self.end = np.array([end_id], self.type).tobytes()
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)).encode()) if added else None
        config = json.loads(self.library.to_str())
        self.by_word = all(config[k] == v for k, v in BY_WORD.items()) and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in config["added_tokens"])
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        out = self.pieces.get(piece)
        if out is None:
            if len(self.pieces) >= CACHE_WORDS:
                self.pieces.clear()
            out = self.pieces[piece] = b"".join([t.id.to_bytes(self.width, "little") for t in self.library.model.tokenize(piece)])
        return out

    def _split(self, word: bytes) -> bytes:
        """Ids of a word that isn't in the cache."""
        core = word.rstrip(_PUNCTUATION)
        # Letters below U+0100 are composed already and have one lower-case form; bytes.isalpha() knows ASCII only.
        if not core or core.isalpha():
            head = core.lower().decode()
        elif max(core) < 0xC4 and (text := core.decode()).isalpha():
            head = text.lower().encode().decode("latin-1").translate(_BYTE_LEVEL)
        else:
            text = self.library.normalizer.normalize_str(word.decode())
            return b"".join([self._piece(p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)])
        tail = word[len(core) :].decode()
        return (self._piece(head) if head else b"") + (self._piece(tail) if tail else b"")

    def _word(self, word: bytes) -> bytes:
        if self.added and self.added.search(word):
            out = b"".join([i.to_bytes(self.width, "little") for i in self.library.encode(word.decode(), add_special_tokens=False).ids])
        else:
            out = self._split(word)
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        self.words[word] = out
        return out

    def encode(self, text: bytes | None) -> bytes:
        """The ids of a whole text and the end id, as they stand in the file."""
        if not self.by_word:
            return np.array(self.library.encode((text or b"").decode(), add_special_tokens=False).ids, self.type).tobytes() + self.end
        known, new = self.words.get, self._word
        return b"".join([known(w) or new(w) for w in (text or b"").split()]) + self.end


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Writes the files below folder; gives the manifest with base, the ids before each file."""
    spark = docs.sparkSession
    make_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, stem = Encoder(vocabulary, end_id), fresh(folder, "part", "")
        f, path = opened(stem)
        n = nulls = at = 0
        out = None
        for b in slices(batches):
            if not b.num_rows:
                continue
            if out is None:
                out = [f.open_output_stream(f"{path}{s}") for s in (".ids", ".off", ".doc")]
            parts = [enc.encode(t) for t in b.column("text").to_pylist()]
            starts = at + np.concatenate([[0], np.cumsum([len(p) // enc.width for p in parts])])
            out[0].write(b"".join(parts))
            out[1].write(starts[:-1].astype("<u8").tobytes())
            out[2].write(np.array([d or 0 for d in b.column("doc_id").to_pylist()], "<i8").tobytes())
            at, n, nulls = int(starts[-1]), n + b.num_rows, nulls + b.column("doc_id").null_count
        if out is not None:
            out[1].write(np.array([at], "<u8").tobytes())
            for o in out:
                o.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "stem": [stem], "n_docs": [n], "n_null": [nulls], "n_tokens": [at], "width": pa.array([enc.width], pa.int32())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    manifest = materialize(dealt.select("doc_id", "text").mapInArrow(write, MANIFEST), "token-manifest")
    # One row per file in this window.
    return manifest.withColumn("base", F.sum("n_tokens").over(W.orderBy("part")) - F.col("n_tokens"))


class _Numbers:
    """A file of numbers: a memory map where the store is local, else read by ranges."""

    def __init__(self, uri: str, kind: str):
        f, path = opened(uri)
        self.kind, self.map, self.file = np.dtype(kind), None, None
        if f.type_name == "local":
            self.map = np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, kind)
        else:
            self.file = f.open_input_file(path)

    def part(self, lo: int, hi: int) -> np.ndarray:
        if self.map is not None:
            return self.map[lo:hi]
        size = self.kind.itemsize
        return np.frombuffer(self.file.read_at((min(hi, self.file.size() // size) - lo) * size, lo * size), dtype=self.kind)


def read_token_files(manifest: DataFrame, rows_per_batch: int = 4096) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; a task reads some files, a batch of documents at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for r in b.to_pylist():
                ids, off, doc = (_Numbers(r["stem"] + x, k) for x, k in ((".ids", f"<u{r['width']}"), (".off", "<u8"), (".doc", "<i8")))
                for k in range(0, r["n_docs"], rows_per_batch):
                    o = off.part(k, k + rows_per_batch + 1).astype(np.int64)
                    own, at = ids.part(int(o[0]), int(o[-1])), o - o[0]
                    crc = [zlib.crc32(own[s:e].astype("<u4").tobytes()) for s, e in zip(at[:-1], at[1:], strict=True)]
                    null = np.arange(k, k + len(crc)) < r["n_null"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.asarray(doc.part(k, k + len(crc))), pa.int64(), mask=null), pa.array(o[:-1] + r["base"], pa.int64()), pa.array(np.diff(o), pa.int64()), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    spark = manifest.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(n, "stem").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    return read_token_files(write_token_files(docs, scratch(spark, "token-files"), vocabulary))
