"""Token ids in training order: fixed-stride sequences, a keyed permutation of all of them, shards by ranges of slots."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import tiktoken
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.common import row_hash, small_batches, whole_text
from flowlens.plans.small import cut_lineage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROUNDS = 6
KNOWN = 100_000  # words whose ids a task keeps at once; most words come once, and a worker keeps the memory
PIECE = 1 << 16  # characters after which a long text is cut
CUT = re.compile(r" (?=\S)")


@dataclass(frozen=True)
class Layout:
    """``length`` ids in each sequence, ``per_shard`` sequences in each shard, ``seed`` keys the order."""

    length: int = 512
    per_shard: int = 4096
    seed: int = 20240601
    vocabulary: str = VOCABULARY

    def ranks(self) -> bytes:
        with open(self.vocabulary, "rb") as f:
            return f.read()


class Tokenizer:
    """Byte-pair ids of whole texts, as little-endian bytes of ``dtype``; the id after the last one ends a text."""

    def __init__(self, ranks: bytes):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.end = max(table.values()) + 1
        self.dtype = np.dtype("<u2") if self.end < 1 << 16 else np.dtype("<u4")
        self.coder = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.known: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return np.array(self.coder.encode_ordinary(text), self.dtype).tobytes()

    def whole(self, text: str) -> bytes:
        """The same ids, a long text being cut so that few of its ids are Python's numbers at once. A space before anything
        but white space always starts a piece of the pattern, so the text can be cut there."""
        out, at = [], 0
        while len(text) - at > PIECE and (cut := CUT.search(text, at + PIECE)):
            out.append(self.plain(text[at : cut.start()]))
            at = cut.start()
        return b"".join([*out, self.plain(text[at:])])

    def word(self, word: str) -> bytes:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            got = self.known[word] = self.plain(" " + word)
        return got

    def encode(self, text: str) -> bytes:
        """The same ids, each word's being looked up. That is faster than ``whole`` only where most words are known: a call
        for a word costs more than the word's ids in a text."""
        first, *rest = text.split(" ")
        if any(not w or w[0].isspace() for w in rest):
            return self.plain(text)
        return self.plain(first) + b"".join(map(self.word, rest))


def permuted(index: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A keyed permutation of 0 .. size - 1: a balanced Feistel network on the smallest even number of bits that holds
    ``size``; what falls outside walks on along its cycle until it is inside."""
    half = max(1, ((max(1, size - 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(seed).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        with np.errstate(over="ignore"):
            for key in keys:
                z = (right + key) * np.uint64(0x9E3779B97F4A7C15)
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while (outside := out >= size).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def slots(index: Column, size: int, seed: int) -> Column:
    @F.pandas_udf("long")
    def slot(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(permuted(batch.to_numpy(np.int64), size, seed))

    return slot(index)


PACKED = "row long, doc_id long, seq int, n_tokens int, packed binary"


def sequences(docs: DataFrame, layout: Layout, text: str = "text") -> DataFrame:
    """Every text's ids and an end id, cut into sequences of ``layout.length``; each is packed for the way to its shard."""
    ranks = layout.ranks()
    source = small_batches(docs).select(row_hash(text).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("text"))

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, packer = Tokenizer(ranks), zstandard.ZstdCompressor(level=1, write_content_size=True)
        width = tokenizer.dtype.itemsize
        stride = layout.length * width
        end = np.array([tokenizer.end], tokenizer.dtype).tobytes()
        for batch in batches:
            rows = []
            for row, doc_id, text in zip(batch["row"], batch["doc_id"], batch["text"], strict=True):
                if not text:
                    continue
                ids = tokenizer.whole(text) + end
                for seq, at in enumerate(range(0, len(ids), stride)):
                    piece = ids[at : at + stride]
                    rows.append((row, None if pd.isna(doc_id) else int(doc_id), seq, len(piece) // width, packer.compress(piece)))
                    if len(rows) >= 4096:
                        yield pd.DataFrame(rows, columns=["row", "doc_id", "seq", "n_tokens", "packed"])
                        rows = []
            yield pd.DataFrame(rows, columns=["row", "doc_id", "seq", "n_tokens", "packed"])

    return source.mapInPandas(tokenise, PACKED)


RECORDS = "slot long, shard int, offset long, row long, doc_id long, seq int, n_tokens int, tokens binary"


def training_order(docs: DataFrame, layout: Layout = Layout(), text: str = "text") -> DataFrame:
    """One record for each sequence, at its place in the training order: partitions are ranges of slots, sorted.

    ``tokens`` has ``layout.length`` ids of fixed width, those after ``n_tokens`` being the end id; ``offset`` is the
    record's first byte in its shard. The sequences are stored once, numbered without gaps by partition and row, and the
    keyed permutation gives each number its slot, so that slots are 0 .. n - 1, each once. The driver holds one count
    for each partition. Null and empty texts have no sequence, and empty tables no record. Repeated rows are tokenised as
    often as they come; other columns are not read.
    """
    spark = docs.sparkSession
    stored = cut_lineage(sequences(docs, layout, text)).withColumn("place", F.monotonically_increasing_id())
    part = F.shiftright("place", 33)
    counts = sorted(stored.groupBy(part.cast("int").alias("part")).count().collect())
    starts, size = [], 0
    for p, n in counts:
        starts.append((p, size))
        size += n
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, start long"))  # one row for each partition
    end = Tokenizer(layout.ranks())
    width, stride = end.dtype.itemsize, layout.length * end.dtype.itemsize
    pad = np.array([end.end], end.dtype).tobytes()
    shards = -(-size // layout.per_shard)
    tasks = max(1, min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size * stride >> 26)))
    numbered = stored.join(offsets, part.cast("int") == F.col("part")).select(
        "row", "doc_id", "seq", "n_tokens", "packed",
        (F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("index"),
    )
    placed = numbered.withColumn("slot", slots(F.col("index"), max(1, size), layout.seed))
    shard = F.expr(f"slot div {layout.per_shard}")
    ranged = placed.repartitionById(tasks, F.expr(f"cast((slot div {layout.per_shard}) * {tasks} div {max(1, shards)} as int)"))
    ranged = ranged.select("slot", shard.cast("int").alias("shard"), "row", "doc_id", "seq", "n_tokens", "packed").sortWithinPartitions("slot")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            ids = [opener.decompress(x) for x in batch.pop("packed")]
            batch.insert(2, "offset", batch["slot"] % layout.per_shard * stride)
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            batch["tokens"] = [x + pad * ((stride - len(x)) // width) for x in ids]
            yield batch

    return ranged.mapInPandas(unpack, RECORDS)


def write_shards(records: DataFrame, folder: str) -> DataFrame:
    """Write ``shard-*.bin`` below ``folder`` (a URI or path that all executors share) and return the manifest.

    A task streams its sorted records, one shard after another, into a file of its own name, which is moved to its
    final name when the shard is whole: a task that is run again writes the same bytes.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        done, now, out, name = [], None, None, ""

        def close() -> None:
            if out is not None:
                out.close()
                system.move(name, f"{base}/shard-{now:08d}.bin")

        for batch in batches:
            for shard, rows in batch.groupby("shard", sort=True):
                if shard != now:
                    close()
                    now, name = shard, f"{base}/.shard-{shard:08d}-{context.taskAttemptId()}"
                    out = system.open_output_stream(name)
                    done.append([int(shard), int(rows["slot"].iloc[0]), 0, 0])
                data = b"".join(rows["tokens"])
                out.write(data)
                done[-1][2] += len(rows)
                done[-1][3] += len(data)
        close()
        yield pd.DataFrame(done, columns=["shard", "first_slot", "n_sequences", "n_bytes"])

    return records.mapInPandas(write, "shard int, first_slot long, n_sequences long, n_bytes long")


def read_slots(folder: str, layout: Layout, start: int, stop: int, dtype: str = "<u2") -> np.ndarray:
    """Sequences ``start`` to ``stop`` of the order, by arithmetic alone: where a reader stopped is one number."""
    system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    stride = layout.length * np.dtype(dtype).itemsize
    found = []
    while start < stop:
        shard, at = divmod(start, layout.per_shard)
        n = min(stop - start, layout.per_shard - at)
        with system.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
            f.seek(at * stride)
            found.append(np.frombuffer(f.read(n * stride), dtype).reshape(-1, layout.length))
        start += n
    return np.concatenate(found) if found else np.empty((0, layout.length), dtype)
