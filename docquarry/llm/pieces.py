"""Encoding and decoding of whole texts with a sentencepiece model, by a table of distinct marked words."""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: A marked word: the marks before it and all up to the next mark.
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Marked words held by a worker; twice as many at most, then the older half goes.
TABLE_SIZE = 300_000
#: Characters of the marked words held, likewise; a few words may be as long as a text.
TABLE_CHARS = 4_000_000
#: Words that are segmented at once.
NEW = 50_000
#: Bytes of text that a worker takes at once; a longer text by itself.
SLICE_CHARS = 2_000_000


class ChunkTable:
    """Distinct chunks of text and the bytes of their ids, filled as needed; bounded, the older half goes first.

    ``fill`` gets the chunks that are missing and a function that looks others up, and returns entries.
    """

    def __init__(self, fill: Callable[[list[str], Callable[[str], bytes | None]], dict[str, bytes]], size: int = TABLE_SIZE):
        self.fill, self.size = fill, size
        self.chars = 0
        self.now: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def find(self, chunk: str) -> bytes | None:
        found = self.now.get(chunk)
        return self.older.get(chunk) if found is None else found

    def ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk."""
        if len(self.now) > self.size or self.chars > TABLE_CHARS:
            self.older, self.now, self.chars = self.now, {}, 0
        ids = list(map(self.now.get, chunks))
        missing = {c for c, i in zip(chunks, ids) if i is None}
        if missing:
            kept = {c: i for c in missing if (i := self.older.get(c)) is not None}
            self.now.update(kept)
            self.chars += sum(map(len, missing))
            new = list(missing.difference(kept))
            for at in range(0, len(new), NEW):
                self.now.update(self.fill(new[at: at + NEW], self.find))
            now = self.now
            ids = [now[c] if i is None else i for c, i in zip(chunks, ids)]
        return ids

    def joined(self, lists: list[list[str]]) -> list[bytes]:
        """The ids of each list of chunks, one after the other."""
        ids = self.ids(list(chain.from_iterable(lists)))
        ends = list(accumulate(map(len, lists), initial=0))
        return [b"".join(ids[a:b]) for a, b in zip(ends, ends[1:])]


def _processor(model_file: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_file)


def pieces_stay_in_words(model_file: str) -> bool:
    """Whether no piece has a mark after another character, so that none can cross the start of a word."""
    sp = _processor(model_file)
    return not any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size()))


#: Repeated, first and last blanks, and characters that the usual normalisations would replace.
PROBE = "  a  b\tc\n\u3000\u00a0 A\uff21 \ufb01 e\u0301 \u00e9 \u00bd \u200b "


def text_stays(model_file: str) -> bool:
    """Whether the model only puts a mark first and for each blank, and changes nothing else of a text."""
    return _processor(model_file).normalize(PROBE) == MARK + PROBE.replace(" ", MARK)


def encoder(model_file: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids, as 32-bit numbers, equal to the library's over the whole texts."""
    sp = _processor(model_file)

    def fill(chunks: list[str], _) -> dict[str, bytes]:
        # The library puts a mark before every text, so the first mark of a chunk is left out.
        ids = sp.encode([c[1:] for c in chunks], num_threads=1)
        found = {c: array("i", i).tobytes() for c, i in zip(chunks, ids)}
        return found | {MARK: array("i", [sp.piece_to_id(MARK)]).tobytes()}

    table = ChunkTable(fill)

    def encode(texts: list[str]) -> list[bytes]:
        return table.joined([CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts])

    return encode


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths come to about ``most`` together; a longer row by itself."""
    ends = np.concatenate(([0], np.cumsum(lengths)))
    start = 0
    while start < len(lengths):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
        yield start, stop
        start = stop


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])


def encode_documents(df: DataFrame, model_file: str, text: str = "text", ids: str = "_ids") -> DataFrame:
    """The rows with their texts' ids (array<int>), without begin or end ids.

    Each distinct marked word is segmented once in a task, as long as the worker's table holds it, and
    its ids are put back at each place it stands. Right only for models whose pieces cannot cross the
    start of a word and which don't change the text, by stripping blanks, normalising characters or leaving
    out the first mark; other models are refused. A null text has no ids, like an empty one. Other columns pass
    through; ``ids`` names the new one and must not be taken.
    """
    if not pieces_stay_in_words(model_file):
        raise ValueError("pieces of this model cross the start of words; encode whole texts instead")
    if not text_stays(model_file):
        raise ValueError("this model strips blanks, normalises characters or puts no mark first; encode whole texts instead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # no cycles are made here, and the collector would walk the table again and again
        encode = encoder(model_file)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(lengths, SLICE_CHARS):
                found = encode([t or "" for t in column[a:b].to_pylist()])
                ends = np.cumsum([0, *(len(f) // 4 for f in found)])
                values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield _with(batch.slice(a, b - a), ids, values)

    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(run, schema)


def decode_documents(df: DataFrame, model_file: str, ids: str = "_ids", text: str = "_decoded") -> DataFrame:
    """The rows with the text the library's decode() makes of their ids; null or no ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(model_file)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(lengths, SLICE_CHARS // 4):
                found = [sp.decode(i.as_py()) if i.is_valid and len(i) else "" for i in column[a:b]]
                yield _with(batch.slice(a, b - a), text, pa.array(found, pa.string()))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, then decoded: number and digest of the ids, digest of the text."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded = encode_documents(documents, model).drop("text")
    return decode_documents(encoded, model).select(
        "doc_id", F.size("_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("_decoded", 256).alias("decoded_sha256"),
    )
