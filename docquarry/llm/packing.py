"""First-fit decreasing packing of documents into token sequences, in randomised groups of documents."""

from __future__ import annotations

import gc
import os
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import stage
from docquarry.llm.pieces import ChunkTable, slices

#: Documents in a group, on average.
GROUP = 4096
SEED = 11
#: Bytes of text that a worker takes at once; a longer text by itself.
SLICE_BYTES = 8_000_000
#: Words that a worker's table holds; twice as many at most, then the older half goes.
TABLE_WORDS = 100_000
#: New words encoded at once. The library's encodings take some hundred times the room of their ids.
NEW_WORDS = 16_000


#: Marks that a word may end with; they are tokens of their own after a letter or digit.
TAIL = ".,;:!?"
#: Words in which no mark joins the letter before it, and small letters come one for one.
LATIN = r"^[\x{00}-\x{12F}\x{131}-\x{24F}]*$"


@lru_cache(maxsize=1)
def token_encoder(tokenizer_file: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function from texts to all their ids, one text after the other, and where each text's end.

    The tokenizer drops white space and no token crosses it, so each distinct word of a batch is looked
    up once and its ids put at each place it stands. The words known stay with the worker, in a table of
    bounded size. Words that differ in the case of ASCII letters, or in marks at their end, are encoded
    together. Strings of special tokens in a text are ordinary text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    whole = Tokenizer.from_file(tokenizer_file)
    whole.encode_special_tokens = True
    letters = Tokenizer(whole.model)  # one vocabulary for both
    # For words of small letters, which the other steps would leave as they are, many in one text.
    letters.normalizer = normalizers.Sequence([])
    letters.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    ])
    ends_word = np.zeros(whole.get_vocab_size() + 1, bool)
    ends_word[[i for t, i in whole.get_vocab().items() if t.endswith("</w>")]] = True

    def encode_letters(words: list[str]) -> list[bytes]:
        texts = [" ".join(words[i:i + 1000]) for i in range(0, len(words), 1000)]
        encoded = [np.array(e.ids, "<u4") for e in letters.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(encoded)
        cuts = [0, *(4 * (np.flatnonzero(ends_word[ids]) + 1)).tolist()]
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode_any(words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in whole.encode_batch_fast(words, add_special_tokens=False)]

    def fill(words: list[str], find: Callable[[str], bytes | None]) -> dict[str, bytes]:
        given = pa.array(words, pa.string())
        latin = pc.match_substring_regex(given, LATIN)
        small = pc.if_else(latin, pc.ascii_lower(given), given)
        core = pc.utf8_rtrim(small, TAIL)
        core = pc.if_else(pc.and_(latin, pc.match_substring_regex(core, r"[\pL\pN]$")), core, small)
        own = pc.equal(core, given)
        ids: dict[str, bytes | None] = {}
        others, smalls, cores = (x.filter(pc.invert(own)).to_pylist() for x in (given, small, core))
        tails = [s[len(c):] for s, c in zip(smalls, cores)]
        plain = given.filter(own)
        known = set(plain.to_pylist())
        for c in {*cores, *tails}.difference(known):
            if c:
                ids[c] = find(c)
        new = pa.chunked_array([plain, pa.array([c for c, i in ids.items() if i is None], pa.string())])
        simple = pc.and_(pc.match_substring_regex(new, LATIN), pc.match_substring_regex(new, r"^\p{Ll}+$"))
        for mine, encode in ((new.filter(simple), encode_letters), (new.filter(pc.invert(simple)), encode_any)):
            mine = mine.to_pylist()
            for at in range(0, len(mine), NEW_WORDS):
                some = mine[at: at + NEW_WORDS]
                ids.update(zip(some, encode(some), strict=True))
        ids.update([(w, ids[c] + ids[t] if t else ids[c]) for w, c, t in zip(others, cores, tails)])
        return ids

    table = ChunkTable(fill, TABLE_WORDS)

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        known = table.ids(words.dictionary.to_pylist())
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        pool, starts = np.frombuffer(b"".join(known), "<u4"), np.cumsum(lengths) - lengths
        place = words.indices.to_numpy()
        each = lengths[place]
        ends = np.cumsum(each)
        ids = pool[np.repeat(starts[place] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate(([0], ends))[lists.offsets.to_numpy()[1:]]

    return encode


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(documents: DataFrame, tokenizer_file: str, room: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``room`` tokens of every document (doc_id, text): see PIECES; ``ids`` on request.

    Of a document longer than that, all pieces but the last are full. Null and empty texts are the end
    id alone. Rows with equal or null doc_id are documents of their own: ``_row`` tells them apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # no cycles are made here, and the collector would walk the table again and again
        try:
            yield from cut(batches, token_encoder(tokenizer_file))
        finally:
            gc.enable()
            pa.default_memory_pool().release_unused()

    def cut(batches: Iterator[pa.RecordBatch], encode) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, rows, texts = (batch.column(c) for c in ("doc_id", "_row", "text"))
            lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(lengths, SLICE_BYTES):
                ids, ends = encode(pc.fill_null(texts[a:b], ""))
                ids = np.insert(ids, ends, end_id)
                ends += np.arange(1, b - a + 1)
                out: list[tuple] = []
                for doc_id, row, first, end in zip(doc_ids[a:b].to_pylist(), rows[a:b].to_pylist(), [0, *ends[:-1]], ends):
                    for at in range(first, end, room):
                        piece = ids[at: min(at + room, end)]
                        out.append((doc_id, at - first, len(piece), zlib.crc32(piece), end - first, row, piece))
                yield _piece_batch(out, with_ids)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("_row"))
    return rows.mapInArrow(run, PIECES + ", _row long" + (", ids array<int>" if with_ids else ""))


def _piece_batch(out: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_row"]
    columns = [pa.array([o[i] for o in out], pa.int64()) for i in range(6)]
    if with_ids:
        names.append("ids")
        columns.append(pa.array([o[6].view("<i4") for o in out], pa.list_(pa.int32())))
    return pa.RecordBatch.from_arrays(columns, names)


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length its bin and offset; the longest first, each into the first bin with room.

    A tournament tree holds the capacity of every bin at its leaves and at each node the larger of its
    two; going down to the left child that is large enough finds the first bin in log time.
    """
    n = len(lengths)
    leaves = 1 << max(n - 1, 0).bit_length()
    best = [room] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if best[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, room - best[node]
        best[node] -= need
        while node > 1:
            node //= 2
            best[node] = max(best[2 * node], best[2 * node + 1])
    return bins, offsets


def pack_pieces(pieces: DataFrame, room: int, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    Documents fall into groups of about ``group`` at random, by a hash of their row, not of their id;
    each group is packed by itself, in one task, so groups are small whatever is frequent. A document's
    pieces share its group; a text of 2 GB makes about 100,000 of them. Pieces of equal length keep the
    order of row and start, so the result does not depend on the order of arrival. No rows give none.
    ``pieces`` should be stored: it is counted first.
    """
    groups = max(1, -(-pieces.where(F.col("start") == 0).count() // group))
    rows = pieces.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "_row"), F.lit(groups).cast("long")))
    names = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name != "_row"]

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_row", "start"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), room)
        return pdf.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets).drop(columns=["_row", "_group"])

    return rows.groupBy("_group").applyInPandas(pack, ", ".join([*names, "sequence_id long", "offset long"]))


def pack_documents(documents: DataFrame, room: int = 4096, end_id: int = 2) -> DataFrame:
    """All documents cut into pieces and packed into sequences of at most ``room`` tokens."""
    import public_tokenizers

    pieces = cut_pieces(documents, public_tokenizers.path("word_bpe_49k.json"), room, end_id)
    return pack_pieces(stage(pieces, "pieces"), room)


def op9_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
