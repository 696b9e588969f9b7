"""Packing by power-of-two decomposition (operator 10).

A document's token ids are cut into full blocks of the longest length and then into pieces whose lengths are the
binary digits of the rest, longest first.  Every piece is a sequence of its own: sequences of one length form a
bucket, nothing is padded and no sequence crosses documents.  The plan is a single map over the rows, without a
shuffle; a writer partitions by `bucket`.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

LONGEST = 4096
END_ID = 2

def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Texts of these characters take the quick way below, which equals the tokenizer's own normaliser and splitter there.
_PLAIN = re.compile("[ \t-\r!-~À-ÖØ-öø-ÿ]*")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-zß-öø-ÿ0-9]+")
_BLOCK = 1_000_000
#: The parts of a tokenizer file for which the quick way is right (fixed values of that format).
_QUICK = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
}


def is_quick(path: str) -> bool:
    """Whether a tokenizer file normalises and splits as the quick way does, and adds no token but "<|...|>"."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    added = all(t["content"].startswith("<|") for t in parts.get("added_tokens", ()))
    return added and parts["model"].get("type") == "BPE" and all(parts.get(k) == v for k, v in _QUICK.items())


class Encoder(dict):
    """Piece of a lower-cased word -> its ids as little-endian 32-bit bytes.

    A tokenizer that `is_quick` drops white space and never joins characters across it, so a text may be cut at any
    white space.  Blocks of plain Latin characters are lower-cased and split here, and their pieces go straight to the
    BPE model through a bounded cache, emptied when it is full.  All other blocks, and whole texts of any other
    tokenizer, go through the tokenizer.
    """

    def __init__(self, path: str, most: int = 800_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.quick = Tokenizer.from_file(path), most, is_quick(path)
        self.model = self.tokenizer.model
        direct = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shift = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in direct)}

    def __missing__(self, piece: str) -> bytes:
        word = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.shift)
        found = _packed([t.id for t in self.model.tokenize(word)])
        if len(self) >= self.most:
            self.clear()
        self[piece] = found
        return found

    def ids(self, text: str) -> bytes:
        if not self.quick:
            return self._whole(text)
        return b"".join([self._block(block) for block in _blocks(text)])

    def _block(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.__getitem__, _PIECES.findall(text.lower())))
        return self._whole(text)

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)


def _blocks(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > _BLOCK:
        end = max(text.rfind(" ", start, start + _BLOCK), text.rfind("\n", start, start + _BLOCK))
        end = end if end > start else len(text)
        yield text[start:end]
        start = end
    yield text[start:]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def cuts(total: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of each piece of `total` ids: full blocks, then the binary digits of the rest."""
    out = [(s, longest) for s in range(0, total - longest + 1, longest)]
    start, bit = len(out) * longest, longest >> 1
    while bit:
        if (total - start) & bit:
            out.append((start, bit))
            start += bit
        bit >>= 1
    return out


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    tokenizer: str | None = None,
    longest: int = LONGEST,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (and the ids).

    A null text counts as empty and gives one piece, the end id alone; a null id stays null; repeated rows are packed
    once each; an empty table gives no rows.  Only the two named columns are read, so others may have any name.
    `longest` must be a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    path, end = tokenizer or default_tokenizer(), end_id.to_bytes(4, "little")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`id` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(path)
            rows, start, length, crc, tokens, kept, held = [], [], [], [], [], [], 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.ids(text or "") + end
                view, n = memoryview(ids), len(ids) // 4
                for s, k in cuts(n, longest):
                    piece = view[4 * s : 4 * (s + k)]
                    rows.append(i)
                    start.append(s)
                    length.append(k)
                    crc.append(zlib.crc32(piece))
                    tokens.append(n)
                    if with_ids:
                        kept.append(bytes(piece))
                        held += 4 * k
                if len(rows) >= 20_000 or held > 8_000_000:
                    yield made(batch, rows, start, length, crc, tokens, kept)
                    rows, start, length, crc, tokens, kept, held = [], [], [], [], [], [], 0
            if rows:
                yield made(batch, rows, start, length, crc, tokens, kept)

    def made(batch, rows, *columns) -> pa.RecordBatch:
        *numbers, kept = columns
        arrays = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in numbers)]
        names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:
            arrays, names = [*arrays, pa.array(kept, pa.binary())], [*names, "ids"]
        return pa.RecordBatch.from_arrays(arrays, names)

    pieces = arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema)
    return pieces.select(
        F.col("id").alias(id_col),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.log2("length").cast("int").alias("bucket"),
        *(["ids"] if with_ids else []),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op10_packing": op10_packing}
ORACLES: dict[str, str] = {}
