"""Fill-in-middle transformation of whole texts, cut at ends of lines.

A text's units are its lines (``[^\\n]*\\n|[^\\n]+``). Two of its n + 1 cut places,
drawn from a hash of its id, part it into prefix, middle and suffix, which are
put in another order around sentinels (see ``Settings``).

Cut places are selected on words of eight bytes: the UTF-8 bytes of a whole batch
of texts are viewed as unsigned 64-bit integers, bytes that end a unit are marked
by arithmetic on all eight at once, marks are counted per word (``bitwise_count``)
and summed up; the k-th mark is found by a search for its word in the sums and
then within the word by prefix sums of its eight marks. Code points are counted
the same way over the bytes that begin one. Nothing is done per line or byte.

Every row is handled where it is read: no shuffle, and a repeated task gives the
same rows. Memory is linear in an Arrow batch.

Defined cases: a null text counts as empty; empty texts, and texts that hold a
sentinel, stay plain, with null lengths; a null id is hashed as the empty string;
equal rows give equal rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

U = np.uint64
LOW, HIGH, ONES = U(0x7F7F7F7F7F7F7F7F), U(0x8080808080808080), U(0x0101010101010101)
NEWLINES = U(0x0A0A0A0A0A0A0A0A)
SCHEMA = (
    "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary, restored_sha256 string"
)


@dataclass(frozen=True)
class Settings:
    """``rate`` of 100 texts are transformed, ``spm`` of 100 of these with the suffix first."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"

    def draws(self, doc_id: int | None) -> tuple[int, int, int, int]:
        """Four unsigned 32-bit numbers of a document."""
        name = "" if doc_id is None else str(doc_id)
        digest = hashlib.sha256(f"{self.seed}:{name}".encode()).digest()
        return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))

    def assemble(self, form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
        if form == "plain":
            return prefix + middle + suffix
        head, tail = self.prefix + prefix, self.suffix + suffix
        return (tail + head if form == "spm" else head + tail) + self.middle + middle

    def restore(self, form: str, output: bytes) -> bytes:
        """The text from output and form alone: no sentinel occurs in the pieces, nor across their ends."""
        if form == "plain":
            return output
        first, second = (self.suffix, self.prefix) if form == "spm" else (self.prefix, self.suffix)
        a, rest = output[len(first) :].split(second, 1)
        b, middle = rest.split(self.middle, 1)
        return b + middle + a if form == "spm" else a + middle + b


class Marks:
    """Rank and select over marked bytes, eight bytes to a word (little-endian: byte 0 is the lowest)."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks  # 0x80 in every marked byte
        self.sums = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before each byte offset."""
        word, byte = at >> 3, (at & 7).astype(U)
        here = self.marks[np.minimum(word, len(self.marks) - 1)]
        below = (U(1) << (U(8) * byte)) - U(1)
        return self.sums[word] + np.bitwise_count(here & below).astype(np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte offset of the k-th marked byte, from 0."""
        word = np.searchsorted(self.sums, k, side="right") - 1
        left = (k - self.sums[word]).astype(U)
        # Byte i of the product: marks in bytes 0..i of the word, at most 8. Bytes whose count is at most ``left``
        # lie before the wanted one; they are counted by the same arithmetic.
        counts = (self.marks[word] >> U(7)) * ONES
        before = ((left * ONES | HIGH) - counts) & HIGH
        return (word << 3) + np.bitwise_count(before).astype(np.int64)


def unit_ends(words: np.ndarray) -> Marks:
    """Marks of line feeds."""
    x = words ^ NEWLINES
    return Marks(~(((x & LOW) + LOW) | x) & HIGH)


def code_points(words: np.ndarray) -> Marks:
    """Marks of bytes that begin a code point: all but 10xxxxxx."""
    return Marks((~words | (words << U(1))) & HIGH)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes padded to whole words, n + 1 offsets) of a string array, without a copy per text."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.empty(0, np.uint8)
    padded = np.zeros((len(data) // 8 + 1) * 8, np.uint8)
    padded[: len(data)] = data
    return padded, offsets - offsets[0]


def transform_batch(ids: list[int | None], texts: pa.Array, settings: Settings) -> list[tuple]:
    """Rows of SCHEMA for a batch of documents."""
    data, offsets = _bytes_of(texts)
    words = data.view("<u8")
    lines, points = unit_ends(words), code_points(words)
    start, end = offsets[:-1], offsets[1:]
    filled = end > start
    # A last line without its line feed is a unit as well; its end is the end of the text.
    open_end = filled & (data[np.maximum(end - 1, 0)] != 10)
    first, last = lines.rank(start), lines.rank(end)
    n = last - first + open_end
    draws = np.array([settings.draws(i) for i in ids], np.int64).reshape(-1, 4)
    cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    at = np.empty((len(ids), 2), np.int64)
    for k in (0, 1):
        inner = (cuts[:, k] > 0) & (cuts[:, k] <= last - first)
        at[:, k] = np.where(cuts[:, k] == 0, start, end)
        at[inner, k] = lines.select(first[inner] + cuts[inner, k] - 1) + 1
    ranks = [points.rank(x) for x in (start, at[:, 0], at[:, 1])]
    chars = np.stack([ranks[1] - ranks[0], ranks[2] - ranks[1]], axis=1)
    raw, rows = data.tobytes(), []
    for i, doc_id in enumerate(ids):
        text = raw[start[i] : end[i]]
        if not text or draws[i, 2] % 100 >= settings.rate or any(s in text for s in (settings.prefix, settings.suffix, settings.middle)):
            form = "plain"
        else:
            form = "spm" if draws[i, 3] % 100 < settings.spm else "psm"
        a, b = at[i] - start[i]
        output = settings.assemble(form, text[:a], text[a:b], text[b:])
        restored = hashlib.sha256(settings.restore(form, output)).hexdigest()
        sizes = (None, None) if form == "plain" else (int(chars[i, 0]), int(chars[i, 1]))
        rows.append((doc_id, int(n[i]), form, *sizes, output, restored))
    return rows


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Rows of SCHEMA, one per row of ``docs``: ``output`` is the transformed text in UTF-8, ``restored_sha256`` that of the text rebuilt from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in SCHEMA.split(",")]
        for b in batches:
            rows = transform_batch(b.column(0).to_pylist(), b.column(1), settings)
            if rows:
                cols = dict(zip(names, zip(*rows)))
                types = {"form": pa.string(), "output": pa.binary(), "restored_sha256": pa.string()}
                yield pa.RecordBatch.from_arrays([pa.array(cols[c], types.get(c, pa.int64())) for c in names], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), "restored_sha256"
    )


OP11_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), numbers AS (
  SELECT doc_id, body, regexp_extract_all(body, '[^\n]*\n|[^\n]+') AS units,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM drawn
), cuts AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
    greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 100 THEN 'plain'
         WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), pieces AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS pre, coalesce(array_to_string(units[a + 1:b], ''), '') AS mid,
    coalesce(array_to_string(units[b + 1:n], ''), '') AS suf FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
         ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM pieces
"""
