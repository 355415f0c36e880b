"""Encoding of a corpus with a public byte-level BPE vocabulary.

Ordinary texts are encoded whole.  A text longer than ``max_chars`` is cut into pieces that are encoded in parallel
tasks; the pieces are then concatenated pairwise in a tree.  Around each join the text is encoded again in a growing
window, until both ends of the window agree exactly with what the two sides have there:

* a window that starts and ends at *safe* places (where the pre-tokenizer splits whatever stands around) is exact;
* inside a run without safe places (one letter a million times) the window must repeat at least one token of either
  side.  A sequence of BPE tokens is the encoding of its bytes if and only if each two neighbours are the encoding
  of theirs, and every pair of neighbours in the result stands in one of the three encodings.

Defined results: a null or empty text gives an empty list; strings that look like special tokens are ordinary text;
repeated ids give one row each; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.plans.workspace import Workspace

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizer pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_CHARS = 1 << 18

_encoders: dict[str, object] = {}


def encoder(path: str, vocab: bytes):
    """The encoder of a vocabulary file's content, made once a Python process."""
    if path not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocab.splitlines() if line)}
        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _kind(c: str) -> str:
    if c.isspace():
        return "S"
    k = unicodedata.category(c)[0]
    return k if k in "LN" else "P"


def safe_split(before: str, after: str) -> bool:
    """Whether the pre-tokenizer splits between two characters in any context."""
    a, b = _kind(before), _kind(after)
    return a != "S" and a != b and before != "'"


def _token_at(enc, ids: list[int], start: int, size: int, *, from_end: bool) -> int | None:
    """How many tokens at the start (or end) of ``ids`` cover exactly ``size`` bytes."""
    covered = n = 0
    for t in reversed(ids) if from_end else ids:
        if covered >= size:
            break
        covered += len(enc.decode_single_token_bytes(t))
        n += 1
    return n if covered == size else None


def concatenate(enc, left: tuple[str, list[int]], right: tuple[str, list[int]]) -> tuple[str, list[int]]:
    """Join two encoded texts into the encoding of their concatenation."""
    (lt, li), (rt, ri) = left, right
    text = lt + rt
    if not li or not ri:
        return text, li or ri
    reach = 32
    while True:
        # safe places within reach, else the outer end where that is in reach
        a = next((len(lt) - p for p in range(1, min(reach, len(lt) - 1) + 1) if safe_split(lt[-p - 1], lt[-p])), None)
        if a is None and reach >= len(lt):
            a = 0
        b = next((p for p in range(1, min(reach, len(rt) - 1) + 1) if safe_split(rt[p - 1], rt[p])), None)
        if b is None and reach >= len(rt):
            b = len(rt)
        if a is not None and b is not None:
            keep_left = _token_at(enc, li, 0, len(lt[a:].encode()), from_end=True)
            keep_right = _token_at(enc, ri, 0, len(rt[:b].encode()), from_end=False)
            if keep_left is not None and keep_right is not None:
                return text, li[: len(li) - keep_left] + enc.encode_ordinary(lt[a:] + rt[:b]) + ri[keep_right:]
        joined = _agreeing_window(enc, li, ri, reach)
        if joined is not None:
            return text, joined
        if reach >= max(len(lt), len(rt)):
            return text, enc.encode_ordinary(text)
        reach *= 4


def _agreeing_window(enc, li: list[int], ri: list[int], width: int) -> list[int] | None:
    """Splice over a window of ``width`` tokens a side whose ends agree; only within one kind of characters."""
    cut_l, cut_r = max(0, len(li) - width), min(len(ri), width)
    data = enc.decode_bytes(li[cut_l:] + ri[:cut_r])
    try:
        window = data.decode()
    except UnicodeDecodeError:  # a token border within a character: a wider window will do
        return None
    if len({_kind(c) for c in window}) != 1:
        return None
    ids = enc.encode_ordinary(window)
    if len(ids) < 2 or ids[0] != li[cut_l] or ids[-1] != ri[cut_r - 1]:
        return None
    return li[:cut_l] + ids + ri[cut_r:]


def encode_pieces(enc, pieces: list[str]) -> list[int]:
    """Encoding of the joined pieces, from encodings of each, by a tree of concatenations."""
    level = [(p, enc.encode_ordinary(p)) for p in pieces]
    while len(level) > 1:
        level = [concatenate(enc, *level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0][1] if level else []


def _cut(rows: DataFrame, max_chars: int) -> DataFrame:
    """(doc, doc_id, at, text): the pieces of long texts; ``doc`` names a row, so that rows with one doc_id stay apart."""
    cuts = F.sequence(F.lit(0), F.ceil(F.length("text") / max_chars) - 1)
    return rows.select("doc", "doc_id", "text", F.explode(cuts).alias("at")).select(
        "doc", "doc_id", F.col("at").cast("int").alias("at"), F.expr(f"substring(text, cast(at * {max_chars} + 1 as int), {max_chars})").alias("text"))


def token_ids(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB, max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, ids array<int>), one row a document.  The vocabulary (a file of fixed size, under 1 MB) is sent to the executors once.

    Pieces of long texts are encoded by as many tasks as there are pieces.  Each level of the tree then joins neighbours in one task
    a pair; the number of levels follows from the longest text.
    """
    with open(vocab, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def encode(batches):
        import pyarrow as pa

        enc = encoder(vocab, content.value)
        for batch in batches:
            ids = pa.array([enc.encode_ordinary(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            kept = [c for c in batch.schema.names if c != "text" or "at" in batch.schema.names]  # pieces keep their text for the joins
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), ids], [*kept, "ids"])

    short = rows.filter(F.length("text") <= max_chars).mapInArrow(encode, f"doc_id {key}, ids array<int>")
    long = rows.filter(F.length("text") > max_chars)
    longest = long.agg(F.max(F.length("text"))).first()[0]  # one pass over the lengths decides how many levels there are
    if longest is None:
        return short
    work = Workspace(spark, "tokens")
    piece = f"doc string, doc_id {key}, at int, text string, ids array<int>"
    level = _cut(long.withColumn("doc", F.uuid()), max_chars)
    level = work.save(work.save(level, "pieces").repartition("doc", "at").mapInArrow(encode, piece), "level-0")

    def join(batches):
        import pyarrow as pa

        enc = encoder(vocab, content.value)
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                a, *b = sorted(parts, key=lambda p: p["at"])
                out.append(concatenate(enc, (a["text"], a["ids"]), (b[0]["text"], b[0]["ids"])) if b else (a["text"], a["ids"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("doc_id"), batch.column("at"), pa.array([t for t, _ in out], pa.string()), pa.array([i for _, i in out], pa.list_(pa.int32()))], ["doc", "doc_id", "at", "text", "ids"])

    for number in range((-(-longest // max_chars) - 1).bit_length()):
        pairs = level.groupBy("doc", "doc_id", F.shiftright("at", 1).alias("at")).agg(F.array_agg(F.struct("at", "text", "ids")).alias("parts"))  # two pieces
        following = work.save(pairs.mapInArrow(join, piece), f"level-{number + 1}")
        work.drop(level)
        level = following
    return short.unionByName(level.select("doc_id", "ids"))
