"""Texts above a token limit in pieces under it, cut at natural boundaries, with overlap.

The tokenizer gives the character at which each token begins, and the text in pages of one window's
tokens, so that a window or piece is cut out of at most two pages and never out of the whole text;
the rest is SQL on arrays. From a
piece's first token the window of at most `limit` tokens is taken; a regular expression with bounded
quantifiers, its alternatives ordered by strength (paragraph, line, sentence, clause, blank), takes
as much of the window as ends at such a boundary in its later part, else all of it, to the
character. The later part is one of characters and of tokens: a piece has at least half of the
window's tokens, also where the window's characters are unevenly divided into tokens. The next piece begins `overlap` tokens before the end.

Defined results
- null and empty texts and texts within the limit have no pieces
- pieces cover the text without gap; neighbours share exactly `overlap` tokens of the whole text
- a text without any boundary is cut between tokens; repeated rows each have their pieces
- n_tokens is the size of the piece encoded by itself. SLACK keeps it within the limit but for texts
  whose tokens change when they are cut; such a piece is halved, again with overlap, until it fits
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import tokens

#: A piece encoded by itself may have a few tokens more than its share of the whole text.
SLACK = 12
#: A boundary is taken if it lies beyond this share of the window; stronger ones may lie earlier.
EARLIEST = {"paragraph": 0.5, "line": 0.6, "sentence": 0.6, "clause": 0.75, "blank": 0.5}
#: What a piece may end with, strongest first.
BOUNDARIES = {
    "paragraph": r"\n[ \t]*\n",
    "line": r"\n",
    "sentence": r"[.!?…][\"'”’»)\]]{0,3}(?=\s)",
    "clause": r"[;:,](?=\s)",
    "blank": r"(?=\s)",
}


def _pattern(width: Column, least: Column) -> Column:
    parts = []
    for name, end in BOUNDARIES.items():
        parts += [F.lit("^.{"), F.greatest(F.lit(1), F.least(width, least), F.floor(width * EARLIEST[name])).cast("string"), F.lit(","), width.cast("string"), F.lit("}" + end + "|")]
    return F.concat(F.lit("(?s)"), *parts, F.lit("^.{1,"), width.cast("string"), F.lit("}"))


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once: expressions of a lambda are evaluated wherever
    they stand, in a filter for every element."""
    return F.transform(F.array(value), body)[0]


def stretch(s: Column, stop: Column, start: Column, end: Column, room: int) -> Column:
    """Characters [start, end) of tokens [s, stop), at most `room` of them, from the pages."""
    k = F.floor(s / room).cast("int")
    both = F.concat(F.element_at("_pages", k + 1), F.when(stop > (k + 1) * room, F.element_at("_pages", k + 2)).otherwise(F.lit("")))
    return F.substr(both, start - F.element_at("_at", k * room + 1) + 1, end - start)


def piece_bounds(limit: int, overlap: int) -> Column:
    """array<struct<first, last, start, end>>: tokens [first, last) and characters [start, end) of
    the pieces of a text, from columns _at, _pages (of `limit` - SLACK tokens) and _length."""
    at = "_at"
    n = F.size(at)
    room = limit - SLACK
    begin = lambda i: F.when(i < n, F.element_at(at, (i + 1).cast("int"))).otherwise(F.col("_length"))
    piece = "array<struct<first:int,last:int,start:int,end:int>>"
    # every piece but the last has so many tokens, so the number of steps is bounded
    half = max(overlap + 1, room // 2)
    most = F.ceil(n / F.lit(half - overlap)).cast("int") + 1

    def step(state: Column, _: Column) -> Column:
        s = state["next"]
        stop = F.least(s + room, n)

        def at_window(w: Column) -> Column:
            width = w["end"] - w["start"]
            window = stretch(s, w["stop"], w["start"], w["end"], room)
            taken = F.length(F.call_function("regexp_extract", window, _pattern(width, w["half"] - w["start"] + 1), F.lit(0)))
            return let(w["start"] + taken, lambda boundary: at_boundary(w, boundary))

        def at_boundary(w: Column, boundary: Column) -> Column:
            # tokens of the window that begin before the boundary
            inside = F.size(F.filter(F.slice(F.col(at), s + 1, room), lambda x: x < boundary))
            last = F.when(w["stop"] >= n, n).otherwise(F.least(F.greatest(s + inside, s + half), w["stop"])).cast("int")
            return let(last, lambda end: grown(w, end))

        def grown(w: Column, last: Column) -> Column:
            new = F.struct(s.alias("first"), last.alias("last"), w["start"].cast("int").alias("start"), begin(last).cast("int").alias("end"))
            return F.struct(
                F.when(last >= n, n).otherwise(last - overlap).cast("int").alias("next"), F.concat(state["pieces"], F.array(new)).cast(piece).alias("pieces"), (last >= n).alias("done")
            )

        return F.when(state["done"], state).otherwise(let(F.struct(stop.alias("stop"), begin(s).alias("start"), begin(stop).alias("end"), begin(s + half).alias("half")), at_window))

    zero = F.struct(F.lit(0).cast("int").alias("next"), F.array().cast(piece).alias("pieces"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), most), zero, step)["pieces"]


def split(documents: DataFrame, limit: int = 2000, overlap: int = 100, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, piece_no, start, end, n_tokens, piece) of every document above the limit."""
    room = limit - SLACK
    if room < 2 * (overlap + 1):
        raise ValueError("limit must be more than twice the overlap")
    # a token has at least one byte, so short texts need no tokenizer
    long = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).filter(F.octet_length("_text") > limit)
    # long texts lie unevenly in the files
    long = long.repartition(F.xxhash64("doc_id"), F.length("_text"))
    file, kind = tokens.vocabulary(path), long.schema["doc_id"]

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at, pages, length = tokens.paged(batch.column(1)[k].as_py(), room, file)
                if len(at) > limit:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([at], pa.list_(pa.int32())), pa.array([pages], pa.list_(pa.string())), pa.array([length], pa.int32())], names=["doc_id", "_at", "_pages", "_length"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = []
                for begin, piece in zip(batch.column(1)[k].as_py(), batch.column(2)[k].as_py()):
                    rows += [(begin + a, begin + b, n, piece[a:b]) for a, b, n in tokens.parts_within(piece, limit, overlap, file)]
                start, end, n, piece = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([k] * len(rows))), pa.array(range(len(rows)), pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(n, pa.int64()), pa.array(piece, pa.string())],
                    names=[f.name for f in out],
                )

    fields = [T.StructField("_at", T.ArrayType(T.IntegerType())), T.StructField("_pages", T.ArrayType(T.StringType())), T.StructField("_length", T.IntegerType())]
    out = T.StructType([kind, *(T.StructField(c, T.IntegerType()) for c in ("piece_no", "start", "end")), T.StructField("n_tokens", T.LongType()), T.StructField("piece", T.StringType())])
    # whole partitions go through Python, so no filter is moved before it and no text is encoded twice
    bounds = long.mapInArrow(tokenized, T.StructType([kind, *fields])).withColumn("_bounds", piece_bounds(limit, overlap))
    cut = bounds.select("doc_id", F.col("_bounds.start").alias("_start"), F.transform("_bounds", lambda b: stretch(b["first"], b["last"], b["start"], b["end"], room)).alias("_pieces"))
    return cut.mapInArrow(fitted, out)
