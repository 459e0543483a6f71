"""Encoding and decoding of a corpus with a public byte-level BPE vocabulary.

The vocabulary file gives the rank of each byte string, which is also its id.
Texts are cut into words by the vocabulary's public pattern.  Each distinct word
of the corpus is encoded once: a higher-order fold starts from its bytes and
merges, step by step, the neighbouring pair whose joined bytes have the lowest
rank, the leftmost first.  Ranks are a literal of the plan: an array of small
maps, found by a hash of the byte string, so that a look-up costs the same for
any size of vocabulary.  Byte strings are written in hexadecimal.

Words beyond LONG bytes (runs of blanks, text without blanks, encoded data) would make
that fold quadratic; they are encoded by the same merges with a heap of pairs in an
Arrow function, in n log n steps.

The HEAD most frequent short words go back into the texts from a broadcast (bounded in
number and length) in an Arrow function; all rarer or longer words go through a join.
No word is left out and no text is shortened.  A literal stands once in one plan only:
the driver prints each node of every plan it runs or changes and keeps what it printed.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import cut

#: The pattern that goes with the vocabulary (fixed value; white space in the Unicode sense).
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
HEAD = 32_768
HEAD_CHARS = 48
LONG = 128
BUCKETS = 8_192
NONE = 2_147_483_647


def load_ranks(path: str) -> dict[str, int]:
    """Rank by byte string in hexadecimal."""
    with open(path, "rb") as f:
        return {base64.b64decode(a).hex().upper(): int(b) for a, b in (line.split() for line in f if line.strip())}


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> dict[str, int]:
    return load_ranks(os.path.join(folder, f"{name}.tiktoken"))


def _literal(entries: dict, kind: str, buckets: int = BUCKETS) -> Column:
    """An array of maps from string to ``kind``; an entry lies in the map numbered by the CRC of its key."""
    maps: list[dict] = [{} for _ in range(buckets)]
    for k, v in entries.items():
        maps[zlib.crc32(k.encode()) % buckets][k] = v
    return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), f"array<map<string,{kind}>>")


def _find(literal: Column, key: Column, buckets: int = BUCKETS) -> Column:
    return F.get(literal, (F.crc32(F.encode(key, "utf-8")) % F.lit(buckets)).cast("int"))[key]


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def encode_word(word: Column, ranks: Column) -> Column:
    """ids of one non-empty word; ``ranks`` is bound once, as the fold looks it up in four places."""
    return _let(ranks, lambda known: _folded(word, known))


def _folded(word: Column, ranks: Column) -> Column:
    rank = lambda x: F.coalesce(_find(ranks, x), F.lit(NONE))
    hexed = F.hex(F.encode(word, "utf-8"))

    def fold(h: Column) -> Column:
        n = (F.length(h) / 2).cast("int")
        parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(h, i * 2 + 1, F.lit(2)))
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: rank(F.substring(h, i * 2 + 1, F.lit(4))))).otherwise(F.array().cast("array<int>"))
        start = F.struct(parts.alias("p"), pairs.alias("r"))

        def merge(s: Column, at: Column) -> Column:
            p, r = s["p"], s["r"]

            def put(new: Column) -> Column:
                left = F.when(at > 1, F.array(rank(F.concat(F.get(p, at - 2), new)))).otherwise(F.array().cast("array<int>"))
                right = F.when(at + 1 < F.size(p), F.array(rank(F.concat(new, F.get(p, at + 1))))).otherwise(F.array().cast("array<int>"))
                return F.struct(
                    F.concat(F.slice(p, F.lit(1), at - 1), F.array(new), F.slice(p, at + 2, F.size(p))).alias("p"),
                    F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(r, at + 2, F.size(p))).alias("r"),
                )

            return _let(F.concat(F.get(p, at - 1), F.get(p, at)), put)

        def step(s: Column, _: Column) -> Column:
            return _let(F.array_min(s["r"]), lambda low: F.when(low.isNull() | (low == NONE), s).otherwise(_let(F.array_position(s["r"], low).cast("int"), lambda at: merge(s, at))))

        steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.aggregate(steps, start, step)["p"], lambda x: _find(ranks, x))

    return _let(hexed, fold)


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """ids of one word: the pair of the lowest rank first, of equal ones the leftmost, by a heap over linked pieces."""
    n = len(word)
    end, before, after = [i + 1 for i in range(n)], list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else n
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    live = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not live[i] or j >= n or end[j] != stop:
            continue  # one of the two pieces has changed since
        live[j], end[i], after[i] = False, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        offer(before[i])
    return [ranks[word[i : end[i]]] for i in range(n) if live[i]]


def _long_words(words: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """(word, n, ids) of the words (word, n) by the heap."""
    sent = words.sparkSession.sparkContext.broadcast({bytes.fromhex(k): v for k, v in ranks.items()})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [_merge_long(w.encode(), sent.value) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return words.mapInArrow(merge, "word string, n long, ids array<int>")


def _placed(docs: DataFrame, head: pa.Table) -> tuple[DataFrame, DataFrame]:
    """Of the texts (id, h, w): runs (id, h, at, ids) of words in ``head`` (word, ids), and all other words (id, h, at, word).

    A word's place counts from 1; a run has the place of the word before it, or 0.  Every
    text has a run at 0, which may be empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(head.combine_chunks())
    columns = f"id {docs.schema['id'].dataType.simpleString()}, h long, at long"

    def found(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The start of each text, the row of ``head`` of each word or -1, the places of the latter."""
        w = b.column("w")
        known = sent.value["word"].combine_chunks().cast(w.type.value_type)
        at = pc.fill_null(pc.index_in(w.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
        return w.offsets.to_numpy() - w.offsets[0].as_py(), at, np.flatnonzero(at < 0)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = sent.value["ids"].combine_chunks()
        ids, first = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        size = np.diff(first)
        for b in batches:
            offsets, at, gaps = found(b)
            doc = np.concatenate([np.arange(b.num_rows), np.searchsorted(offsets, gaps, side="right") - 1])
            start, end = np.concatenate([offsets[:-1], gaps + 1]), np.concatenate([offsets[1:], gaps])
            order = np.lexsort((start, doc))
            start, end, doc = start[order], end[np.lexsort((end, doc))], doc[order]
            keep = (end > start) | (start == offsets[doc])
            start, end, doc = start[keep], end[keep], doc[keep]
            good = at[at >= 0]
            n = size[good]
            flat = ids[np.repeat(first[good] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())]
            tokens = np.zeros(len(at) + 1, dtype=np.int64)
            tokens[1:][at >= 0] = n
            tokens = np.cumsum(tokens)
            edges = np.concatenate([[0], np.cumsum(tokens[end] - tokens[start])])
            own = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat.astype(np.int32)))
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays([b.column("id").take(rows), b.column("h").take(rows), pa.array((start - offsets[doc]).astype(np.int64)), own], ["id", "h", "at", "ids"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, _, gaps = found(b)
            doc = np.searchsorted(offsets, gaps, side="right") - 1
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays([b.column("id").take(rows), b.column("h").take(rows), pa.array((gaps - offsets[doc] + 1).astype(np.int64)), b.column("w").flatten().take(pa.array(gaps))], ["id", "h", "at", "word"])

    return docs.mapInArrow(runs, f"{columns}, ids array<int>"), docs.mapInArrow(rare, f"{columns}, word string")


def encode(df: DataFrame, ranks: dict[str, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): token ids of every text, without special tokens, exactly as stored.

    Null and empty texts get the empty list.  Rows that repeat an id with the same
    text come out once; an id with several texts once for each.  An empty table
    gives an empty result, other columns are ignored.
    """
    # The literals would be printed whole into every plan the driver keeps.
    df.sparkSession.conf.set("spark.sql.maxPlanStringLength", "16384")
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = cut(df.select(F.col(id_col).alias("id"), F.xxhash64(text, F.lit("text")).alias("h"), pretokens(text).alias("w")))
    distinct = cut(docs.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    size = F.octet_length("word")
    short = distinct.where(size <= LONG).select("word", "n", encode_word(F.col("word"), _literal(ranks, "int")).alias("ids"))
    long = distinct.where(size > LONG).select("word", "n")
    table = cut(short)  # apart from the others, so that only one plan holds the literal
    if not long.isEmpty():
        table = table.unionByName(cut(_long_words(long, ranks)))
    frequent = table.where(F.length("word") <= HEAD_CHARS).orderBy(F.desc("n"), "word").limit(HEAD)
    runs, rare = _placed(docs, frequent.select("word", "ids").toArrow())
    # A run starts one place after a gap, so it carries the gap's place plus a half.
    rows = runs.select("id", "h", (F.col("at") * 2 + 1).alias("at"), "ids").unionByName(rare.join(table.select("word", "ids"), "word").select("id", "h", (F.col("at") * 2).alias("at"), "ids"))
    whole = rows.groupBy("id", "h").agg(F.array_sort(F.collect_set(F.struct("at", "ids"))).alias("parts"))
    return whole.select(F.col("id").alias(id_col), F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def decode(ids: Column, ranks: dict[str, int]) -> Column:
    """The text of token ids: their byte strings joined, read as UTF-8."""
    pieces = [""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        pieces[v] = k
    table = F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<string>")
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")), "utf-8")
