"""Exact removal of repeated word windows, by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Its minimiser is the least hash of the
``mer``-word runs in it, the leftmost if there are several. Consecutive windows that share a
minimiser are one super-k-mer: a run of words, sent as one packed string to the bucket of that
minimiser. Equal windows have equal minimisers, so each bucket finds its repeats alone: equal
runs are repeats as a whole, and where several runs share a minimiser their windows are sorted.

A task sends each distinct run once, with its earliest place in that task; its other places are
repeats already. A minimiser that a very
large share of documents has (found on a sample, which steers rows and decides nothing) is
not used for routing: its windows travel one by one to the bucket of their own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlake.llm.common import few_by_rank, stored, zstd_dictionary

#: Words handled at a time; places within fit the low bits of a minimiser.
WORDS_AT_ONCE = 400_000
PLACE_BITS = 20
#: Bytes of runs that a task gathers before it packs them by bucket, that a bucket should have, and that it sorts at a time.
PACK_BYTES = 24 << 20
BUCKET_BYTES = 48 << 20
SHARE_BYTES = 12 << 20
PACK_LEVEL = 5
SPAN = "array<struct<start:int,n:int>>"


class _Hashes(dict):
    """Hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word)
        return got


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolled(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words."""
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[i:i + len(out)]
    return _mixed(out)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each ``n`` neighbours."""
    width = 1
    while 2 * width <= n:
        x, width = np.minimum(x[:len(x) - width], x[width:]), 2 * width
    rest = n - width
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


class Piece:
    """Words of some documents in a row, with where each word comes from."""

    def __init__(self):
        self.words, self.docs = [], []  # docs: (row, place of its first word here, start, number)

    def add(self, row: int, start: int, words: list[bytes]) -> None:
        self.docs.append((row, len(self.words), start, len(words)))
        self.words += words


def _pieces(texts: Iterator[tuple[int, bytes]], window: int) -> Iterator[Piece]:
    piece = Piece()
    for row, text in texts:
        words = text.split()
        for start in range(0, max(1, len(words) - window + 1), WORDS_AT_ONCE):
            part = words[start:start + WORDS_AT_ONCE + window - 1]
            if len(piece.words) + len(part) > WORDS_AT_ONCE + window and piece.words:
                yield piece
                piece = Piece()
            piece.add(row, start, part)
    if piece.words:
        yield piece


def _minimisers(piece: Piece, window: int, mer: int, hashes: _Hashes):
    """Starts of all windows within a document, their minimiser with its place, and the words' hashes."""
    ids = np.fromiter(map(hashes.__getitem__, piece.words), np.uint64, len(piece.words))
    if len(ids) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), ids
    mers = _rolled(ids, mer)
    mers = (mers >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(mers), dtype=np.uint64)
    least = _least(mers, window - mer + 1)
    inside = np.zeros(len(least), bool)
    for _, first, _, n in piece.docs:
        inside[first:max(first, first + n - window + 1)] = True
    at = np.flatnonzero(inside)
    return at, least[at], ids


def _runs(piece: Piece, window: int, mer: int, hot: np.ndarray, hashes: _Hashes):
    """First window, number of windows, and group of each super-k-mer."""
    at, least, ids = _minimisers(piece, window, mer, hashes)
    if not len(at):
        return at, at, least
    group = least >> np.uint64(PLACE_BITS)
    alone = np.isin(group, hot)
    opens = np.r_[True, (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)] | alone
    first = np.flatnonzero(opens)
    n = np.diff(np.r_[first, len(at)])
    group = group[first]
    if alone.any():
        own = alone[first]
        group[own] = _rolled(ids, window)[at[first[own]]]
    return at[first], n, group


def _coder(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, **_known(dictionary))


def _known(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def _joined(parts: list) -> bytes:
    return b"".join(x if isinstance(x, bytes) else x.tobytes() for x in parts)


def _columns(raw: bytes, at: int, kinds: list[tuple]) -> tuple[list[np.ndarray], int]:
    out = []
    for kind, size in kinds:
        out.append(np.frombuffer(raw, kind, size, at))
        at += out[-1].nbytes
    return out, at


def _flushed(found: list[tuple], buckets: int, coder: zstandard.ZstdCompressor, salt: int):
    """(bucket, bytes of runs, packed runs, packed repeats) of what a task has gathered.

    Of a run's places only the earliest goes to the bucket of its minimiser, with what ties with it. The
    others are repeats already; they are packed by themselves and may go anywhere.
    """
    group, words, none, doc, key, start = (np.concatenate(x) for x in list(zip(*found))[1:])
    lookup: dict[bytes, int] = {}
    run = np.array([lookup.setdefault(r, len(lookup)) for part in found for r in part[0]], np.int64)
    order = np.lexsort((key, start, doc, none, run))
    run, group, words, none, doc, key, start = (x[order] for x in (run, group, words, none, doc, key, start))
    new = np.r_[True, run[1:] != run[:-1]]
    first = np.flatnonzero(new)[run]
    tied = (none == none[first]) & (doc == doc[first]) & (start == start[first])
    same = ~new & np.r_[False, (none[1:] == none[:-1]) & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1]) & (key[1:] == key[:-1])]
    if not tied.all():
        late = ~tied & ~same
        raw = _joined([x[late] for x in (none, doc, key, start, words.astype(np.int32))])
        yield int(_mixed(np.array([salt], np.uint64))[0] % np.uint64(buckets)), 0, None, coder.compress(raw)
    runs = list(lookup)
    kept = np.flatnonzero(tied & ~same)
    run, group, none, doc, key, start = (x[kept] for x in (run, group, none, doc, key, start))
    bucket = (_mixed(group) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        part = order[a:b]
        distinct, at, place = np.unique(run[part], return_index=True, return_inverse=True)
        mine = [runs[i] for i in distinct.tolist()]
        raw = _joined([np.array([len(mine), len(part)], np.int32), group[part][at], np.array([len(r) for r in mine], np.int32),
                       place.astype(np.int32), none[part], doc[part], key[part], start[part], *mine])
        yield int(bucket[part[0]]), sum(map(len, mine)), coder.compress(raw), None


def _unpacked(raw: bytes):
    """(group, begin, end in ``raw``) of the distinct runs and (run, none, doc, key, start) of the entries."""
    n_runs, n = np.frombuffer(raw, np.int32, 2).tolist()
    (group, length, *entries), at = _columns(raw, 8, [
        (np.uint64, n_runs), (np.int32, n_runs), (np.int32, n), (np.bool_, n), (np.int64, n), (np.int64, n), (np.int32, n)])
    ends = at + np.cumsum(length, dtype=np.int64)
    return group, ends - length, ends, entries


def _repeats(raw: bytes) -> dict[str, np.ndarray]:
    n = len(raw) // 25
    (none, doc, key, start, words), _ = _columns(raw, 0, [(np.bool_, n), (np.int64, n), (np.int64, n), (np.int32, n), (np.int32, n)])
    return {"none": none, "doc": doc, "key": key, "start": start, "n": words}


def _entries(batches: Iterator[pa.RecordBatch], window: int, mer: int, buckets: int, hot: np.ndarray, dictionary: bytes,
             task: int = 0):
    """(bucket, bytes of runs, packed runs, packed repeats) of the rows (doc, key, text) of a task."""
    hashes, coder, found, size, salt = _Hashes(), _coder(dictionary, PACK_LEVEL), [], 0, task << 20
    for batch in batches:
        docs = batch.column(0)
        none, ids = docs.is_null().to_numpy(zero_copy_only=False), docs.fill_null(0).to_numpy()
        keys, seen = batch.column(1).to_numpy(), set()

        def texts(batch=batch, none=none, ids=ids, keys=keys, seen=seen):
            for row, text in enumerate(batch.column(2).cast(pa.large_binary()).to_pylist()):
                same = (none[row], ids[row], keys[row])
                if text and same not in seen:
                    seen.add(same)
                    yield row, text

        for piece in _pieces(texts(), window):
            at, n, group = _runs(piece, window, mer, hot, hashes)
            if not len(at):
                continue
            length = np.fromiter(map(len, piece.words), np.int64, len(piece.words))
            joined, ends = b" ".join(piece.words), np.cumsum(length + 1) - 1
            left, right = (ends - length)[at], ends[at + n + window - 2]
            row, first, start, _ = (np.array(x) for x in zip(*piece.docs))
            doc = np.searchsorted(first, at, "right") - 1
            begin, row = (start[doc] + at - first[doc]).astype(np.int32), row[doc]
            found.append(([joined[a:b] for a, b in zip(left.tolist(), right.tolist())], group, n + window - 1, none[row], ids[row],
                          keys[row], begin))
            size += int((right - left).sum())
            if size >= PACK_BYTES:
                yield from _flushed(found, buckets, coder, salt)
                found, size, salt = [], 0, salt + 1
    if found:
        yield from _flushed(found, buckets, coder, salt)


def _later(held: list[bytes], window: int, part: int = 0, parts: int = 1) -> dict[str, np.ndarray] | None:
    """Spans of words of a bucket's packs that lie in windows which also start earlier; of ``parts`` shares of its groups one."""
    lookup: dict[bytes, int] = {}
    columns: list[list] = [[] for _ in range(6)]
    for raw in held:
        group, begin, end, (run, *rest) = _unpacked(raw)
        mine = (_mixed(group) >> np.uint64(32)) % np.uint64(parts) == part
        place = np.full(len(group), -1)
        place[mine] = [lookup.setdefault(raw[a:b], len(lookup)) for a, b in zip(begin[mine].tolist(), end[mine].tolist())]
        taken = mine[run]
        for column, x in zip(columns, (place[run], group[run], *rest)):
            column.append(x[taken])
    if not lookup:
        return None
    run, group, none, doc, key, start = (np.concatenate(x) for x in columns)
    order = np.lexsort((key, start, doc, none, run))
    run, group, none, doc, key, start = (x[order] for x in (run, group, none, doc, key, start))
    new = np.r_[True, (run[1:] != run[:-1]) | (none[1:] != none[:-1]) | (doc[1:] != doc[:-1])
                | (start[1:] != start[:-1]) | (key[1:] != key[:-1])]
    run, group, none, doc, key, start = (x[new] for x in (run, group, none, doc, key, start))
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])   # run i is at first[i]
    head = first[run]
    whole = (none != none[head]) | (doc != doc[head]) | (start != start[head])
    texts = list(lookup)
    words = np.array([t.count(b" ") + 1 for t in texts])
    found = [np.flatnonzero(whole), np.zeros(int(whole.sum()), np.int64), words[run[whole]]]

    # where runs differ but share a group: sort their windows
    by_group = np.argsort(group[first], kind="stable")
    cuts = np.flatnonzero(np.diff(group[first][by_group].astype(np.uint64), prepend=np.uint64(0)) != 0)
    cuts = np.unique(np.r_[0, cuts, len(by_group)])
    rank = np.zeros(len(first), np.int64)
    ids = np.lexsort((doc[first], none[first]))
    rank[ids] = np.cumsum(np.r_[0, (np.diff(doc[first][ids]) != 0) | (np.diff(none[first][ids].astype(int)) != 0)])
    place = (rank << 32) + start[first]
    hits = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a < 2:
            continue
        windows = []
        for r in by_group[a:b].tolist():
            text, at = texts[r], int(place[r])
            words_of = text.split(b" ")
            left = 0
            right = len(b" ".join(words_of[:window]))
            for j in range(len(words_of) - window + 1):
                windows.append((text[left:right], at + j, r, j))
                left += len(words_of[j]) + 1
                if j + window < len(words_of):
                    right += len(words_of[j + window]) + 1
        windows.sort()
        same, least = None, 0
        for text, at, r, j in windows:
            if text != same:
                same, least = text, at
            elif at > least:
                hits.append((r, j))
    if hits:
        r, j = np.array(sorted(hits)).T
        opens = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (j[1:] != j[:-1] + 1)])
        n = np.diff(np.r_[opens, len(r)])
        r, j = r[opens], j[opens]
        # every entry that ties with the first of its run has these spans
        tied = np.flatnonzero(~whole)
        lo, hi = np.searchsorted(run[tied], r), np.searchsorted(run[tied], r, "right")
        times = hi - lo
        entry = tied[np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        found = [np.r_[found[0], entry], np.r_[found[1], np.repeat(j, times)],
                 np.r_[found[2], np.repeat(n + window - 1, times)]]
    at, offset, n = found
    if not len(at):
        return None
    return {"none": none[at], "doc": doc[at], "key": key[at],
            "start": (start[at] + offset).astype(np.int32), "n": n.astype(np.int32)}


def hot_minimisers(docs: DataFrame, window: int, mer: int, share: float, one_in: int, n: int) -> np.ndarray:
    """Minimisers found in more than ``share`` of the ``n`` documents of a sample, one of ``one_in`` by digest.

    At most (windows per document) / ``share`` values; they change the route of windows, not results.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            texts = batch.column(0).cast(pa.large_binary()).to_pylist()
            for text in texts:
                for piece in _pieces(iter([(0, text)]), window):
                    least = _minimisers(piece, window, mer, hashes)[1] >> np.uint64(PLACE_BITS)
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(least).view(np.int64))], ["m"])

    least = max(20, int(share * n))
    found = (docs.filter(_sampled(one_in)).select("text").mapInArrow(run, "m long").groupBy("m").count()
             .filter(F.col("count") > least).select("m").collect()) if n >= least else []
    return np.array([r.m for r in found], np.int64).view(np.uint64)


def _sampled(one_in: int) -> Column:
    return F.col("text").isNotNull() & (F.pmod(F.xxhash64("text", "doc"), F.lit(one_in)) == 0)


def learned_dictionary(docs: DataFrame, one_in: int, n: int, samples: int = 1024, excerpt: int = 4096) -> bytes:
    """A Zstandard dictionary for small packs, from at most ``samples`` excerpts of the ``n`` texts of the sample.

    It changes sizes, not results.
    """
    start = F.pmod("rank", F.greatest(F.length("text") - excerpt, F.lit(0)) + 1) + 1
    found = (few_by_rank(docs.filter(_sampled(one_in)).select(F.xxhash64("doc", "text").alias("rank"), "text"), n, samples)
             .select("rank", F.substr("text", start.cast("int"), F.lit(excerpt)).alias("cut")).orderBy("rank", "cut").limit(samples))
    return zstd_dictionary([r["cut"].encode() for r in found.collect()], 112 << 10)


@dataclass(frozen=True)
class Layout:
    """What the whole input decides before the work: number of buckets, hot minimisers, dictionary of packs."""

    buckets: int
    hot: np.ndarray
    dictionary: bytes


def layout(docs: DataFrame, window: int, mer: int, share: float = 0.01, one_in: int = 64, buckets: int | None = None) -> Layout:
    """The layout for ``docs`` (doc, key, text): as many buckets as keep their runs near ``BUCKET_BYTES`` each."""
    n, size = docs.agg(F.count_if(_sampled(one_in)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # a super-k-mer of w windows has w + window - 1 words; w is about half of the mers in a window
    runs = size * (1 + 2 * (window - 1) / (window - mer + 2))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Layout(buckets or max(least, int(runs // BUCKET_BYTES) + 1), hot_minimisers(docs, window, mer, share, one_in, n),
                  learned_dictionary(docs, one_in, n))


def repeated_spans(docs: DataFrame, window: int = 20, mer: int = 3, plan: Layout | None = None) -> DataFrame:
    """(doc, key, spans): the words of ``docs`` (doc long, key long, text) in windows that start earlier too.

    Earlier: in a row of smaller ``doc`` (null counts as greatest), or of the same ``doc`` at a
    smaller start. Rows equal in all three columns are one. Spans may overlap. Null, empty and short texts have none.
    """
    plan = plan or layout(docs, window, mer)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for bucket, size, runs, late in _entries(batches, window, mer, plan.buckets, plan.hot, plan.dictionary, task):
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([size], pa.int64()), pa.array([runs], pa.binary()),
                 pa.array([late], pa.binary())], ["bucket", "size", "runs", "late"])

    def rows(got: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(got["doc"], mask=got["none"]), *(pa.array(got[k]) for k in ("key", "start", "n"))],
                                          ["doc", "key", "start", "n"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdDecompressor(**_known(plan.dictionary))
        bucket, held, size = None, [], 0

        def found():
            parts = 1 + size // SHARE_BYTES
            for part in range(parts if held else 0):
                got = _later(held, window, part, parts)
                if got:
                    yield rows(got)

        for batch in batches:
            for at, more, runs, late in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if late.is_valid:
                    yield rows(_repeats(coder.decompress(late.as_py())))
                    continue
                if at != bucket:
                    yield from found()
                    bucket, held, size = at, [], 0
                held.append(coder.decompress(runs.as_py()))
                size += more
        yield from found()

    spans = (docs.select("doc", "key", "text").mapInArrow(pack, "bucket int, size long, runs binary, late binary")
             .repartition(plan.buckets, "bucket").sortWithinPartitions("bucket")
             .mapInArrow(find, "doc long, key long, start int, n int"))
    return spans.groupBy("doc", "key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def without_repeats(docs: DataFrame, window: int = 20, mer: int = 3) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and kept_sha256 of each row of ``docs`` (doc_id, text).

    Null, blank and short texts have no windows; a null ``doc_id`` counts as the greatest. Rows
    that repeat an id are compared by start alone, so equal rows are judged alike. Words are
    parted by ASCII white space and joined by one space; other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("key"), "text")
    plan = layout(rows, window, mer)
    spans = stored(repeated_spans(rows, window, mer, plan), "spans").withColumnRenamed("doc", "__doc")

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(plan.dictionary, 3)
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            packed = [x if x is None else coder.compress(x) for x in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc", "key", "packed"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdDecompressor(**_known(plan.dictionary))
        for batch in batches:
            out = []
            lists = batch.column(2)
            flat, ends = lists.flatten(), lists.offsets.to_numpy() if len(lists) else []
            if len(lists):
                ends = ends - ends[0]
            starts, lengths = (flat.field(i).to_numpy() for i in (0, 1))
            for i, packed in enumerate(batch.column(1).to_pylist()):
                words = coder.decompress(packed).split() if packed else []
                a, b = (ends[i], ends[i + 1])
                kept = words
                if b > a:
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, starts[a:b], 1)
                    np.add.at(cover, starts[a:b] + lengths[a:b], -1)
                    kept = [words[j] for j in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), joined, hashlib.sha256(joined).hexdigest()))
            n, gone, kept, digest = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digest, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    texts = rows.mapInArrow(small, "doc long, key long, packed binary")   # each text is packed for the way
    joined = texts.join(spans, (texts.key == spans.key) & texts.doc.eqNullSafe(spans["__doc"]), "left").select(
        "doc", "packed", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))
    return joined.mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
