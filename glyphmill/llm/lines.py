"""Near-duplicate lines of a corpus by an exact set-similarity join.

Each line is the set of its distinct lower-cased words, ordered by rarity.  Two sets with a Jaccard similarity at the
threshold must share one of the first few words in that order (prefix filter), at positions that leave room for
enough common words (positional filter), and must be about equally long (length filter).  What passes is also held
against parity bitmaps, which bound the symmetric difference from below; then the full sets are compared.  None of
the filters can lose a pair, so the result is exact up to collisions of 56-bit word hashes within a line pair.

Rarity comes from a sketch of fixed size (counts of all the corpus's words in BUCKETS hash buckets): any total order
that is the same everywhere keeps the join exact, the counts only make it fast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import words as W
from glyphmill.llm.session import checkpointed, release, semi_by_size, tidy, Scratch

BUCKETS = 1 << 16
#: Distinct words of the smallest line that takes part.
MIN_WORDS = 1
#: Members of a word's group that are compared in one piece; larger groups are cut into pairs of tiles.
TILE = 2048
#: One of so many classes of equal lines is counted to find the groups that need tiles.
TILE_SAMPLE = 64
#: Candidates that a line meets in one group at first; where none of these is confirmed, all others follow.
FIRST = 32
#: Rows of document ids, or of digests, that may be broadcast.
BROADCAST_ROWS = 200_000
#: Line numbers with their document ids (about 60 bytes each) that may be broadcast.
BROADCAST_LINES = 1_000_000
#: Bits of the parity bitmaps that pairs are held against before their sets are fetched.
WIDE = 512


def need(percent: int, n, m):
    """Common words that sets of ``n`` and ``m`` need for the threshold: ceil(t / (1 + t) * (n + m))."""
    return -((-percent * (n + m)) // (100 + percent))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for chunk in W.chunks(batch.column(0)):
            count += np.bincount((W.words(chunk.text, W.NON_SPACE).hashes >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
    full = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(count[full])], ["bucket", "n"])


def rarity(docs: DataFrame) -> np.ndarray:
    """A class of 0 (rare) to 255 for each of BUCKETS buckets of words; BUCKETS rows at most reach the driver."""
    rows = docs.select(F.col("text").cast("string")).mapInArrow(tidy(_sketch), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(BUCKETS, dtype=np.float64)
    for bucket, n in rows:
        count[bucket] = n
    return np.minimum(255, np.log2(count + 1) * 6).astype(np.uint8)


class LineSets:
    """The sets of the lines of a chunk: ``keys`` in order of rarity within each line, ``starts`` and sizes ``n``."""

    def __init__(self, chunk: W.Chunk, rare: np.ndarray):
        found = W.words(chunk.text, W.NON_SPACE)
        ends = np.flatnonzero(chunk.text == 10)
        line = np.searchsorted(ends, found.starts)
        key = (rare[(found.hashes >> np.uint64(48)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (found.hashes >> np.uint64(8))
        # One sort by line and the first bits of the key; the rare chunk where these don't tell keys apart is sorted in full.
        order = np.argsort((line.astype(np.uint64) << np.uint64(44)) | (key >> np.uint64(20))) if len(ends) < 1 << 20 else np.lexsort((key, line))
        if not ((key[order][1:] >= key[order][:-1]) | (line[order][1:] != line[order][:-1])).all():
            order = np.lexsort((key, line))
        line, key = line[order], key[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        line, self.keys = line[new], key[new]
        first = np.ones(len(line), dtype=bool)
        first[1:] = line[1:] != line[:-1]
        self.starts = np.flatnonzero(first)
        self.n = np.diff(np.append(self.starts, len(line)))
        line = line[self.starts]
        before = np.searchsorted(ends, chunk.bounds[:-1])
        self.doc = np.searchsorted(before, line, "right") - 1
        self.line_no = line - before[self.doc]

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts) if len(self.starts) else values

    def xors(self, values: np.ndarray) -> np.ndarray:
        return np.bitwise_xor.reduceat(values, self.starts) if len(self.starts) else values


def _line_rows(rare: np.ndarray, percent: int, least: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch.column(1)):
                s = LineSets(chunk, rare)
                own = W.mix(s.keys)
                bits = s.xors(np.uint64(1) << (own >> np.uint64(58)))
                # Where n of n + 1 words are below the threshold only an equal set can match, and that needs no prefix.
                joins = (s.n >= least) & (100 * s.n >= percent * (s.n + 1))
                prefix = np.where(joins, s.n - (percent * s.n + 99) // 100 + 1, 0)
                place = np.arange(len(s.keys)) - np.repeat(s.starts, s.n)
                tokens = s.keys[place < np.repeat(prefix, s.n)]
                used = s.n >= least
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(prefix[used])), pa.int32()), pa.array(tokens.view(np.int64)))
                ids = batch.column(0).slice(chunk.first).take(pa.array(s.doc[used]))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(s.line_no[used].astype(np.int32)), pa.array(s.sums(own)[used].view(np.int64)), pa.array(s.sums(W.mix(own))[used].view(np.int64)), pa.array(s.n[used].astype(np.int32)), pa.array(bits[used].view(np.int64)), lists],
                    ["doc_id", "line_no", "d1", "d2", "n", "bits", "prefix"],
                )

    return of


_LINE_ROWS = "doc_id long, line_no int, d1 long, d2 long, n int, bits long, prefix array<long>"
_PAIRS = "a_doc long, a_line int, b_doc long, b_line int"


class _Group:
    """Columns of rows sorted by token, tiles and n; whole groups only.  Without tiles, or targets, all is one tile, or target.

    ``stop``: the row up to which those behind a row are in its group and not too long for it; ``left``: words from a
    row's token on; ``least``: common words needed, by the sum of two sizes.
    """

    def __init__(self, table: pa.Table, percent: int):
        self.token, self.doc, self.line, self.bits, at = (table.column(x).to_numpy() for x in ("token", "doc_id", "line_no", "bits", "at"))
        self.target = table.column("target").to_numpy() if "target" in table.column_names else None
        self.bits = self.bits.view(np.uint64)
        self.n = at >> 32
        self.left = self.n - (at & 0xFFFFFFFF)
        changed = self.token[1:] != self.token[:-1]
        self.tile = None
        if "i" in table.column_names:
            i, j = table.column("i").to_numpy(), table.column("j").to_numpy()
            changed |= (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            self.tile, self.apart = table.column("tile").to_numpy(), i != j
        group = np.append(0, np.cumsum(changed))
        self.stop = np.searchsorted((group << 32) | self.n, (group << 32) | np.minimum(100 * self.n // percent, (1 << 32) - 1), "right")
        self.sums = need(percent, np.arange(2 * int(self.n.max(initial=0)) + 1), 0) if self.n.max(initial=0) < 1 << 22 else None
        self.percent = percent

    def least(self, sums: np.ndarray) -> np.ndarray:
        return need(self.percent, sums, 0) if self.sums is None else self.sums[sums]


def _candidates(table: pa.Table, percent: int, most: int) -> pa.RecordBatch:
    """Pairs of an earlier and a later line that pass all filters; a row with no earlier line where ``most`` were full."""
    g = _Group(table, percent)
    rows = len(g.n)
    met = np.zeros(rows, dtype=np.int64)
    early, late = [], []
    over = np.zeros(rows, dtype=bool)
    active = np.arange(rows)
    step = 1
    while len(active):
        active = x = active[active + step < g.stop[active]]
        y = x + step  # n[x] <= n[y]
        sums = g.n[x] + g.n[y]
        least = g.least(sums)
        fit = np.minimum(g.left[x], g.left[y]) >= least
        if g.tile is not None:
            fit &= ~g.apart[x] | (g.tile[x] != g.tile[y])
        x, y, room = x[fit], y[fit], (sums - 2 * least)[fit]
        fit = np.bitwise_count(g.bits[x] ^ g.bits[y]) <= room
        x, y = x[fit], y[fit]
        first = (g.doc[x] < g.doc[y]) | ((g.doc[x] == g.doc[y]) & (g.line[x] < g.line[y]))
        x, y = np.where(first, x, y), np.where(first, y, x)
        fit = (g.doc[x] != g.doc[y]) | (g.line[x] != g.line[y])  # repeated rows are no pair
        if g.target is not None:
            fit &= g.target[y]
        x, y = x[fit], y[fit]
        if most:
            order = np.argsort(y, kind="stable")  # a target occurs twice at most in a step
            x, y = x[order], y[order]
            room = met[y] < most
            over[y[~room]] = True
            x, y = x[room], y[room]
            np.add.at(met, y, 1)
        early.append(x)
        late.append(y)
        step += 1
    full = np.flatnonzero(over)
    x, y = np.concatenate([*early, full[:0]]), np.concatenate([*late, full])
    gone = pa.array(np.arange(len(y)) >= len(x))
    pad = np.concatenate([x, full])
    null = lambda values, kind: pc.if_else(gone, pa.scalar(None, kind), pa.array(values, kind))
    return pa.RecordBatch.from_arrays([null(g.doc[pad], pa.int64()), null(g.line[pad], pa.int32()), pa.array(g.doc[y], pa.int64()), pa.array(g.line[y], pa.int32())], ["a_doc", "a_line", "b_doc", "b_line"])


def _join_groups(percent: int, most: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [x for x in ("token", "i", "j") if x in batch.schema.names]
            keys = [batch.column(x).to_numpy() for x in names]
            changed = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
            same = kept and all(kept[-1].column(x)[-1] == batch.column(x)[0] for x in names)
            cut = int(changed[-1]) + 1 if len(changed) else 0
            if cut or (kept and not same):
                yield _candidates(pa.Table.from_batches([*kept, batch.slice(0, cut)]) if cut else pa.Table.from_batches(kept), percent, most)
                kept = []
            kept.append(batch.slice(cut))
        if kept:
            yield _candidates(pa.Table.from_batches(kept), percent, most)

    return of


def _candidate_pairs(postings: DataFrame, hot: DataFrame, percent: int, most: int) -> DataFrame:
    """``postings(token, doc_id, line_no, bits, at, target)`` dealt by token, and by pairs of tiles where hot."""
    if not hot.limit(1).count():
        return postings.repartition("token").sortWithinPartitions("token", "at").mapInArrow(tidy(_join_groups(percent, most)), _PAIRS).distinct()
    joined = semi_by_size(postings, hot, "token", "left", BROADCAST_ROWS).withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    placed = joined.withColumn("tile", F.pmod(F.xxhash64("doc_id", "line_no"), F.col("tiles")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")})
    dealt = dealt.drop("tiles", "other")
    return dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "at").mapInArrow(tidy(_join_groups(percent, most)), _PAIRS).distinct()


def _wanted_sets(rare: np.ndarray):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch.column(1)):
                ends = np.flatnonzero(chunk.text == 10)
                n = len(chunk.bounds) - 1
                wanted = batch.column(2).slice(chunk.first, n)
                doc = np.repeat(np.arange(n), pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
                number = wanted.flatten().to_numpy(zero_copy_only=False)
                first = np.searchsorted(ends, chunk.bounds)
                there = first[doc] + number < first[doc + 1]  # rows that share a doc_id may have fewer lines
                doc, number = doc[there], number[there]
                line = first[doc] + number
                begins, stops = np.append(0, ends[:-1] + 1)[line], ends[line] + 1
                text = np.frombuffer(b"".join(chunk.text[a:b].tobytes() for a, b in zip(begins, stops)), dtype=np.uint8)
                s = LineSets(W.Chunk(0, text, np.append(0, np.cumsum(stops - begins))), rare)
                sets = [s.keys[a : a + k].tobytes() for a, k in zip(s.starts.tolist(), s.n.tolist())]
                ids = batch.column(0).slice(chunk.first).take(pa.array(doc[s.doc]))
                own = W.mix(s.keys) >> np.uint64(64 - 9)
                parity = np.zeros((len(sets), WIDE), dtype=np.uint8)
                np.bitwise_xor.at(parity, (np.repeat(np.arange(len(sets)), s.n), own.astype(np.int64)), 1)
                bits = np.packbits(parity, axis=1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(number[s.doc], pa.int32()), pa.array(sets, pa.binary()), pa.array([x.tobytes() for x in bits], pa.binary())], ["doc_id", "line_no", "members", "bits"])

    return of


def _possible(percent: int):
    """Pairs whose bitmaps leave room for the threshold."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1) for x in ("x", "y"))
                n, m = (batch.column(x).to_numpy() for x in ("n", "m"))
                apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
                yield batch.select(["a_doc", "a_line", "b_doc", "b_line"]).filter(pa.array(apart <= n + m - 2 * need(percent, n, m)))

    return of


def _verified(percent: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                place = np.searchsorted(b, a)
                place[place == len(b)] = 0
                both = int((b[place] == a).sum())
                out.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(out, pa.bool_()))

    return of


def removed_lines(docs: DataFrame, percent: int = 85, least: int = MIN_WORDS) -> DataFrame:
    """``doc_id, line_no`` (from 0) of the lines of ``docs(doc_id, text)`` that some earlier line matches.

    Lines are ordered by doc_id, then line_no.  A line goes if any earlier line, itself removed or not, has
    ``100 * |A and B| >= percent * |A or B|`` on the sets of distinct words (white space apart, A-Z lowered).

    - Lines of fewer than ``least`` (1 or more) distinct words never match; null and empty texts have no lines that do.
    - Equal lines are one class (the first stays) before any pair is made, however many there are; sets too small to
      match any but an equal one (at 85 %: up to five words) are settled by that alone.
    - Rows that share a doc_id share line numbers: a number that goes is gone from each of them, and equal rows keep
      what one of them would.
    - Rows with a null doc_id take no part.  An empty table gives no rows.
    """
    if not 80 <= percent <= 100:
        raise ValueError("the similarity is 80 % or more")
    if least < 1:
        raise ValueError("a line without words matches nothing")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)  # and batches are bounded from here on
    rare = rarity(docs)
    lines = scratch.table(docs.mapInArrow(tidy(_line_rows(rare, percent, least)), _LINE_ROWS), "lines")
    key = F.struct("doc_id", "line_no")
    classes = lines.groupBy("d1", "d2").agg(F.min(key).alias("key"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    # Lines that repeat their class's first line; with repeated rows also that line itself, once.
    same = semi_by_size(lines.select("d1", "d2", "doc_id", "line_no", (F.size("prefix") > 0).alias("joins")), checkpointed(classes), ["d1", "d2"], "inner", BROADCAST_ROWS)
    repeated = checkpointed(same.where(key != F.col("key")).groupBy("doc_id", "line_no").agg(F.max("joins").alias("joins")))
    release(spark)
    first = lambda *names: [F.first(x).alias(x) for x in names]

    # Only lines that have a prefix need to be kept out of the join.
    joining, repeated = repeated.where("joins").drop("joins"), repeated.drop("joins")
    few = joining.count() <= BROADCAST_LINES

    def tokens_of(some: DataFrame) -> DataFrame:
        """Prefixes of one line of each class: without the known others if these are few, else by aggregation."""
        some = some.where(F.size("prefix") > 0)
        if few:
            kept = some.join(F.broadcast(joining), ["doc_id", "line_no"], "left_anti").withColumn("key", key)
        else:
            kept = some.groupBy("d1", "d2").agg(F.min(key).alias("key"), *first("n", "bits", "prefix"))
        return kept.select(F.posexplode("prefix").alias("pos", "token"), F.col("key.doc_id").alias("doc_id"), F.col("key.line_no").alias("line_no"), "bits", "n")

    postings = tokens_of(lines).select("token", "doc_id", "line_no", "bits", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")).alias("at"))
    # How many tiles a word's group is cut into decides nothing but the layout, so it is read off a sample of classes.
    sample = tokens_of(lines.where(F.pmod("d1", F.lit(TILE_SAMPLE)) == 0))
    hot = checkpointed(sample.groupBy("token").agg(F.ceil(F.count("*") * TILE_SAMPLE / TILE).cast("int").alias("tiles")).where("tiles > 1"))
    first_pairs = checkpointed(_candidate_pairs(postings, hot, percent, FIRST))
    release(spark)
    met = first_pairs.where("a_doc is not null")
    # One match is enough for a line: at first its earliest candidate, then all others of those that are left.
    best = checkpointed(met.groupBy("b_doc", "b_line").agg(F.min(F.struct("a_doc", "a_line")).alias("a")).select("a.*", "b_doc", "b_line"))
    near = checkpointed(_verify(best, docs, rare, percent))
    left = checkpointed(met.join(near.toDF("b_doc", "b_line"), ["b_doc", "b_line"], "left_anti").join(best, ["a_doc", "a_line", "b_doc", "b_line"], "left_anti"))
    if left.limit(1).count():
        near = checkpointed(near.union(_verify(left, docs, rare, percent)))
    # Lines that met FIRST candidates in some group, none of which held: now all candidates of these.
    open_ = checkpointed(first_pairs.where("a_doc is null").select(F.col("b_doc").alias("doc_id"), F.col("b_line").alias("line_no")).distinct().join(near, ["doc_id", "line_no"], "left_anti"))
    if open_.limit(1).count():
        words_of = postings.join(F.broadcast(open_) if open_.count() <= BROADCAST_LINES else open_, ["doc_id", "line_no"], "left_semi")
        wanted = checkpointed(words_of.select("token").distinct())
        flagged = semi_by_size(postings, wanted, "token", "left_semi", BROADCAST_LINES)
        flagged = semi_by_size(flagged, open_.withColumn("target", F.lit(True)), ["doc_id", "line_no"], "left", BROADCAST_LINES).withColumn("target", F.coalesce("target", F.lit(False)))
        rest = _candidate_pairs(flagged.select("token", "doc_id", "line_no", "bits", "at", "target"), hot, percent, 0)
        near = near.union(_verify(checkpointed(rest.join(met, ["a_doc", "a_line", "b_doc", "b_line"], "left_anti")), docs, rare, percent))
    gone = checkpointed(near.union(repeated).distinct())
    scratch.drop()
    release(spark)
    return gone


def _verify(pairs: DataFrame, docs: DataFrame, rare: np.ndarray, percent: int) -> DataFrame:
    """The later lines of those pairs that hold on the full sets."""
    ends = pairs.select(F.col("a_doc").alias("doc_id"), F.col("a_line").alias("line_no")).union(pairs.select("b_doc", "b_line")).distinct()
    wanted = checkpointed(ends.groupBy("doc_id").agg(F.collect_list("line_no").alias("wanted")))
    taken = docs.join(F.broadcast(wanted) if _few(wanted, "wanted") else wanted, "doc_id").select("doc_id", "text", "wanted")
    sets = checkpointed(taken.mapInArrow(tidy(_wanted_sets(rare)), "doc_id long, line_no int, members binary, bits binary").distinct())
    side = lambda k, of, name: sets.select(F.col("doc_id").alias(f"{k}_doc"), F.col("line_no").alias(f"{k}_line"), F.col(of).alias(name), F.octet_length("members").cast("long").alias(f"{name}_bytes"))
    near = pairs.join(side("a", "bits", "x"), ["a_doc", "a_line"]).join(side("b", "bits", "y"), ["b_doc", "b_line"])
    near = near.select("a_doc", "a_line", "b_doc", "b_line", "x", "y", F.expr("x_bytes div 8").alias("n"), F.expr("y_bytes div 8").alias("m")).mapInArrow(tidy(_possible(percent)), _PAIRS).distinct()
    full = near.join(side("a", "members", "x"), ["a_doc", "a_line"]).join(side("b", "members", "y"), ["b_doc", "b_line"]).select("b_doc", "b_line", "x", "y")
    return full.mapInArrow(tidy(_verified(percent)), "doc_id long, line_no int").distinct()


def _few(rows: DataFrame, lists: str) -> bool:
    """Whether ids with lists of line numbers are few enough to be broadcast: BROADCAST_ROWS rows, BROADCAST_LINES numbers."""
    n, numbers = rows.agg(F.count("*"), F.sum(F.size(lists))).first()
    return n <= BROADCAST_ROWS and (numbers or 0) <= BROADCAST_LINES


def dedup_lines(docs: DataFrame, percent: int = 85, least: int = 5) -> DataFrame:
    """All columns of ``docs``, ``text`` without its removed lines, and ``n_lines, removed_lines`` (sorted numbers).

    Lines of fewer than ``least`` distinct words all stay; with MIN_WORDS, as op3 and the pipeline call it, none do for
    that.  Lines that stay keep their order and bytes.  Null texts stay null, with ``n_lines`` 0; see ``removed_lines`` for
    other cases.  Columns of ``docs`` named ``n_lines`` or ``removed_lines`` are replaced.
    """
    gone = checkpointed(removed_lines(docs, percent, least).groupBy("doc_id").agg(F.sort_array(F.collect_list("line_no")).alias("removed_lines")).withColumnRenamed("doc_id", "_line_doc"))
    docs = docs.drop("n_lines", "removed_lines")
    joined = docs.join(F.broadcast(gone) if _few(gone, "removed_lines") else gone, F.col("doc_id").cast("long") == F.col("_line_doc"), "left").drop("_line_doc")
    all_lines = F.split("text", "\n", -1)
    numbers = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("removed_lines"))
    # The lines are split once, as the one element of an array.
    stay = F.element_at(F.transform(F.array(all_lines), lambda every: F.array_join(F.transform(numbers, lambda i: F.get(every, i)), "\n")), 1)
    return (
        joined.withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<int>")))
        .withColumn("n_lines", F.coalesce(1 + F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.size("removed_lines") > 0, stay).otherwise(F.col("text")))
    )
