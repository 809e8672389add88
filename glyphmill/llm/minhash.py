"""Near-duplicate documents by b-bit MinHash.

Texts become sets of distinct five-word shingles (64-bit hashes).  PERMUTATIONS minima are grouped into bands for
candidates; only the low BITS bits of each minimum are kept and packed, and a pair's similarity is estimated from the
number of equal groups of bits, corrected for those equal by chance.  Pairs that the estimate leaves are confirmed on
the full sets.  Within a band only pairs with a pivot are made at first; once links have joined documents into
components, only members of different components are compared further, in tiles of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import words as W
from glyphmill.llm.graph import components
from glyphmill.llm.session import checkpointed, hot_keys, salted_join, semi_by_size, tidy

SIZE = 5
ROWS = 5
BANDS = 24
PERMUTATIONS = ROWS * BANDS
BITS = 4
#: A pair at the threshold is estimated below threshold - SLACK with a chance near 3e-7 (5 standard deviations).
SLACK = 0.17
#: Documents per tile side when a band's components are compared.
TILE = 512
#: Bits of the parity bitmaps, whose distance is at most the size of two sets' symmetric difference.
PARITY = 2048
#: Pairs that a document gives per band in each round of joining components; the last round gives all.
ROUNDS = (4, 32, 256, 0)
#: Members of a pivot that are confirmed in one task.
PIVOT_ROWS = 1000
#: Ids (8 bytes each) that may be broadcast.
BROADCAST_ROWS = 300_000

_A = np.random.default_rng(81).integers(1, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = np.random.default_rng(82).integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_BAND_ODD = np.random.default_rng(83).integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Equal groups of BITS bits in a byte of two signatures' XOR.
_EQUAL = np.array([(x < 16) + (x % 16 == 0) for x in range(256)], dtype=np.uint8)


def shingle_sets(chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of a chunk's documents, and the bounds of each document in them."""
    found = W.words(chunk.text, W.NON_SPACE)
    n = len(chunk.bounds) - 1
    at = np.searchsorted(found.starts, chunk.bounds)
    doc = np.repeat(np.arange(n), np.diff(at))
    all_of = W.shingles(found.hashes, SIZE)
    own = doc[: len(all_of)] == doc[SIZE - 1 :] if len(all_of) else np.zeros(0, bool)
    values, owner = all_of[own], doc[: len(all_of)][own]
    short = [i for i in np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < SIZE))]
    if short:
        made = np.concatenate([W.shingles(found.hashes[at[i] : at[i + 1]], int(at[i + 1] - at[i])) for i in short])
        values, owner = np.concatenate([values, made]), np.concatenate([owner, np.array(short)])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(n + 1))


def minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """PERMUTATIONS minima (uint32) of each of the non-empty runs that begin at ``starts``."""
    high = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), PERMUTATIONS), dtype=np.uint32)
    for k in range(PERMUTATIONS):
        out[:, k] = np.minimum.reduceat(high * _A[k] + _B[k], starts)
    return out


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, two to a byte."""
    low = (least & np.uint32(15)).astype(np.uint8)
    return low[:, 0::2] | (low[:, 1::2] << 4)


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, which also tells the band."""
    grouped = least.astype(np.uint64).reshape(len(least), BANDS, ROWS)
    return W.mix((grouped * _BAND_ODD).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def estimated(equal: np.ndarray) -> np.ndarray:
    """Similarity from counts of equal groups of bits, without those equal by chance."""
    chance = 0.5**BITS
    return (equal / PERMUTATIONS - chance) / (1 - chance)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in W.chunks(batch.column(1)):
            values, bounds = shingle_sets(chunk)
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            n = len(sizes)
            digests: list[bytes | None] = [None] * n
            keys: list[np.ndarray | None] = [None] * n
            bits: list[bytes | None] = [None] * n
            if len(full):
                least = minima(values, bounds[full])
                rows, bands = packed(least), band_keys(least).view(np.int64)
                for j, i in enumerate(full):
                    digests[i] = hashlib.blake2b(values[bounds[i] : bounds[i + 1]].tobytes(), digest_size=16).digest()
                    keys[i], bits[i] = bands[j], rows[j].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(chunk.first, n), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                ["doc_id", "n_shingles", "digest", "bands", "bits"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, digest`` of the whole set, ``bands`` and packed ``bits`` (null without shingles)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(_signatures), "doc_id long, n_shingles long, digest binary, bands array<long>, bits binary")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in W.chunks(batch.column(1)):
            values, bounds = shingle_sets(chunk)
            sets = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            parity = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                odd = np.bincount((values[a:b] >> np.uint64(64 - 11)).astype(np.int64), minlength=PARITY) & 1
                parity.append(np.packbits(odd.astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(sets)), pa.array(sets, pa.binary()), pa.array(parity, pa.binary())], ["id", "members", "parity"])


def _likely(least: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                equal = _EQUAL[a ^ b].sum(axis=1, dtype=np.int64)
                yield batch.select([0, 1]).filter(pa.array(estimated(equal) >= least))

    return of


def _confirmed(percent: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = (p, q) if len(p) <= len(q) else (q, p)
                if 100 * len(small) < percent * len(large):
                    linked.append(False)
                    continue
                place = np.searchsorted(large, small)
                place[place == len(large)] = 0
                both = int((large[place] == small).sum())
                linked.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select([0, 1]).append_column("linked", pa.array(linked, pa.bool_()))

    return of


def _bytes(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def _across(table: pa.Table, least: float, percent: int, most: int) -> pa.RecordBatch:
    """Likely pairs of different components within whole groups; up to ``most`` (0: all) for each row.

    A row of nulls says that some document had more.
    """
    band, i, j, tile, ids, component, n = (table.column(x).to_numpy() for x in ("band", "i", "j", "tile", "id", "component", "n_shingles"))
    bits, parity = _bytes(table.column("bits"), np.uint8), _bytes(table.column("parity"), np.uint64)
    met = np.zeros(len(ids), dtype=np.int64)
    more = False
    pairs = []
    active, step = np.arange(len(ids)), 1
    while len(active):
        active = active[active + step < len(ids)]
        x, y = active, active + step
        active = x = x[(band[x] == band[y]) & (i[x] == i[y]) & (j[x] == j[y])]
        y = x + step
        fit = (component[x] != component[y]) & ((i[x] == j[x]) | (tile[x] != tile[y]))
        x, y = x[fit], y[fit]
        # At the threshold, 100 * |A ^ B| <= (100 - percent) / (100 + percent) * 100 * (|A| + |B|).
        fit = estimated(_EQUAL[bits[x] ^ bits[y]].sum(axis=1, dtype=np.int64)) >= least
        x, y = x[fit], y[fit]
        apart = np.bitwise_count(parity[x] ^ parity[y]).sum(axis=1, dtype=np.int64)
        fit = apart * (100 + percent) <= (100 - percent) * (n[x] + n[y])
        x, y = x[fit], y[fit]
        if most:
            fit = (met[x] < most) & (met[y] < most)
            more |= not fit.all()
            x, y = x[fit], y[fit]
            np.add.at(met, x, 1)
            np.add.at(met, y, 1)
        pairs.append(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])]))
        step += 1
    a, b = np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1)
    return pa.RecordBatch.from_arrays([pa.array([*a.tolist(), *[None] * more], pa.int64()), pa.array([*b.tolist(), *[None] * more], pa.int64())], ["a", "b"])


def _across_groups(least: float, percent: int, most: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        names = ("band", "i", "j")
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(x).to_numpy() for x in names]
            changed = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
            cut = int(changed[-1]) + 1 if len(changed) else 0
            if kept and (cut or any(kept[-1].column(x)[-1] != batch.column(x)[0] for x in names)) or cut:
                yield _across(pa.Table.from_batches([*kept, batch.slice(0, cut)]), least, percent, most)
                kept = []
            kept.append(batch.slice(cut))
        if kept:
            yield _across(pa.Table.from_batches(kept), least, percent, most)

    return of


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``; other columns are ignored.

    Two documents are linked if ``100 * |A and B| >= percent * |A or B|`` on the full sets of their distinct 5-word
    shingles (fewer words: the whole sequence is one shingle).  ``component_id`` is the smallest doc_id reachable.

    A pair at 85 % shares no band, and so may be missed, with a chance of 8e-7 (at 80 %: 8e-5).

    - Null, empty or blank texts have an empty set: linked with nothing, kept, ``n_shingles`` 0.
    - Equal sets (repeated rows, exact copies) are one class before any pair is made.
    - Rows that share a doc_id are one node of the graph; each row returns with the size of its own set.
    - A null doc_id takes no part: ``component_id`` null, kept.
    - Very long texts are hashed in pieces; their sets are whole.  An empty table gives no rows.
    """
    if not 80 <= percent <= 100:
        raise ValueError("the bands are made for a similarity of 80 % or more")
    least = percent / 100 - SLACK
    sig = checkpointed(signatures(docs))
    classes = checkpointed(sig.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.max("bits").alias("bits")))
    reps = sig.where("doc_id is not null").select(F.col("doc_id").alias("id"), "digest", "bands").join(classes.select("id", "digest"), ["id", "digest"])
    keyed = reps.select("id", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("band")
    members = checkpointed(keyed.join(shared, "band").distinct())
    involved = checkpointed(members.select("id").distinct())
    bits = classes.select("id", "bits")
    sets = checkpointed(
        semi_by_size(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), involved.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi", BROADCAST_ROWS)
        .mapInArrow(tidy(_sets), "id long, members binary, parity binary")
        .where("length(members) > 0")
        .distinct()
    )

    def with_bits(pairs: DataFrame) -> DataFrame:
        pairs = checkpointed(pairs)
        full = salted_join(pairs, bits.select(F.col("id").alias("a"), F.col("bits").alias("x")), "a", hot_keys(pairs, "a")).join(bits.select(F.col("id").alias("b"), F.col("bits").alias("y")), "b")
        return full.select("a", "b", "x", "y").mapInArrow(tidy(_likely(least)), "a long, b long")

    def confirm(pairs: DataFrame) -> DataFrame:
        # A pivot's set goes to several tasks where it has many members.
        pairs = checkpointed(pairs)
        hot = hot_keys(pairs, "a", PIVOT_ROWS)
        full = salted_join(pairs, sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a", hot).join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
        tested = full.select("a", "b", "x", "y").mapInArrow(tidy(_confirmed(percent)), "a long, b long, linked boolean")
        return checkpointed(tested.groupBy("a", "b").agg(F.max("linked").alias("linked")))

    star = members.join(members.groupBy("band").agg(F.min("id").alias("a")), "band").where("id > a").select("a", F.col("id").alias("b")).distinct()
    tested = confirm(with_bits(star))
    found = components(tested.where("linked"))
    # Bands whose members are not yet all in one component: pairs across components, few at first, in the end all.
    held = classes.select("id", "bits").join(sets.select("id", "parity", F.expr("octet_length(members) div 8").cast("long").alias("n_shingles")), "id")
    for most in ROUNDS:
        placed = members.join(found, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
        spread = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).where("low < high")
        rest = placed.join(spread.select("band", "tiles"), "band").join(held, "id")
        dealt = rest.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        dealt = dealt.withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")}).drop("tiles", "other")
        pairs = checkpointed(dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(tidy(_across_groups(least, percent, most)), "a long, b long").distinct())
        new = checkpointed(pairs.where("a is not null").join(tested.select("a", "b"), ["a", "b"], "left_anti"))
        if new.limit(1).count():
            more = confirm(new)
            tested = tested.union(more)
            if more.where("linked").limit(1).count():
                found = components(tested.where("linked"))
        if not pairs.where("a is null").count():
            break
    placed = classes.select("digest", "id").join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("of"))
    nodes = components_of_ids(sig, placed)
    out = sig.select("doc_id", "n_shingles", "digest").join(nodes, "doc_id", "left") if nodes is not None else sig.join(placed, "digest", "left").withColumnRenamed("of", "component_id")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def components_of_ids(sig: DataFrame, placed: DataFrame) -> DataFrame | None:
    """Where one doc_id stands in several components, because rows share it, ``doc_id, component_id``; else None."""
    several = sig.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not several.limit(1).count():
        return None
    linked = sig.where("doc_id is not null and digest is not null").join(placed, "digest").select(F.col("doc_id").alias("a"), F.col("of").alias("b"))
    return components(linked).withColumnRenamed("id", "doc_id").withColumnRenamed("component", "component_id")
