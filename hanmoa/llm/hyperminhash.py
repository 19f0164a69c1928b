"""HyperMinHash near-duplicate detection.

1. Sign: each text's set of word shingles becomes REGISTERS compressed registers. A shingle's hash names a
   register, which keeps the least value as its count of leading zeros and MANTISSA bits after the first one.
   Registers that no shingle names take over another's by a fixed sequence of probes.
2. Texts with equal sets are one from here on (a link of similarity 1), by a hash of the whole set.
3. Band: BANDS groups of ROWS registers; texts that agree on a band meet in a bucket.
4. Estimate: within a bucket, the share of equal registers, corrected for chance collisions, is a lower-cost
   estimate of the Jaccard similarity; texts that may be near join one family.
5. Verify: within a family, similarities are counted on the full sets.

Buckets and families are walked breadth first: a text is compared only with those not reached yet, so that a
tight group of any size takes about one comparison a text, and only a forest of links is put out. A group of more than
TILE_ROWS texts or TILE_SHINGLES shingles is cut into blocks. Each block is walked by itself; the roots of all its trees
meet, in pairs of blocks; and then every text that isn't in the group's largest part is compared with the whole group,
block by block. So a tight group goes out once, no link is lost and no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanmoa.llm.common import FILE_ROWS, as_bytes, by_group, join_small, packed, slices, space_words, stored
from hanmoa.llm.components import components

OWNER = "hyperminhash"
REGISTERS, MANTISSA, BANDS, ROWS = 128, 10, 24, 4
TILE_ROWS, TILE_SHINGLES = 512, 1 << 18
#: An estimate is trusted to be within so many standard deviations of the similarity.
SURE = 6.0
#: The chance that registers of two different least values are equal: sum over z of 4^-(z+1), times 2^-MANTISSA.
COLLISION = 2.0**-MANTISSA / 3

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalises 64-bit values so that all bits depend on all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """Of each text, the ascending distinct 64-bit hashes of its shingles; a shorter text is one shingle."""
    number: dict[bytes, int] = {}
    split = [[number.setdefault(w, len(number)) for w in space_words(t)] for t in texts]
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in number], dtype=np.uint64)
    out = []
    for s in split:
        if not s:
            out.append(np.empty(0, dtype=np.uint64))
            continue
        h = hashes[np.array(s)]
        width = min(words, len(s))
        x = np.full(len(s) - width + 1, width, dtype=np.uint64)
        for i in range(width):
            x = _mix(x * _U(0x9E3779B97F4A7C15) + h[i : len(s) - width + 1 + i])
        out.append(np.unique(x))
    return out


def _probes() -> np.ndarray:
    draws = np.random.Generator(np.random.PCG64(7))
    return np.array([draws.permutation(REGISTERS) for _ in range(48)])


_PROBES = _probes()


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of uint16 registers for each set; an empty set has zeros."""
    bits = REGISTERS.bit_length() - 1
    out = np.zeros((len(sets), REGISTERS), dtype=np.uint16)
    filled = np.zeros((len(sets), REGISTERS), dtype=bool)
    for k, s in enumerate(sets):
        if len(s):
            name = (s >> _U(64 - bits)).astype(np.int64)
            first = np.flatnonzero(np.diff(name, prepend=-1))  # sets are sorted: the first of a name is its least
            value = (s[first] << _U(bits)) | _U(1 << (bits - 1))
            exponent = np.frexp((value >> _U(11)).astype(np.float64))[1]  # of the top 53 bits
            zeros = 53 - exponent
            mantissa = ((value << np.minimum(zeros + 1, 63).astype(np.uint64)) >> _U(64 - MANTISSA)).astype(np.int64)
            out[k, name[first]] = (zeros << MANTISSA) | mantissa
            filled[k, name[first]] = True
    had, own = filled.copy(), out.copy()
    for probe in _PROBES:
        if (todo := ~filled & had[:, probe]).any():
            out = np.where(todo, own[:, probe], out)
            filled |= todo
    for shift in range(1, REGISTERS):
        rows = np.flatnonzero(~filled.all(axis=1) & had.any(axis=1))
        if not len(rows):
            break
        other = np.roll(had[rows], shift, axis=1)
        todo = ~filled[rows] & other
        out[rows] = np.where(todo, np.roll(own[rows], shift, axis=1), out[rows])
        filled[rows] |= todo
    return out


def estimate(equal: np.ndarray) -> np.ndarray:
    """Jaccard similarity from counts of equal registers."""
    return np.clip((equal / REGISTERS - COLLISION) / (1 - COLLISION), 0, 1)


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Least member of each one's component. near(i, rest) says which of ``rest`` are linked to i."""
    label = np.full(n, -1, dtype=np.int64)
    rest = np.arange(n)
    while len(rest):
        root, rest = rest[0], rest[1:]
        label[root] = root
        queue = [root]
        while queue and len(rest):
            hit = near(queue.pop(), rest)
            label[rest[hit]] = root
            queue.extend(rest[hit].tolist())
            rest = rest[~hit]
    return label


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, row (a hash of the text), n_shingles, set_hash (of the whole set; null if empty), registers."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            sets = shingle_sets(as_bytes(batch, "text"), words)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("row"),
                    pa.array([len(s) for s in sets], type=pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], type=pa.binary()),
                    pa.array([r.tobytes() for r in registers(sets)], type=pa.binary()),
                ],
                names=["doc_id", "row", "n_shingles", "set_hash", "registers"],
            )

    return packed(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text")).mapInArrow(
        sign, "doc_id long, row long, n_shingles long, set_hash binary, registers binary"
    )


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """Rows of groups of two or more, with the number of blocks of their group and their own block i."""
    group = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.sum("n_shingles").alias("shingles")).where("rows > 1")
    blocks = F.greatest(F.ceil(F.col("rows") / TILE_ROWS), F.ceil(F.col("shingles") / TILE_SHINGLES))
    own = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("blocks")).cast("int")
    return rows.join(group.select(key, blocks.cast("int").alias("blocks")), key).withColumn("i", own)


def _pairs(blocks: DataFrame) -> DataFrame:
    """Each row once for every pair (i, j) of blocks that has its own."""
    pair = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("i")).alias("i"), F.greatest(x, F.col("i")).alias("j"))
    )
    rest = [c for c in blocks.columns if c not in ("i", "blocks")]
    return blocks.withColumn("pair", F.explode(pair)).select(*rest, F.col("pair.i").alias("i"), F.col("pair.j").alias("j"))


def _lowest(percent: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimates under this can't belong to a similarity of the threshold: small sets say less."""
    t = percent / 100
    return t - SURE * np.sqrt(t * (1 - t) / np.minimum(np.minimum(a, b), REGISTERS))


def _maybe(regs: np.ndarray, size: np.ndarray, percent: int, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
    """Whether texts i and j may be near, by their sizes and registers."""
    fits = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
    equal = (regs[i] == regs[j]).sum(axis=1)
    return fits & (estimate(equal) >= _lowest(percent, size[i], size[j]))


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])


#: near(i, rest) of one group's rows: which of ``rest`` are linked to row i.
Near = Callable[[int, np.ndarray], np.ndarray]
TREES = "blocks int, i int, doc_id long, row long, n_shingles long, root long"


def grouped_links(
    rows: DataFrame, key: str, add: Callable[[DataFrame, int | None], DataFrame], of: Callable[[pa.Table], Near], few: Callable | None = None, file_rows: int = FILE_ROWS
) -> DataFrame:
    """(id, component) by the links within groups of ``key``; rows have key, doc_id, row and n_shingles.

    add(rows, how many at most) joins what texts are compared by; of makes ``near`` of a group's rows; few, if there is one, links all pairs of
    groups of two at once.
    """

    def trees(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of each row of a cut group its root, of others only those that aren't roots."""
        ids, cut = table.column("doc_id").to_numpy(), table.column("blocks").to_numpy() > 1
        root = ids.copy()
        length = np.diff(starts, append=len(ids))
        left = length > (2 if few else 1)
        if few:
            pair = starts[length == 2]
            pair = pair[few(table, pair)]
            root[pair + 1] = ids[pair]
        for at, n in zip(starts[left].tolist(), length[left].tolist(), strict=True):
            root[at : at + n] = ids[at + forest(n, of(table.slice(at, n)))]
        out = table.select([key, "blocks", "i", "doc_id", "row", "n_shingles"]).append_column("root", pa.array(root))
        yield from out.filter(pa.array(cut | (root != ids))).to_batches()

    def links(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = table.column("doc_id").to_numpy()
        for at, n in zip(starts.tolist(), np.diff(starts, append=len(ids)).tolist(), strict=True):
            label = forest(n, of(table.slice(at, n)))
            yield _links(ids[at : at + n], ids[at + label])

    def strays(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, part, stray = (table.column(c).to_numpy() for c in ("doc_id", "part", "stray"))
        for at, n in zip(starts.tolist(), np.diff(starts, append=len(ids)).tolist(), strict=True):
            near, own = of(table.slice(at, n)), part[at : at + n]
            home = np.flatnonzero(stray[at : at + n] == 0)
            for k in np.flatnonzero(stray[at : at + n]).tolist():
                rest = home[own[home] != own[k]]
                hit = rest[near(k, rest)] if len(rest) else rest
                hit = hit[np.unique(own[hit], return_index=True)[1]]  # one link to each part
                yield _links(np.full(len(hit), ids[at + k]), ids[at + hit])

    every = rows.count()
    found = stored(by_group(add(_blocks(rows, key), every), [key, "i"], trees, f"{key} long, {TREES}"), OWNER, rows=every, file_rows=file_rows)
    out = found.where("doc_id != root").select(F.col("doc_id").alias("a"), F.col("root").alias("b"))
    cut = found.where("blocks > 1")
    number, most = cut.count(), found.count()
    if not number:
        return components(out, OWNER, most)
    roots = cut.where("doc_id = root").select(key, "doc_id", "row", "n_shingles")
    tips = roots.count()
    tips *= tips // TILE_ROWS + 1  # about as many rows have the pairs of blocks
    between = stored(by_group(add(_pairs(_blocks(roots, key)), tips), [key, "i", "j"], links, "a long, b long"), OWNER, rows=tips, file_rows=file_rows)
    out, most = out.unionAll(between), most + between.count()
    inner = cut.select(F.col("doc_id").alias("a"), F.col("root").alias("b")).unionAll(between)
    part = components(inner, OWNER, most).select(F.col("id").alias("doc_id"), F.col("component").alias("part"))
    labelled = cut.drop("root").join(part, "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
    each = labelled.groupBy(key, "part").count()
    largest = each.groupBy(key).agg(F.max_by("part", F.struct("count", "part")).alias("largest"))
    labelled = stored(labelled.join(largest, key).withColumn("stray", (F.col("part") != F.col("largest")).cast("int")).drop("largest"), OWNER, rows=number)
    lost = labelled.where("stray = 1")
    tiles = lost.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("tiles"))
    sent = lost.join(tiles, key).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.withColumn("j", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("tiles")).cast("int"))
    home = labelled.withColumn("stray", F.lit(0)).join(tiles, key).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    sizes = lost.groupBy(key).count().join(labelled.groupBy(key).agg(F.max("blocks").alias("blocks"), F.count(F.lit(1)).alias("rows")), key)
    sizes = sizes.agg(F.sum(F.col("count") * F.col("blocks") + F.ceil(F.col("count") / TILE_ROWS) * F.col("rows"))).first()[0] or 0
    met = add(sent.unionByName(home).drop("tiles", "blocks"), int(sizes))
    met = stored(by_group(met, [key, "i", "j"], strays, "a long, b long"), OWNER, rows=int(sizes), file_rows=file_rows)
    return components(out.unionAll(met), OWNER, most + met.count())


def _registers(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("registers").to_pylist()), dtype=np.uint16).reshape(table.num_rows, REGISTERS)


def families(texts: DataFrame, percent: int) -> DataFrame:
    """(id, component) over texts that may be near by their registers."""
    band = [F.xxhash64(F.lit(b), F.substring("registers", 2 * ROWS * b + 1, 2 * ROWS)) for b in range(BANDS)]
    keys = stored(texts.select("doc_id", "row", "n_shingles", F.explode(F.array(*band)).alias("band")), OWNER)  # from each file of texts one
    own = texts.select("doc_id", "row", "registers")

    def of(group: pa.Table) -> Near:
        regs, size = _registers(group), group.column("n_shingles").to_numpy()
        return lambda i, rest: _maybe(regs, size, percent, i, rest)

    def few(table: pa.Table, first: np.ndarray) -> np.ndarray:
        return _maybe(_registers(table), table.column("n_shingles").to_numpy(), percent, first, first + 1)

    return grouped_links(keys, "band", lambda rows, _: rows.join(own, ["doc_id", "row"]), of, few)


def verified(docs: DataFrame, texts: DataFrame, family: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, component) over texts whose full sets have 100 |A and B| >= percent |A or B|."""
    ids = family.select("id", "component").unionAll(family.select("component", "component")).distinct()
    held = texts.select("doc_id", "row", "n_shingles").join(ids.select(F.col("id").alias("doc_id"), F.col("component").alias("family")), "doc_id")
    held = stored(held, OWNER, rows=2 * family.count())  # of each component also the one it is named after
    need = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text")

    def of(group: pa.Table) -> Near:
        sets = shingle_sets(as_bytes(group, "text"), words)
        regs, size = registers(sets), np.array([len(s) for s in sets])

        def near(i: int, rest: np.ndarray) -> np.ndarray:
            hit = _maybe(regs, size, percent, i, rest)
            for k in np.flatnonzero(hit):
                a, b = sets[i], sets[rest[k]]
                at = np.minimum(np.searchsorted(a, b), len(a) - 1)
                both = int((a[at] == b).sum())
                hit[k] = 100 * both >= percent * (len(a) + len(b) - both)
            return hit

        return near

    def with_text(rows: DataFrame, most: int | None) -> DataFrame:
        return join_small(need, stored(rows, OWNER, rows=most), ["doc_id", "row"], "inner", 64)

    return grouped_links(held, "family", with_text, of, file_rows=4096)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    A text's set: distinct shingles of ``words`` words, words being runs without ASCII white space, A-Z
    lower-cased; with fewer words the whole sequence. Texts are linked at 100 |A and B| >= percent |A or B|. Null
    texts and those without words have an empty set and no links. Rows that repeat a doc_id are one node of the
    graph, and each is labelled by its own text. A null doc_id is linked with nothing. Other columns aren't read; an empty table gives no rows.
    """
    signed = stored(signatures(docs, words), OWNER)
    sets = signed.where(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
    texts = stored(
        sets.groupBy("set_hash").agg(
            F.min(F.struct("doc_id", "row")).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")
        ).select("set_hash", F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("row"), "n_shingles", "registers"),
        OWNER,
        rows=signed.count(),
    )
    linked = verified(docs, texts, families(texts, percent), words, percent)
    first = texts.select("set_hash", F.col("doc_id").alias("first"))
    rows = signed.select("doc_id", "n_shingles", "set_hash").join(first, "set_hash", "left")
    found = join_small(rows, linked.withColumnRenamed("id", "first"), "first", "left", 24)
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first")), "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
