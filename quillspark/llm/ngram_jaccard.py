"""N-gram Jaccard join by parity sketches.

A document's set of word n-grams is a bit sketch: each n-gram flips the bit its
hash names.  Two sketches differ in no more bits than the sets differ in n-grams,
and a Jaccard similarity of p/100 bounds that number: with sizes a and b, the
sets differ in at most (100 - p)(a + b) / (100 + p) n-grams.

Sizes fall into bands whose bounds stand in the ratio p/100, so partners are in
the same or in neighbouring bands.  For each pair of neighbours the sketch is cut
into more parts than the sets can differ in: some part must agree.  A part is
named by the XOR of its n-grams' hashes.  Parts of fewer than two bits say little
and are left out of a sketch that has enough others to be sure of an agreement;
of those others only the first ones in an order that all sketches share are sent,
one more than can differ, for two partners must have one of them in common.

Parts meet in buckets.  Documents sharing a part form a run; its first members are
compared with all of it.  Two sketches screen the pairs by the same bound: one of 256
bits, which every member of a run carries, and one that grows with the set (eight bits
or more for each n-gram that may differ; a longer one is folded to a shorter one's
length), which is looked up once for each pair.  What is left is verified on the
whole sets, which are made for the documents of such pairs alone.  Other members do
the same in runs that still hold several components.  Then members of a run that are
still in different components are screened and verified, too; there they carry the
longer sketch, up to a bounded length, and each pair is made in the first run that
both have among their own first ones.  So no link that could join two
components is missed, yet copies are never expanded into all their pairs.

Equal sets are one node from the start.  A part common to very many sets of one
chunk sends only its first ones to the bucket; the rest join the run directly.

Equality of n-grams and of sets rests on 64-bit names.

Defined cases: a text of fewer than n words is one n-gram of all its words; a
null, empty or wordless text has no n-grams and is its own component; rows with
one doc_id are rows of one document; a null doc_id never names a component if
another id can; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import BLANKS, Chunk, Scratch, WordTable, give_back, groups_for, mix, pair_hash, text_bytes, text_chunks, window_hashes
from quillspark.llm.components import components
from quillspark.llm.messages import SCHEMA, messages, table, unpacked

FIRST, COMMON, BLOCK, BUCKET_BYTES = 4, 64, 8, 8 << 20
#: Members of a run that are compared with all of it: at first, and again in each round while it holds several components.
CENTRES, MORE, ROUNDS = 1, 3, 2
#: Bits of the longer sketch for each n-gram that may differ; runs of a set among which a pair looks for the one that makes it.
SHARP, FIRSTS = 8, 8
#: Numbers of 64 bits to which the longer sketch is folded where every member of a run carries it.
CARRIED = 64
#: Stands for a null doc_id: no id is larger.
NO_ID = (1 << 63) - 1
ENTRY, ENTRY_OF_COMMON, MEMBER = 0, 1, 2


class Bands:
    """Size bands and, for each band with its upper neighbour, the parts of a sketch."""

    def __init__(self, percent: int, most: int = 1 << 31):
        lows = [1]
        while lows[-1] < most:
            lows.append(lows[-1] * 100 // percent + 1)
        self.lows = np.array(lows, np.int64)
        n = len(lows) - 2
        self.differ, self.parts, self.least = (np.zeros(n, np.int64) for _ in range(3))
        for j in range(n):
            small = lows[j + 1] - 1
            large = min(small * 100 // percent, lows[j + 2] - 1)
            d = (100 - percent) * (small + large) // (100 + percent)
            self.differ[j] = d
            self.least[j], self.parts[j] = self._cut(lows[j], d)

    @staticmethod
    def _cut(low: int, d: int) -> tuple[int, int]:
        """(bits a part must have, number of parts) for sets of `low` n-grams or more."""
        if d == 0:
            return 1, 0  # partners are equal sets, which are one node already
        if d >= 4:
            m = d + 2
            while m < low:
                mean = low / m
                f = 1 - math.exp(-mean) * (1 + mean)
                if m * f - 3 * math.sqrt(m * f * (1 - f)) >= d + 1:
                    return 2, m
                m += max(1, m // 50)
        return 1, 2 * d + 4


def sharp_bits(size: np.ndarray, percent: int) -> np.ndarray:
    """Bits of the longer sketch of sets of these sizes: a power of two."""
    want = np.maximum(256, SHARP * (100 - percent) * 2 * size // (100 + percent))
    return (1 << np.ceil(np.log2(want)).astype(np.int64)).astype(np.int64)


class Shingles:
    """Sets of n-grams of a chunk's texts, row by row."""

    def __init__(self, words: WordTable, chunk: Chunk, n: int):
        names, _, _, firsts = words.words(chunk)
        count = np.diff(firsts)
        docs, grams = [], []
        for size in range(1, n + 1):
            pick = np.flatnonzero(count >= n if size == n else count == size)
            if not len(pick):
                continue
            h = mix(window_hashes(names, size) + np.uint64(size))
            many = count[pick] - size + 1
            at = np.repeat(firsts[pick] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            docs.append(np.repeat(pick, many))
            grams.append(h[at])
        doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.lexsort((gram, doc))
        doc, gram = doc[order], gram[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
        self.doc, self.gram = doc[new], gram[new]
        self.size = np.bincount(self.doc, minlength=len(chunk)).astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.name = np.zeros(len(chunk), np.uint64)
        some = np.flatnonzero(self.size)
        if len(some):
            a = np.add.reduceat(mix(self.gram + np.uint64(1)), self.first[some])
            b = np.bitwise_xor.reduceat(self.gram, self.first[some])
            self.name[some] = pair_hash(a, b) | np.uint64(1)

    def sketches(self) -> np.ndarray:
        """256 bits of parity for each text, as four numbers."""
        n = len(self.size)
        bit = (mix(self.gram + np.uint64(7)) >> np.uint64(56)).astype(np.int64)
        odd = (np.bincount(self.doc * 256 + bit, minlength=n * 256) & 1).astype(np.uint8).reshape(n, 256)
        return np.packbits(odd, axis=1, bitorder="little").view(np.int64).reshape(n, 4)

    def sharp(self, percent: int) -> list[np.ndarray]:
        """Parity of each text's n-grams over bits enough to tell sets apart that differ too much."""
        out = [np.zeros(0, np.int64)] * len(self.size)
        bits = sharp_bits(self.size, percent)
        h = mix(self.gram + np.uint64(19))
        for size in np.unique(bits[self.size > 0]).tolist():
            rows = np.flatnonzero((bits == size) & (self.size > 0))
            local = np.zeros(len(bits), np.int64)
            local[rows] = np.arange(len(rows))
            pick = bits[self.doc] == size
            at = local[self.doc[pick]] * size + (h[pick] & np.uint64(size - 1)).astype(np.int64)
            odd = (np.bincount(at, minlength=len(rows) * size) & 1).astype(np.uint8).reshape(len(rows), size)
            for row, packed in zip(rows.tolist(), np.packbits(odd, axis=1, bitorder="little"), strict=True):
                out[row] = packed.view(np.int64)
        return out

    def parts(self, bands: Bands):
        """(document, group, part, name) of the parts by which each text is dealt."""
        out = []
        band = np.searchsorted(bands.lows, self.size, side="right") - 1
        for shift in (0, 1):
            group = band - shift
            ok = (self.size > 0) & (group >= 0)
            group = np.where(ok, group, 0)
            parts = np.where(ok, bands.parts[group], 0)
            base = np.cumsum(parts) - parts
            total = int(parts.sum())
            if not total:
                continue
            pick = parts[self.doc] > 0
            doc, gram = self.doc[pick], self.gram[pick]
            h = mix(gram + np.uint64(13))
            at = base[doc] + (h % parts[doc].astype(np.uint64)).astype(np.int64)
            name = np.zeros(total, np.uint64)
            np.bitwise_xor.at(name, at, mix(h))
            bits = np.bincount(at, minlength=total)
            owner = np.repeat(np.arange(len(parts)), parts)
            full = bits >= bands.least[group[owner]]
            enough = np.bincount(owner, weights=full, minlength=len(parts)) > bands.differ[group]
            send = full | ~enough[owner]
            owner, number, name = owner[send], (np.arange(total) - base[owner])[send], name[send]
            key = pair_hash(name, (group[owner].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64))
            order = np.lexsort((key, owner))
            owner, number, key = owner[order], number[order], key[order]
            sent = np.bincount(owner, minlength=len(parts))
            rank = np.arange(len(owner)) - (np.cumsum(sent) - sent)[owner]
            first = ~enough[owner] | (rank <= bands.differ[group[owner]])
            owner, number, key = owner[first], number[first], key[first]
            out.append((owner, group[owner], number, key))
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, z, np.zeros(0, np.uint64)
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _nodes(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(BLANKS, lower=True)
        for batch in batches:
            for chunk in text_chunks(batch, limit=1 << 20):
                s = Shingles(words, chunk, n)
                bits = s.sketches()
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(c)).slice(chunk.rows[0], len(chunk)) for c in ("at", "hash")), chunk.ids, pa.array(s.size), pa.array(s.name.view(np.int64)), *(pa.array(bits[:, k]) for k in range(4)), pa.array(s.sharp(percent), pa.list_(pa.int64()))],
                    ["at", "hash", "doc_id", "n", "node", "s0", "s1", "s2", "s3", "sharp"],
                )

    return run


def _halves(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """40 bits of each key: enough to tell the parts of one bucket apart; what agrees by chance is verified anyway."""
    return key.astype(np.uint32).view(np.int32), (key >> np.uint64(56)).astype(np.uint8)


def _send_parts(n: int, bands: Bands, buckets: int, split: int):
    """Each different set's parts, once a chunk, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(BLANKS, lower=True)
        for batch in batches:
            for chunk in text_chunks(batch, limit=1 << 20):
                s = Shingles(words, chunk, n)
                doc, group, part, key = s.parts(bands)
                one = np.zeros(len(chunk), bool)
                one[np.unique(s.name, return_index=True)[1]] = True
                keep = one[doc]
                doc, group, part, key = doc[keep], group[keep], part[keep], key[keep]
                node = s.name[doc]
                block = (group.astype(np.uint64) << np.uint64(40)) + part.astype(np.uint64) // np.uint64(BLOCK)
                bucket = (mix(block * np.uint64(split) + key % np.uint64(split)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((node, key))
                key, node, bucket = key[order], node[order], bucket[order]
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                which = np.cumsum(new) - 1
                rank = np.arange(len(key)) - np.flatnonzero(new)[which] if len(key) else which
                common = np.bincount(which)[which] > COMMON if len(key) else new
                state = np.where(common, np.where(rank < FIRST, ENTRY_OF_COMMON, MEMBER), ENTRY).astype(np.uint8)
                direct = state == MEMBER
                bucket[direct] = (node[direct] % np.uint64(buckets)).astype(np.int64)
                yield from table(list(messages(bucket, node.view(np.int64), *_halves(key), state))).to_batches()

    return run


_RUNS = pa.schema([("run", pa.int64()), ("node", pa.int64()), ("rank", pa.int32())])


def _runs(told: pa.Table) -> pa.Table:
    """Runs of two or more sets that share a part, and the place of each set in its run."""
    node, low, high, state = unpacked(told.column("m").to_pylist())
    key = (high.astype(np.uint64) << np.uint64(32)) | low.view(np.uint32).astype(np.uint64)
    direct = state == MEMBER
    out = [(key[direct], node[direct], np.full(int(direct.sum()), 1 << 30))]
    node, key, state = node[~direct], key[~direct], state[~direct]
    if len(key):
        order = np.argsort(key, kind="stable")
        node, key, state = node[order], key[order], state[order]
        same = np.append(False, key[1:] == key[:-1])
        many = same | np.append(same[1:], False)
        node, key, state = node[many], key[many], state[many]
    if len(key):
        order = np.lexsort((node, key))
        node, key, state = node[order], key[order], state[order]
        new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
        begin = np.append(True, key[1:] != key[:-1])
        which = np.cumsum(begin) - 1
        common = np.bincount(which, weights=state)[which] > 0
        node, key, begin, common = node[new], key[new], begin[new], common[new]
        which = np.cumsum(begin) - 1
        size = np.bincount(which)
        rank = np.arange(len(node)) - np.flatnonzero(begin)[which]
        # Runs of the same members are one run; a common part keeps its own name, as more members come directly.
        sign = mix(np.add.reduceat(mix(node.view(np.uint64)), np.flatnonzero(begin)))
        run = np.where(common, key, sign[which])
        first = np.zeros(len(size), bool)
        first[np.unique(sign, return_index=True)[1]] = True
        keep = ((size[which] > 1) & first[which]) | common
        out.append((run[keep], node[keep], rank[keep]))
    run, node, rank = (np.concatenate(c) for c in zip(*out, strict=True))
    give_back()
    return pa.table([pa.array(run.view(np.int64)), pa.array(node), pa.array(rank.astype(np.int32))], schema=_RUNS)


def _differ(percent: int, a: str, b: str) -> str:
    """SQL: the sets may still be similar, by their sizes and by their sketches."""
    bits = " + ".join(f"bit_count({a}.s{k} ^ {b}.s{k})" for k in range(4))
    return (
        f"{percent} * greatest({a}.n, {b}.n) <= 100 * least({a}.n, {b}.n)"
        f" and {100 + percent} * ({bits}) <= {100 - percent} * ({a}.n + {b}.n)"
    )


def _sharply(percent: int, a: str, b: str, bits: str, n: str) -> str:
    """SQL: the same by the longer sketches, the longer of the two folded."""
    k = f"least(size({a}.{bits}), size({b}.{bits}))"
    term = f"{a}.{bits}[i] ^ {b}.{bits}[i] ^ coalesce(get({a}.{bits}, i + {k}), 0L) ^ coalesce(get({b}.{bits}, i + {k}), 0L)"
    return f"{100 + percent} * aggregate(sequence(0, {k} - 1), 0, (h, i) -> h + bit_count({term})) <= {100 - percent} * ({a}.{n} + {b}.{n})"


def _sets(n: int):
    """node and grams of each text, each node once a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(BLANKS, lower=True)
        for batch in batches:
            for chunk in text_chunks(batch, limit=1 << 20):
                s = Shingles(words, chunk, n)
                keep = np.flatnonzero(s.size)
                keep = keep[np.unique(s.name[keep], return_index=True)[1]]
                grams = s.gram.view(np.int64)
                sets = [grams[s.first[k] : s.first[k] + s.size[k]] for k in keep.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(s.name.view(np.int64)[keep]), pa.array(sets, pa.list_(pa.int64()))], ["node", "grams"])

    return run


def _mixed(scratch: Scratch, members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of runs that hold several components, with their roots."""
    placed = scratch.cut(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    runs = placed.groupBy("run").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    mixed = scratch.cut(placed.join(runs.select("run"), "run", "left_semi"))
    scratch.drop(placed)
    return mixed


def _placed(docs: DataFrame, n: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """doc_id, node, n and root of every row with an n-gram, and doc_id of those without; both written."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size, least = text_bytes(texts), int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, split, bands = max(least, groups_for(size, BUCKET_BYTES)), 1 + size // (1 << 30), Bands(percent)

    # Where a set's text can be read again: by its document's id or, without one, by a hash of the text.
    texts = texts.withColumn("hash", F.xxhash64("text")).withColumn("at", F.coalesce("doc_id", "hash"))
    nodes = scratch.cut(texts.mapInArrow(_nodes(n, percent), "at bigint, hash bigint, doc_id bigint, n bigint, node bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint, sharp array<bigint>"))
    runs = texts.select("doc_id", "text").mapInArrow(_send_parts(n, bands, buckets, split), SCHEMA).groupBy("k").applyInArrow(_runs, "run bigint, node bigint, rank int")
    runs = scratch.cut(runs.groupBy("run", "node").agg(F.min("rank").alias("rank")))
    # One row stands for each set that shares a part.
    stands = nodes.join(runs.select("node").distinct(), "node", "left_semi")
    stands = scratch.cut(stands.groupBy("node").agg(F.min("at").alias("at"), *(F.first(c).alias(c) for c in ("n", "s0", "s1", "s2", "s3", "sharp"))))

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among the pairs: by the longer sketch, then on whole sets, which are made for what is left."""
        about = stands.select("node", "n", "sharp")
        both = pairs.join(about.alias("u"), F.expr("a = u.node")).join(about.alias("v"), F.expr("b = v.node"))
        left = scratch.cut(both.where(_sharply(percent, "u", "v", "sharp", "n")).select("a", "b"))
        asked = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        # Written, so that Spark knows the size before it chooses to broadcast the places or to shuffle.
        places = scratch.cut(stands.join(asked, "node", "left_semi").select("at").distinct())
        sets = texts.join(places, "at", "left_semi").select("doc_id", "text").mapInArrow(_sets(n), "node bigint, grams array<bigint>").dropDuplicates(["node"])
        sets = scratch.cut(sets)
        found = left.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
        found = found.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
        found = found.withColumn("both", F.expr("size(array_intersect(x, y))")).where(f"{100 + percent} * both >= {percent} * (size(x) + size(y))")
        found = scratch.cut(found.select("a", "b"))
        for table_ in (left, places, sets):
            scratch.drop(table_)
        return found

    def star(runs: DataFrame, centres: DataFrame) -> DataFrame:
        """Each run's centres with every other member (in another component, if there are roots) that passes the bound."""
        apart = "c.node <> r.node" + (" and c.root <> r.root" if "root" in runs.columns else "")
        pairs = centres.alias("c").join(runs.alias("r"), F.expr(f"c.run = r.run and {apart} and {_differ(percent, 'c', 'r')}"))
        return pairs.select(F.expr("least(c.node, r.node)").alias("a"), F.expr("greatest(c.node, r.node)").alias("b")).distinct()

    def joined(links: DataFrame, roots: DataFrame | None) -> DataFrame:
        """Components after more links; what they had before is known by the roots."""
        if roots is not None:
            links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        new = components(links, scratch)
        if roots is not None:
            scratch.drop(roots)
        return new

    known = scratch.cut(runs.join(stands.select("node", "n", "s0", "s1", "s2", "s3"), "node"))
    scratch.drop(runs)
    done = scratch.cut(star(known, known.where(F.col("rank") < CENTRES)))
    links = verified(done)
    roots = joined(links, None)
    scratch.drop(links)
    open_ = scratch.cut(_mixed(scratch, known.drop("rank"), roots))
    scratch.drop(known)
    for turn in range(ROUNDS):
        member = F.struct(*(c for c in open_.columns if c != "run"))
        chosen = F.array(*(F.min_by(member, F.xxhash64("node", F.lit(MORE * turn + k))) for k in range(MORE)))
        centres = open_.groupBy("run").agg(chosen.alias("c")).select("run", F.explode(F.array_distinct("c")).alias("c")).select("run", "c.*")
        more = scratch.cut(star(open_, centres).join(done, ["a", "b"], "left_anti"))
        if more.isEmpty():
            break
        links = verified(more)
        both = scratch.cut(done.unionByName(more))
        scratch.drop(done)
        scratch.drop(more)
        done = both
        if links.isEmpty():
            continue
        roots = joined(links, roots)
        scratch.drop(links)
        still = scratch.cut(_mixed(scratch, open_.drop("root"), roots))
        scratch.drop(open_)
        open_ = still

    # Runs that still hold several components: their members across components, each pair once (but for pairs whose first runs differ).
    firsts = open_.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("run")), 1, FIRSTS).alias("firsts"))
    fold = f"transform(sequence(0, {CARRIED - 1}), i -> aggregate(sequence(0, size(sharp) div {CARRIED} - 1), 0L, (h, j) -> h ^ sharp[j * {CARRIED} + i]))"
    wide = stands.select("node", F.expr(f"case when size(sharp) <= {CARRIED} then sharp else {fold} end").alias("wide"))
    told = open_.join(firsts, "node").join(wide, "node")
    here = "coalesce(get(array_intersect(u.firsts, v.firsts), 0), u.run) = u.run"
    bound = f"{_differ(percent, 'u', 'v')} and {here} and {_sharply(percent, 'u', 'v', 'wide', 'n')}"
    across = told.alias("u").join(told.alias("v"), F.expr(f"u.run = v.run and u.node < v.node and u.root <> v.root and {bound}"))
    across = scratch.cut(across.select(F.col("u.node").alias("a"), F.col("v.node").alias("b")).distinct().join(done, ["a", "b"], "left_anti"))
    if not across.isEmpty():
        links = verified(across)
        roots = joined(links, roots)
        scratch.drop(links)
    for table_ in (open_, stands, across, done):
        scratch.drop(table_)
    placed = scratch.cut(nodes.where("n > 0").join(roots, "node", "left").select("doc_id", "hash", "node", "n", F.coalesce("root", "node").alias("root")))
    none = scratch.cut(nodes.where("n = 0").select("doc_id"))
    scratch.drop(nodes)
    scratch.drop(roots)
    return placed, none


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row of `docs`.

    Two documents link when their sets of word n-grams have a Jaccard similarity of `percent`/100 or more.
    """
    scratch = Scratch(docs.sparkSession)
    placed, none = _placed(docs, n, percent, scratch)
    # Written first, so that a component of very many documents meets its id in a join Spark can split.
    least_id = scratch.cut(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return (
        placed.join(least_id, "root")
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        .unionByName(none.select("doc_id", F.lit(0).cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    )


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of `docs` for each component: a row with its smallest doc_id (null is largest) and, of these, the least set name.

    Rows of one id and one set are repeats; any one of them stays.  Texts without a word are in no component, and all rows with such a text stay.
    """
    scratch = Scratch(docs.sparkSession)
    placed, none = _placed(docs, n, percent, scratch)
    scratch.drop(none)
    # A row of `docs` is named by its id and a 64-bit hash of its text, which only tells texts of one id apart.
    named = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("_quill_id"), F.col("node"), F.col("hash").alias("_quill_hash"))
    winners = scratch.cut(placed.groupBy("root").agg(F.min(named).alias("w")).select("w._quill_id", "w._quill_hash"))
    scratch.drop(placed)
    text = F.col("text").cast("string")
    word = F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.where(word).withColumn("_quill_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))).withColumn("_quill_hash", F.xxhash64(text))
    rows = keyed.join(winners, ["_quill_id", "_quill_hash"], "left_semi")
    return rows.dropDuplicates(["_quill_id", "_quill_hash"]).select(*docs.columns).unionByName(docs.where(~word))
