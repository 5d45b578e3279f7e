"""N-gram Jaccard join with adaptive multi-match prefixes.

The join is exact over whole texts: two documents link when the Jaccard similarity of their shingle sets reaches the
threshold. Steps, none of which puts all the rows of a key into one task or emits all the pairs of a group:

1. One pass over the text hashes shingles (texthash). Documents with equal sets become one class. Incidences
   (shingle, class) travel as sorted, delta-coded blobs to the partition that owns a range of hashes; there the exact
   document frequency is counted and shingles of frequency one, which no two classes share, are dropped. A shingle that
   is frequent within one chunk of documents sends a count only; its incidences bypass the owner.
2. A class keeps its shared shingles in order of (frequency, hash), one order for all. A class with fewer shared shingles
   than the overlap that the threshold asks for has no partner.
3. A pair links when twice its overlap, times 100 + percent, reaches G + G' (see _level). The smaller of the two needs a
   short prefix, the larger a long one. With l - 1 shingles more in both, a pair must share l of them. Each class takes the l
   of least estimated cost: frequencies scanned plus verifications, the latter at most sum(frequency - 1) / l, and for a shingle of more than BUCKET
   the differences that a cluster writes; a pair needs min(l, l') common prefix shingles before verification. In a bucket only those count
   for whom the bounds of g leave a partner there.
4. Prefix shingles that few classes share give pairs at once. The classes of a bucket of more than BUCKET become a cluster:
   each is described by its difference from the cluster's centre, the set of what more than half of its members hold, and the differences are joined by
   the same rule one level on: the symmetric difference of two classes is that of their differences, whatever the centre. What the
   copies of a group have in common is gone from the differences. Members so close to the centre that they must link with the
   member nearest to it are linked with that one only, and meet only such others as they can reach.
   From the first level, hubs that share more than half of their classes with a lesser one's are one, so that a group is described once and not once a hub.
5. No element is in the differences of more than half of a cluster's members, so that the buckets of a cluster have half its size at most.
   Buckets with one hub make one cluster of the next level, unless that would hold over MOST_OF of the cluster; then each is its own. Sizes thus fall at every
   level and the rounds end by themselves, without a level at which all pairs are listed. No link is lost that joins components.

Hashes: shingles 64 bits in a set's size, 48 bits in frequencies and overlaps; classes 63 bits, clusters 64 bits.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import texthash
from .components import connected_components
from .scratch import Scratch

#: Shingles of one chunk of documents, the frequency within it from which a shingle sends a count only, and the classes that
#: one row lists for such a shingle.
CHUNK, HOT, PIECE = 1_000_000, 48, 96
MAX_MULTI, VERIFY_COST = 6, 2
#: A bucket in which more classes than this have the shingle in their short prefix becomes a cluster; in the others each member meets these few only.
BUCKET = 32
#: Greatest share of a cluster that the joint buckets of one hub may hold.
MOST_OF = 0.75
#: Bytes of text whose shingles one owner holds in memory at a time.
RANGE_BYTES = 16 << 20

INC, DOC, HOT_DF, HOT_INC = 1, 2, 3, 4
_MAP = "r int, kind int, a long, b long, c int, blob binary, many array<long>"
_OUT = "a long, b long, c int, many array<long>, kind int"
_MANY = pa.list_(pa.int64())


def encode(tokens: np.ndarray, owners: np.ndarray, classes: np.ndarray) -> bytes:
    """tokens ascending; owners: index into classes. Differences are cut to the bytes that the largest one needs."""
    used, local = np.unique(owners, return_inverse=True)
    steps = np.diff(tokens)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    planes = np.ascontiguousarray(steps).view(np.uint8).reshape(-1, 8)[:, :width].T
    head = struct.pack("<IIBQ", len(tokens), len(used), width, int(tokens[0]))
    return head + classes[used].astype("<i8").tobytes() + local.astype("<u2").tobytes() + planes.tobytes()


def decode(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, k, width, start = struct.unpack_from("<IIBQ", blob)
    at = struct.calcsize("<IIBQ")
    classes = np.frombuffer(blob, "<i8", k, at)
    local = np.frombuffer(blob, "<u2", n, at + 8 * k)
    steps = np.zeros((n - 1, 8), np.uint8)
    steps[:, :width] = np.frombuffer(blob, np.uint8, (n - 1) * width, at + 8 * k + 2 * n).reshape(width, n - 1).T
    tokens = np.cumsum(np.concatenate([np.array([start], np.uint64), steps.reshape(-1).view("<u8")]), dtype=np.uint64)
    return tokens, classes[local]


def _fingerprint(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(texthash.mix(texthash.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True) + np.uint64(len(tokens)))[0] >> np.uint64(1))


def _mapper(width: int, ranges: int):
    def run(batches):
        seen: dict[int, int] = {}
        keys, total, turn = [], 0, 0

        def flush():
            nonlocal total
            classes = np.fromiter(seen, np.int64, len(seen))
            both = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
            seen.clear()
            keys.clear()
            total = 0
            tokens, owners = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.int64)
            del both
            rows = []
            if len(tokens):
                begin = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
                count = np.diff(np.append(begin, len(tokens)))
                hot = count >= HOT
                if hot.any():
                    marks = np.repeat(hot, count)
                    t, c = tokens[begin[hot]], count[hot]
                    pieces = -(-c // PIECE)  # equal shares for the ranges, however many classes a shingle has
                    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    cut = np.append(np.repeat(np.cumsum(c) - c, pieces) + nth * PIECE, c.sum())
                    many = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(classes[owners[marks]]))
                    of = np.repeat(t, pieces)
                    rows.append((of, HOT_INC, of.astype(np.int64), np.zeros(len(of), np.int64), np.diff(cut).astype(np.int32), many))
                    rows.append(((t * np.uint64(ranges) >> np.uint64(48)).astype(np.int32), HOT_DF, t.astype(np.int64), np.zeros(len(t), np.int64), c.astype(np.int32), pa.nulls(len(t), _MANY)))
                    tokens, owners = tokens[~marks], owners[~marks]
            for r, kind, a, b, c, many in rows:
                if kind == HOT_INC:  # dealt in turn, so that no range gets more than its share
                    r = ((int(classes[0]) + np.arange(len(r))) % ranges).astype(np.int32)
                yield pa.record_batch({"r": r, "kind": np.full(len(r), kind, np.int32), "a": a, "b": b, "c": c, "blob": pa.nulls(len(r), pa.binary()), "many": many})
            owner = (tokens * np.uint64(ranges) >> np.uint64(48)).astype(np.int64)
            edge = np.searchsorted(owner, np.arange(ranges + 1))
            full = np.flatnonzero(np.diff(edge))
            blobs = [encode(tokens[edge[r] : edge[r + 1]], owners[edge[r] : edge[r + 1]], classes) for r in full]
            if blobs:
                nothing = np.zeros(len(full), np.int64)
                yield pa.record_batch({"r": full.astype(np.int32), "kind": np.zeros(len(full), np.int32), "a": nothing, "b": nothing, "c": nothing.astype(np.int32), "blob": pa.array(blobs, pa.binary()), "many": pa.nulls(len(full), _MANY)})

        for batch in (part for whole in batches for part in texthash.parts(whole, 1)):
            ids, cls, size = batch.column(0), [], []
            for tokens in texthash.shingle_sets(batch.column(1), width):
                mark = _fingerprint(tokens) if len(tokens) else -1
                cls.append(mark)
                size.append(len(tokens))
                if len(tokens) and mark not in seen:
                    keys.append((np.unique(tokens >> np.uint64(16)) << np.uint64(16)) | np.uint64(len(seen)))
                    seen[mark] = len(seen)
                    total += len(tokens)
                    if total >= CHUNK or len(seen) == 65535:
                        yield from flush()
            n = len(cls)
            turn += n
            yield pa.record_batch({"r": ((np.arange(n) + turn) % ranges).astype(np.int32), "kind": np.full(n, DOC, np.int32), "a": ids.cast(pa.int64()), "b": np.array(cls, np.int64), "c": np.array(size, np.int32), "blob": pa.nulls(n, pa.binary()), "many": batch.column(2).cast(_MANY)})
        yield from flush()

    return run


def _owner(batches):
    """Counts document frequencies of the hashes that this partition owns, one range after the other; passes the rest through."""
    tokens, classes, hot, at = [], [], {}, None
    for batch in batches:
        kind = batch.column(1).to_numpy()
        passed = batch.filter(pa.array((kind == DOC) | (kind == HOT_INC)))
        if passed.num_rows:
            yield pa.record_batch({"a": passed.column(2), "b": passed.column(3), "c": passed.column(4), "many": passed.column(6), "kind": passed.column(1)})
        own = batch.filter(pa.array((kind == 0) | (kind == HOT_DF)))
        for r, k, t, c, blob in zip(*(own.column(x) for x in (0, 1, 2, 4, 5))):
            if r.as_py() != at:
                yield from _counted(tokens, classes, hot)
                tokens, classes, hot, at = [], [], {}, r.as_py()
            if k.as_py() == HOT_DF:
                hot[t.as_py()] = hot.get(t.as_py(), 0) + c.as_py()
            else:
                found = decode(blob.as_buffer().to_pybytes())
                tokens.append(found[0])
                classes.append(found[1])
    yield from _counted(tokens, classes, hot)


def _counted(tokens: list, classes: list, hot: dict):
    """The incidences of the hashes of one range that two classes or more share, with their frequencies. Empties the lists."""
    t = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
    c = np.concatenate(classes) if classes else np.zeros(0, np.int64)
    tokens.clear(), classes.clear()
    order = np.argsort(t, kind="stable")
    t, c = t[order].astype(np.int64), c[order]
    del order
    again = np.zeros(len(t), bool)  # of a hash that occurs once more here
    if len(t):
        again[1:] = t[1:] == t[:-1]
        again[:-1] |= again[1:].copy()
        if hot:
            again |= np.isin(t, np.fromiter(hot, np.int64, len(hot)))
    t, c = t[again], c[again]
    order = np.lexsort((c, t))
    t, c = t[order], c[order]
    if len(t):
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])])  # one class may come from several chunks
        t, c = t[new], c[new]
    found, count = np.unique(t, return_counts=True)
    more = np.array([hot.get(x, 0) for x in found.tolist()], np.int64) if hot else np.zeros(len(found), np.int64)
    df = np.repeat(count + more, count)
    keep = df > 1
    t, c, df = t[keep], c[keep], df[keep]
    for k in range(0, len(t), 100_000):
        part = slice(k, k + 100_000)
        yield pa.record_batch({"a": t[part], "b": c[part], "c": df[part].astype(np.int32), "many": pa.nulls(len(t[part]), _MANY), "kind": np.full(len(t[part]), INC, np.int32)})
    if hot:
        own = dict(zip(found.tolist(), count.tolist()))
        yield pa.record_batch({"a": np.fromiter(hot, np.int64, len(hot)), "b": np.zeros(len(hot), np.int64), "c": np.array([n + own.get(x, 0) for x, n in hot.items()], np.int32), "many": pa.nulls(len(hot), _MANY), "kind": np.full(len(hot), HOT_DF, np.int32)})




def _alpha(n, percent: int):
    """Least overlap of a set of n with any partner."""
    return F.ceil(n * F.lit(percent) / F.lit(100)).cast("int")


def _by_key(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """Equi-join of tables that grow with the data: never a broadcast chosen from the size of compressed files."""
    return a.join(b.hint("merge"), on, how)


class JaccardJoin:
    """components(docs) -> one row per document. width: words of a shingle; percent: threshold in hundredths."""

    def __init__(self, spark: SparkSession, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES):
        self.spark, self.width, self.percent, self.id_col, self.text_col, self.range_bytes = spark, width, percent, id_col, text_col, range_bytes
        self.scratch = Scratch(spark, "jaccard")

    def _incidences(self, docs: DataFrame, marks: tuple[str, ...]):
        """marks: long columns that the rows of documents carry along in `many`."""
        text = F.col(self.text_col).cast("string")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        each = max(1, -(-size // (self.range_bytes * parts)))  # ranges that one partition owns, one after the other
        mark = F.array(*marks).cast("array<long>") if marks else F.lit(None).cast("array<long>")
        rows = docs.select(F.col(self.id_col).cast("long"), text, mark.alias("many")).mapInArrow(_mapper(self.width, parts * each), _MAP)
        owned = rows.repartitionById(parts, F.floor(F.col("r") / each).cast("int"))
        owned = (owned.sortWithinPartitions("r") if each > 1 else owned).mapInArrow(_owner, _OUT)
        return self.scratch.keep(owned, "incidences", ("kind",))

    def _shared_sets(self, found: DataFrame, classes: DataFrame) -> DataFrame:
        """(cls, n, s, tok: shared shingles in the common order) of the classes that can have partners."""
        frequent = found.where(f"kind = {HOT_DF}").select("a", F.col("c").alias("df"))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # Pieces are dealt out evenly between the join by shingle and the listing of their classes.
        pieces = _by_key(found.where(f"kind = {HOT_INC}").select("a", "many"), frequent, "a").repartition(parts)
        direct = pieces.select("a", F.explode("many").alias("b"), "df")
        all_rows = found.where(f"kind = {INC}").select("a", "b", F.col("c").alias("df")).unionByName(direct)
        sets = all_rows.groupBy(F.col("b").alias("cls")).agg(F.sort_array(F.collect_set(F.struct(F.col("df").cast("int").alias("df"), F.col("a").alias("t")))).alias("tok"))
        sets = _by_key(sets.withColumn("s", F.size("tok")), classes.select("cls", "n"), "cls")
        return sets.where(F.col("s") >= _alpha(F.col("n"), self.percent))

    def _level(self, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        """state: (h, c, n, f, g, u, d, top_f, best_g, members), class c as its difference D from the centre of cluster h. d: D's elements that
        others of h share, as (frequency, element), in that order; u: how many it has besides; top_f, best_g: the greatest f and least g of h, best_g
        null if no member is linked by its g alone. With w = 100 + percent, s shared shingles and n all: f = w s - 2 percent n,
        g = w |D| - f. Then c and c' link iff 2 w |D & D'| >= g + g', hence those with g + best_g <= 0, the near ones, link with the
        nearest. Pairs of near ones are not met again.

        Returns links (u, v) and the buckets' (h, t, hub, members, c) that become clusters."""
        w, keep = 100 + self.percent, self.scratch.keep
        # A partner is of the same cluster and has at most n * 100 / percent shingles, so its f is at most this.
        partner_f = F.least(F.col("top_f").cast("double"), F.col("n") * F.lit((100 - self.percent) * 100.0 / self.percent))
        size = F.size("d")
        near = F.coalesce(F.col("g") + F.col("best_g") <= 0, F.lit(False))
        # A near one meets only such with g' > -best_g, so that it shares more than (g - best_g) / 2 w with any of them.
        short = F.when(near, size - F.floor((F.col("g") - F.col("best_g")) / (2 * w)).cast("int")).otherwise(F.floor(F.col("f") / w).cast("int") + 1 - F.col("u"))
        long = F.when(near, short).otherwise(F.greatest(short, F.floor((F.col("f") + partner_f) / w).cast("int") + 1 - F.col("u")))
        most = F.greatest(F.lit(1), F.ceil((F.col("g") - partner_f) / w).cast("int"))
        # The overlap is |d| at most: what a near one needs to reach any that is not, and the others any at all.
        reach = 2 * w * size - F.col("g")
        able = F.when(near, reach > -F.col("best_g")).otherwise(F.coalesce(reach >= F.col("best_g"), F.lit(True)))
        state = state.withColumns({"short": short, "long": long, "most": most, "near": near, "reach": reach}).where(able & (F.col("long") + F.col("most") > 0))

        def cost(k: int):
            head = F.slice("d", F.lit(1), F.greatest(F.lit(0), F.least(size, F.col("long") + (k - 1))))
            each = lambda x: F.when(x["df"] > BUCKET, 2.0 * size).otherwise(x["df"] + VERIFY_COST * (x["df"] - 1) / k)  # noqa: E731  in a cluster, two differences are written and no pairs
            return F.when(F.lit(k) <= F.col("most"), F.struct(F.aggregate(head, F.lit(0).cast("double"), lambda acc, x: acc + each(x)).alias("cost"), F.lit(k).alias("l")))

        chosen = state.withColumn("l", F.array_min(F.array_compact(F.array(*[cost(k) for k in range(1, MAX_MULTI + 1)])))["l"])
        head = F.slice("d", F.lit(1), F.greatest(F.lit(0), F.least(size, F.col("long") + F.col("l") - 1)))
        rows = chosen.select("h", "c", "n", "f", "g", "u", "l", "near", "reach", "members", (F.col("short") + F.col("l") - 1).alias("short"), F.posexplode(head).alias("at", "x"))
        every = keep(rows.select("h", F.col("x.t").alias("t"), "c", "n", "f", "g", "l", "near", "reach", "members", (F.col("at") + F.col("u")).alias("at"), (F.col("at") < F.col("short")).alias("short")), "prefixes")
        # Two that link have g <= reach of the other. Who finds nobody in a bucket for whom both hold doesn't count there.
        bounds = every.groupBy("h", "t").agg(F.count("*").alias("all"), F.min("g").alias("low"), F.max("reach").alias("high"), F.min(F.when(~F.col("near"), F.col("g"))).alias("low_far"))
        rows = _by_key(every, bounds.where("all > 1 and low_far is not null"), ["h", "t"]).where("if(near, reach >= low_far, reach >= low and g <= high)")
        rows = keep(rows.drop("all", "low", "high", "low_far", "reach"), "able")
        self.scratch.drop(every)
        buckets = rows.groupBy("h", "t").agg(F.count("*").alias("all"), F.count_if("short").alias("k"), F.count_if(~F.col("near")).alias("far"), F.first("members").alias("members"), F.min(F.when(F.col("short"), F.struct(F.xxhash64("c").alias("o"), "c"))).alias("hub"))
        buckets = keep(buckets.where("all > 1 and k > 0 and far > 0").select("h", "t", "k", "members", F.col("hub.c").alias("hub")), "buckets")

        own = keep(_by_key(rows, buckets.where(F.col("k") <= BUCKET).select("h", "t"), ["h", "t"]), "small")  # a table, so that the join below can split a bucket
        a, b = (own.select("h", "t", *(F.col(x).alias(x + s) for x in ("c", "n", "f", "g", "l", "at", "short", "near"))) for s in ("1", "2"))
        before = (F.col("g1") < F.col("g2")) | ((F.col("g1") == F.col("g2")) & (F.col("c1") < F.col("c2")))
        # With |D| = (f + g) / w, the overlap that this very pair needs bounds the place of a common element in either prefix.
        half, need = (F.col("f1") + F.col("f2")) / (2 * w), F.least("l1", "l2") - 1
        skew = (F.col("f1") + F.col("g1") - F.col("f2") - F.col("g2")) / (2 * w)
        early = (F.col("at1") <= half + skew + need) & (F.col("at2") <= half - skew + need)
        met = _by_key(a.where("short1"), b.where("not near2"), ["h", "t"]).where(before & early & (F.col("g1") + F.col("g2") > 0) & self._size_fits("n1", "n2"))
        pairs = met.groupBy("h", "c1", "c2").agg(F.count("*").alias("met"), F.first(F.least("l1", "l2")).alias("need"), F.first(F.col("g1") + F.col("g2")).alias("gg")).where("met >= need").select("h", "c1", "c2", "gg")
        one = state.select("h", F.col("c").alias("c1"), F.col("d.t").alias("d1"))
        other = state.select("h", F.col("c").alias("c2"), F.col("d.t").alias("d2"))
        checked = _by_key(_by_key(pairs, one, ["h", "c1"]), other, ["h", "c2"]).where(F.size(F.array_intersect("d1", "d2")) * (2 * w) >= F.col("gg"))
        links = keep(checked.select(F.col("c1").alias("u"), F.col("c2").alias("v")).distinct(), "links")
        large = buckets.where(F.col("k") > BUCKET).select("h", "t", "hub", "members")
        following = keep(_by_key(rows.drop("members"), large, ["h", "t"]).where("short or not near").select("h", "t", "hub", "members", "c"), "large")
        self.scratch.drop(rows)
        return links, following

    def _clusters(self, large: DataFrame, first: bool) -> DataFrame:
        """(h2, h, hub, c): the buckets of one hub as one cluster, or each as its own where that would hold over MOST_OF of cluster h.
        From the first level, where there are no clusters yet, all buckets of a hub are one, and hubs of one group are."""
        if first:
            # Hubs of one group share most of their members, which need not be described once for each: where more than half of a hub's classes have
            # one least hub, its buckets go to the cluster of that one.
            held = self.scratch.keep(large.select("hub", "c").distinct(), "held")
            least = held.groupBy("c").agg(F.min(F.struct(F.xxhash64("hub").alias("o"), "hub"))["hub"].alias("to"))
            votes = _by_key(held, least, "c").groupBy("hub", "to").agg(F.count("*").alias("votes"))
            votes = votes.groupBy("hub").agg(F.sum("votes").alias("held"), F.max(F.struct("votes", "to")).alias("top"))
            names = votes.select("hub", F.when(2 * F.col("top.votes") > F.col("held"), F.col("top.to")).otherwise(F.col("hub")).alias("h2"))
            names = self.scratch.keep(_by_key(large.select("h", "t", "hub").distinct(), names, "hub").select("h", "t", "h2"), "names")
            return self.scratch.keep(_by_key(large, names, ["h", "t"]).select("h2", "h", F.col("h2").alias("hub"), "c").distinct(), "clusters")
        buckets = large.select("h", "t", "hub", "members").distinct()
        held = large.select("h", "hub", "c").distinct().groupBy("h", "hub").agg(F.count("*").alias("held"))
        name = F.when(F.col("held") > MOST_OF * F.col("members"), F.xxhash64("h", "hub", "t")).otherwise(F.xxhash64("h", "hub"))
        names = self.scratch.keep(_by_key(buckets, held, ["h", "hub"]).select("h", "t", name.alias("h2")), "names")
        return self.scratch.keep(_by_key(large, names, ["h", "t"]).select("h2", "h", "hub", "c").distinct(), "clusters")

    def _differences(self, clusters: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        """clusters over members of state -> the state of the next level, and links of the near members with the one nearest to the centre."""
        keep, w = self.scratch.keep, 100 + self.percent
        elements = state.select("h", "c", F.col("d.t").alias("t"))
        at = _by_key(clusters, state.select("h", "c", "n", "f", "u", F.col("d.t").alias("t")), ["h", "c"])
        at = _by_key(at, elements.select("h", F.col("c").alias("hub"), F.col("t").alias("th")), ["h", "hub"])
        from_hub = keep(at.select(F.col("h2").alias("h"), "c", "n", "f", "u", F.concat(F.array_except("t", "th"), F.array_except("th", "t")).alias("t")), "from-hub")
        # What over half of the members hold goes to the centre: it is then in the differences of the others.
        sizes = from_hub.groupBy("h").agg(F.count("*").alias("members"), F.max("f").alias("top_f"))
        counted = from_hub.select("h", F.explode("t").alias("t")).groupBy("h", "t").agg(F.count("*").alias("df")).where("df > 1")
        counted = _by_key(counted, sizes.select("h", "members"), "h").withColumn("centre", 2 * F.col("df") > F.col("members"))
        counted = keep(counted.select("h", "t", F.when(F.col("centre"), F.col("members") - F.col("df")).otherwise(F.col("df")).cast("int").alias("df"), "centre"), "counted")
        centre = counted.where("centre").groupBy("h").agg(F.collect_list("t").alias("tc"))  # twice a member's mean difference at most
        known = keep(_by_key(sizes, centre, "h", "left").select("h", "members", "top_f", F.coalesce("tc", F.array().cast("array<long>")).alias("tc")), "known")
        moved = _by_key(from_hub, known, "h").select("h", "c", "n", "f", "u", "members", "top_f", F.concat(F.array_except("t", "tc"), F.array_except("tc", "t")).alias("t"))
        moved = keep(moved.withColumn("g", w * (F.col("u") + F.size("t")) - F.col("f")), "differences")
        nearest = moved.groupBy("h").agg(F.min(F.struct("g", "c")).alias("best"))
        each = moved.select("h", "c", F.explode("t").alias("t"))
        shared = _by_key(each, counted.where("df > 1").select("h", "t", "df"), ["h", "t"]).groupBy("h", "c").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("d"))
        shared = _by_key(moved.withColumn("all", F.size("t")).drop("t"), shared, ["h", "c"], "left").withColumn("d", F.coalesce("d", F.array().cast("array<struct<df: int, t: bigint>>")))
        best_g = F.when(F.col("best.g") <= 0, F.col("best.g"))
        out = _by_key(shared.withColumn("u", F.col("u") + F.col("all") - F.size("d")), nearest, "h").withColumn("best_g", best_g)
        out = keep(out.select("h", "c", "n", "f", "g", "u", "d", "top_f", "best_g", "members", F.col("best.c").alias("nearest")), "state")
        star = out.where((F.col("g") + F.col("best_g") <= 0) & (F.col("c") != F.col("nearest"))).select(F.col("nearest").alias("u"), F.col("c").alias("v"))
        return out.drop("nearest"), star.distinct()

    def _size_fits(self, a: str, b: str):
        return F.least(a, b) * 100 >= F.lit(self.percent) * F.greatest(a, b)

    def class_links(self, found: DataFrame, classes: DataFrame) -> DataFrame:
        """(node, component) over classes that link with another one; component is the least class."""
        w = 100 + self.percent
        sets = self._shared_sets(found, classes).withColumn("f", w * F.col("s") - 2 * self.percent * F.col("n"))
        sets = self.scratch.keep(sets.select(F.lit(0).cast("long").alias("h"), F.col("cls").alias("c"), "n", "f", (w * F.col("s") - F.col("f")).alias("g"), F.lit(0).alias("u"), F.col("tok").alias("d")), "sets")
        top = sets.agg(F.max("f")).first()[0]
        state, edges = sets.withColumns({"top_f": F.lit(top or 0), "best_g": F.lit(None).cast("long"), "members": F.lit(None).cast("long")}), None
        while True:
            links, large = self._level(state)
            first, edges = edges is None, links if edges is None else edges.unionByName(links)
            if large.isEmpty():
                return connected_components(edges, self.scratch)
            state, star = self._differences(self._clusters(large, first), state)
            edges = edges.unionByName(star)

    def _classes(self, docs: DataFrame, marks: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
        """(id, cls, n, many) of every row, and (cls, least) of every class: the least (id is null, id, marks) of its component."""
        found = self._incidences(docs, marks)
        rows = found.where(f"kind = {DOC}").select(F.col("a").alias("id"), F.col("b").alias("cls"), F.col("c").alias("n"), "many")
        rep = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("many"))
        classes = self.scratch.keep(rows.where("n > 0").groupBy("cls").agg(F.min(rep).alias("rep"), F.max("n").alias("n")), "classes")
        comps = self.class_links(found, classes)
        least = _by_key(comps, classes.withColumnRenamed("cls", "node"), "node").groupBy("component").agg(F.min("rep").alias("least"))
        moved = _by_key(comps, least, "component").select(F.col("node").alias("cls"), "least")
        named = _by_key(classes, moved, "cls", "left").select("cls", F.coalesce("least", "rep").alias("least"))
        return rows, self.scratch.keep(named, "named")  # a table, so that a hot class can be split in the join back to its rows

    def components(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_shingles, component_id): component_id is the smallest id reachable by links, the row's own included.

        A null text or one without words has an empty set and links with nothing. Rows that repeat an id are kept; a
        null id is kept and is no candidate for the smallest id unless all are null. Texts are taken whole, however long. Other columns are
        ignored. An empty table gives an empty one."""
        rows, named = self._classes(docs, ())
        return _by_key(rows, named, "cls", "left").select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("least.id", "id").alias("component_id"))


def deduplicate(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of linked documents: that of the smallest id, then of the smallest hash of the text; all columns stay.

    Decisions are taken by id and text, so that a repeated id loses only the rows whose own text is a copy. Rows equal in both are
    one row; a null id is larger than any other. Rows without words link with nothing and stay, all of them. Extra columns don't
    count; names that start with two underscores are this function's. An empty table gives an empty one."""
    # Two hashes of id and text address a row.
    marks = {"__k1": F.xxhash64("doc_id", "text"), "__k2": F.xxhash64(F.lit(1), "text", "doc_id")}
    full = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows, named = JaccardJoin(spark, width, percent)._classes(docs.select("doc_id", "text").withColumns(marks), tuple(marks))
    own = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("many"))
    gone = _by_key(rows, named, "cls").where(own != F.col("least")).select(*[F.get("many", F.lit(k)).alias(m) for k, m in enumerate(marks)]).distinct()
    kept = _by_key(docs.where(full).withColumns(marks).dropDuplicates(list(marks)), gone, list(marks), "left_anti")
    return kept.select(*docs.columns).unionByName(docs.where(~full).select(*docs.columns))
