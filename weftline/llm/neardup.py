"""MinHash near-duplicates by tensored banding (operator 5).

A text's set is its distinct 3-word shingles (64-bit hashes of lower-cased words). Texts of equal sets
form a class first, by a map-side combined aggregate, and only the class's smallest doc_id goes on: a
group of exact copies costs one row however large it is.

Tensoring: `2 * M` small collections of `R` minhashes give M * M table keys, one per pair (i, j) of a
collection of either side, so 2 * M * R minhash values stand for M * M * 2R. With R = 3, M = 8 a pair at
Jaccard 0.85 shares a key with probability 0.999, and one at 0.9 with 0.9999.

Candidates of a bucket are not paired with each other. Each round pairs every unconnected member with
its bucket's leader (a linear number of pairs), confirms on full sets, and merges components; members
that a confirmed link has joined need no further pair. What is left after `ROUNDS` rounds (members of
buckets that hold several components) goes through an exact prefix-filter join: linked sets share one of
their rarest shingles, of the longer set among the first 15 %, of the shorter among the first 8 %, so a
family of texts that share a template and differ in more than that meets in no key; sizes, the places of
the shared shingle and components prune within the join. No link between components of a bucket is lost
and nothing is capped. Components are found so; the number of links is counted afterwards over all pairs
of each component. Hot keys in the joins are rows of a few integers which AQE splits; full sets travel
with pairs alone, which name the class beside the id: each class has one set, however many rows or other
texts its doc_id has.

Defined cases: texts without words (null, empty, blank) have an empty set and stay alone; fewer than
three words make one shingle of the whole sequence; several rows with one doc_id are all kept or all
dropped with the class of each row's own text; rows without doc_id are left out of links and kept; an
empty table gives no rows; only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .common import U64

R, M, ROUNDS = 3, 8, 2
NUM, DEN = 85, 100
#: What names a pair of texts.
PAIR = ["a", "ca", "b", "cb"]
#: Shingles of a block and columns of a matrix in the count of links.
BLOCK, COLUMNS = 1 << 19, 1 << 12
_rng = np.random.default_rng(77)
_A = _rng.integers(1, 1 << 63, 2 * M * R, dtype=np.uint64) * U64(2) + U64(1)
_B = _rng.integers(1, 1 << 63, 2 * M * R, dtype=np.uint64)


def shingle_sets(c: common.Chunk) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a chunk."""
    low = common.Chunk(c.lo, c.hi, common.LOWER[c.data], c.offs)
    s, e, lim = common.words(low)
    h = common.span_hashes(low.data, s, e)
    g = common.ngram_hashes(h, 3)
    out = []
    for a, b in zip(lim[:-1].tolist(), lim[1:].tolist()):
        n = b - a
        if n >= 3:
            out.append(np.unique(g[a : b - 2]))
        elif n:
            out.append(common.ngram_hashes(h[a:b], n, 40 + n))
        else:
            out.append(h[:0])
    return out


def collections_of(x: np.ndarray) -> np.ndarray:
    """The 2 * M collection values of a set: each a mix of R minhashes."""
    low = np.full(len(_A), U64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for k in range(0, len(x), 4096):
            low = np.minimum(low, (x[k : k + 4096, None] * _A + _B).min(0))
        v = low.reshape(2 * M, R)
        out = np.arange(1, 2 * M + 1, dtype=np.uint64)
        for r in range(R):
            out = common.mix(out * U64(0x9FB21C651E98DF25) + v[:, r])
    return out


def _signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, parts): s1, s2 digest the set, parts are its collection values."""

    def run(batches):
        for b in batches:
            for c in common.chunks(b.column(1)):
                sets = shingle_sets(c)
                with np.errstate(over="ignore"):
                    s1 = np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64)
                    s2 = np.array([common.mix(x + U64(99)).sum(dtype=np.uint64) + U64(len(x)) for x in sets], np.uint64)
                parts = np.array([collections_of(x) for x in sets], np.uint64).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(c.lo, len(c)).cast(pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * M * len(c) + 1, 2 * M), pa.int32()), pa.array(parts.view(np.int64)))],
                    ["doc_id", "n_shingles", "s1", "s2", "parts"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, parts array<bigint>")


def _sets(docs: DataFrame) -> DataFrame:
    """(id, c, set) of every row: the full shingle sets, as bytes of sorted 64-bit hashes; c is the digest s1."""

    def run(batches):
        for b in batches:
            for c in common.chunks(b.column(1)):
                sets = shingle_sets(c)
                with np.errstate(over="ignore"):
                    s1 = np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.lo, len(c)).cast(pa.int64()), pa.array(s1.view(np.int64)), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "c", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, "id bigint, c bigint, set binary")


def _class_sets(docs: DataFrame, members: DataFrame, repeated: DataFrame) -> DataFrame:
    """(id, c, set): one row for each of members (id, c). repeated: the doc_ids that several rows have."""
    members = members.select("id", "c").distinct()
    ids = members.select(F.col("id").alias("doc_id")).distinct()
    sets = common.persist(_sets(docs.join(ids, "doc_id", "left_semi")), "nd-sets")
    again = common.persist(repeated.join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("id")), "nd-again")
    if not again.limit(1).count():
        common.drop(again)
        return sets
    own = sets.join(again, "id", "left_semi").join(members, ["id", "c"], "left_semi").groupBy("id", "c").agg(F.first("set").alias("set"))
    out = common.persist(sets.join(again, "id", "left_anti").unionByName(own), "nd-sets")
    common.drop(sets, again)
    return out


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, ca, b, cb, inter, uni) of pairs (a, ca, b, cb) of ids and classes: exact sizes of intersection and union of the full sets."""

    def run(batches):
        for b in batches:
            inter, uni = [], []
            x, y = b.column(4), b.column(5)
            for i in range(b.num_rows):
                u, v = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                if len(u) > len(v):
                    u, v = v, u
                at = np.searchsorted(v, u)
                n = int((v[np.minimum(at, len(v) - 1)] == u).sum()) if len(v) else 0
                inter.append(n), uni.append(len(u) + len(v) - n)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(inter, pa.int64()), pa.array(uni, pa.int64())], ["a", "ca", "b", "cb", "inter", "uni"])

    side = lambda x: sets.select(F.col("id").alias(x), F.col("c").alias(f"c{x}"), F.col("set").alias(f"s{x}"))
    j = pairs.join(side("b"), ["b", "cb"]).join(side("a"), ["a", "ca"])
    return j.select("a", "ca", "b", "cb", "sa", "sb").mapInArrow(run, "a bigint, ca bigint, b bigint, cb bigint, inter bigint, uni bigint")


def components(links: DataFrame) -> DataFrame:
    """(id, comp): smallest id reachable, for every id of links (a, b).

    Alternates taking the smallest label among neighbours (combined before the shuffle) with pointer
    jumping, until nothing changes; stars, which leader rounds yield, settle at once. Each step is a
    written table.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("a <> b")
    both = common.persist(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    label = common.persist(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("comp")), "cc")
    written = label
    while True:
        # hook: along every edge the smaller label; also onto the label's own node
        near = both.join(label.withColumnRenamed("id", "v"), "v").select(F.col("u").alias("id"), "comp")
        mine = label.join(near.groupBy("id").agg(F.min("comp").alias("m")), "id").select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("new"))
        roots = mine.where("new < old").groupBy(F.col("old").alias("id")).agg(F.min("new").alias("r"))
        hooked = common.persist(mine.join(roots, "id", "left").select("id", "old", F.least("new", F.coalesce("r", "new")).alias("p")), "cc-hook")
        jump = hooked.join(hooked.select(F.col("id").alias("p"), F.col("p").alias("pp")), "p", "left")
        nxt = common.persist(jump.select("id", "old", F.least("p", F.coalesce("pp", "p")).alias("comp")), "cc")
        common.drop(hooked, written)
        label, written = nxt.select("id", "comp"), nxt
        if not nxt.where("comp <> old").limit(1).count():
            common.drop(both)
            return label


def dedup(docs: DataFrame, count: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, links): one row per row of `docs`.

    links: links of the row's class representative to representatives of other classes, counted exactly over
    all pairs of its component; null without `count`.
    """
    sig = common.persist(_signatures(docs), "nd-sig")
    some = sig.where("n_shingles > 0 and doc_id is not null")
    reps = some.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    # the class's parts are those of any of its rows; rows that repeat come once
    cls = common.persist(reps, "nd-class")
    keyed = some.join(cls, ["n_shingles", "s1", "s2"]).where("doc_id = rep").groupBy("rep", "n_shingles", "s1", "s2").agg(F.first("parts").alias("parts"))
    keyed = common.persist(keyed.select(F.col("rep").alias("id"), "n_shingles", F.col("s1").alias("c"), "parts"), "nd-rep")
    repeated = common.persist(some.groupBy("doc_id").count().where("count > 1").select("doc_id"), "nd-repeated")
    keys = keyed.select("id", "n_shingles", "c", F.explode(F.expr(f"flatten(transform(slice(parts, 1, {M}), x -> transform(slice(parts, {M + 1}, {M}), y -> xxhash64(x, y))))")).alias("key"))
    lead = common.persist(keys.groupBy("key").agg(F.min(F.struct("id", "c")).alias("_f"), F.max("id").alias("_last")).where("_f.id <> _last").select("key", F.col("_f.id").alias("lead"), F.col("_f.c").alias("lead_c")), "nd-lead")
    bucket = common.persist(keys.join(lead, "key"), "nd-bucket")
    comp = components(_links(docs, bucket, repeated))
    degree = _degrees(docs, comp, keyed.select("id", "n_shingles", "c"), repeated) if count else comp.select("id", F.lit(None).cast("bigint").alias("count"))
    full = cls.join(comp, cls.rep == comp.id, "left").drop("id").join(degree, cls.rep == degree.id, "left")
    common.drop(lead, bucket, keyed, repeated)
    full = full.select("n_shingles", "s1", "s2", F.coalesce("comp", "rep").alias("component_id"), (F.coalesce("count", F.lit(0)) if count else F.col("count")).alias("links"))
    # rows without a set, or without an id, stand for themselves
    out = sig.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "s1", "s2").join(full, ["n_shingles", "s1", "s2"])
    out = out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "links")
    rest = sig.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(0).cast("bigint").alias("links"))
    return out.unionByName(rest)


def _links(docs: DataFrame, bucket: DataFrame, repeated: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between class representatives of one bucket table (key, id, n_shingles, c, lead, lead_c).

    A bucket's leader is one class, so its pairs stay linear where one id has many texts in it; those texts are one node.
    """
    sets = _class_sets(docs, bucket, repeated)
    fits = f"least(n_shingles, n_lead) * {DEN} >= greatest(n_shingles, n_lead) * {NUM}"
    done, active, led, written = None, bucket, None, []
    for _ in range(ROUNDS):
        if active.limit(1).count() == 0:
            break
        heads = active.where("id = lead and c = lead_c").select("key", F.col("n_shingles").alias("n_lead"))
        pairs = active.where("id <> lead").join(heads, "key").where(fits)
        pairs = pairs.selectExpr("least(id, lead) as a", "if(id < lead, c, lead_c) as ca", "greatest(id, lead) as b", "if(id < lead, lead_c, c) as cb").distinct()
        if done is not None:
            pairs = pairs.join(done.select(*PAIR), PAIR, "left_anti")
        got = common.persist(_confirm(pairs, sets), "nd-confirmed")
        done = got if done is None else done.unionByName(got)
        links = done.where(F.col("inter") * DEN >= F.col("uni") * NUM)
        comp = components(links)
        leads = active.where("id = lead and c = lead_c").select("key", "id")
        led = leads if led is None else led.unionByName(leads)
        labelled = bucket.drop("lead", "lead_c").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        open_ = labelled.groupBy("key").agg(F.min("comp").alias("_c"), F.max("comp").alias("_d")).where("_c <> _d").select("key")
        labelled = common.persist(labelled.join(open_, "key", "left_semi"), "nd-open")
        # components that have had a leader in the bucket need no other
        first = led.join(labelled, ["key", "id"]).select("key", F.col("comp").alias("_lc"))
        rest = labelled.join(first.distinct(), (labelled.key == first.key) & (labelled.comp == first._lc), "left_anti")
        nxt = rest.groupBy("key").agg(F.min(F.struct("id", "c")).alias("_f")).select("key", F.col("_f.id").alias("lead"), F.col("_f.c").alias("lead_c"))
        active = common.persist(labelled.join(nxt, "key"), "nd-active")
        written += [got, labelled, active]
    if done is None:
        return docs.sparkSession.createDataFrame([], "a bigint, b bigint")
    links = done.where(F.col("inter") * DEN >= F.col("uni") * NUM)
    if labelled.limit(1).count():
        # the exact rest of every bucket that still holds two components or more, led or not
        pairs = _prefix_pairs(labelled.select("id", "n_shingles", "c", "comp").distinct(), sets).join(done.select(*PAIR), PAIR, "left_anti")
        got = common.persist(_confirm(pairs, sets), "nd-rest")
        links = links.unionByName(got.where(F.col("inter") * DEN >= F.col("uni") * NUM))
        written.append(got)
    out = common.persist(links.select("a", "b").distinct(), "nd-links")
    common.drop(sets, *written)
    return out


def _prefix_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, ca, b, cb): every pair of members (id, n_shingles, comp and, where ids have several texts, c) of different components that may be linked.

    Shingles are ordered by how many members hold them, then by hash; those of one member come first and need no key.
    A set of n shingles is looked up by its first n - ceil(t n) + 1 and found under its first n - ceil(2 t / (1 + t) n) + 1.
    """

    def run(batches):
        for b in batches:
            sets_ = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(2)]
            n = [len(x) for x in sets_]
            ids, cs, sh = np.repeat(b.column(0).to_numpy(), n), np.repeat(b.column(1).to_numpy(), n), np.concatenate(sets_ or [np.zeros(0, np.int64)])
            for lo in range(0, len(sh), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 17)]) for x in (ids, cs, sh)], ["id", "c", "sh"])

    # of a doc_id with several texts those that stand for their class
    text = [x for x in ("id", "c") if x in members.columns]
    own_sets = sets.withColumn("n_shingles", (F.length("set") / 8).cast("bigint")).join(members, [*text, "n_shingles"], "left_semi")
    each = common.persist(own_sets.select("id", "c", "set").mapInArrow(run, "id bigint, c bigint, sh bigint"), "nd-shingles")
    often = each.groupBy("sh").agg(F.count("*").alias("df")).where("df > 1")
    own = W.partitionBy("id", "c")
    shared = each.join(often, "sh").withColumns({"_k": F.row_number().over(own.orderBy("df", "sh")), "_m": F.count("*").over(own)}).join(members, text)
    at = shared.withColumn("pos", F.col("n_shingles") - F.col("_m") + F.col("_k")).where(f"pos <= n_shingles - ceil({NUM} * n_shingles / {DEN}) + 1")
    at = common.persist(at.select("sh", "id", "c", "comp", F.col("n_shingles").alias("n"), "pos"), "nd-prefix")
    x = at.select("sh", F.col("id").alias("x"), F.col("c").alias("tx"), F.col("comp").alias("cx"), F.col("n").alias("nx"), F.col("pos").alias("px"))
    y = at.where(f"pos <= n - ceil({2 * NUM} * n / {NUM + DEN}) + 1").select("sh", F.col("id").alias("y"), F.col("c").alias("ty"), F.col("comp").alias("cy"), F.col("n").alias("ny"), F.col("pos").alias("py"))
    fits = f"cx <> cy and (ny < nx or (ny = nx and y < x)) and ny * {DEN} >= nx * {NUM} and (1 + least(nx - px, ny - py)) * {NUM + DEN} >= {NUM} * (nx + ny)"
    out = common.persist(x.join(y, "sh").where(fits).selectExpr("least(x, y) as a", "if(x < y, tx, ty) as ca", "greatest(x, y) as b", "if(x < y, ty, tx) as cb").distinct(), "nd-pairs")
    common.drop(each, at)
    return out


def _degrees(docs: DataFrame, comp: DataFrame, sizes: DataFrame, repeated: DataFrame) -> DataFrame:
    """(id, count) of the links of each id among all members of its component (id, comp).

    Members in order of size form blocks of at most BLOCK shingles (or one longer set), and every two blocks whose
    sizes allow a link are compared as matrices. Two members alone are linked, as the component comes from a link.
    """
    members = comp.groupBy("comp").agg(F.count("*").alias("n"))
    sized = common.persist(comp.join(members, "comp"), "nd-members")
    pair = sized.where("n = 2").select("id", F.lit(1).cast("bigint").alias("count"))
    w = W.partitionBy("comp").orderBy("n_shingles", "id").rowsBetween(W.unboundedPreceding, 0)
    # a member weighs at least BLOCK / 1024, so a block has at most about 1024 members
    at = sized.where("n > 2").join(sizes, "id").withColumn("block", F.floor((F.sum(F.greatest("n_shingles", F.lit(BLOCK // 1024))).over(w) - 1) / BLOCK))
    at = common.persist(at.select("id", "c", "comp", "block", "n_shingles"), "nd-blocks")
    span = at.groupBy("comp", "block").agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"))
    x, y = span.select("comp", F.col("block").alias("i"), "hi"), span.select("comp", F.col("block").alias("j"), "lo")
    both = x.join(y, "comp").where(f"i <= j and hi * {DEN} >= lo * {NUM}").select("comp", "i", "j")
    sides = both.select("comp", "i", "j", F.explode(F.expr("if(i = j, array(i), array(i, j))")).alias("block"))
    sets = _class_sets(docs, at, repeated)
    rows = at.join(sets, ["id", "c"]).join(sides, ["comp", "block"]).select("comp", "i", "j", "block", "id", "set")

    def run(t):
        block, ids = t.column("block").to_numpy(), t.column("id").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set")]
        first = block == t.column("i")[0].as_py()
        one = t.column("i")[0] == t.column("j")[0]
        left = np.flatnonzero(first)
        right = left if one else np.flatnonzero(~first)
        size = np.array([len(x) for x in sets], np.int64)
        _, col, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # shingles of a single member add to no intersection
        keep = seen > 1
        place = np.where(keep, np.cumsum(keep) - 1, -1)[col]
        row = np.repeat(np.arange(len(sets)), size)
        row, place = row[place >= 0], place[place >= 0]
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        inter = np.zeros((len(left), len(right)), np.int64)
        for lo in range(0, total := int(keep.sum()), COLUMNS):
            a, b = np.searchsorted(place, [lo, lo + COLUMNS])
            m = np.zeros((len(sets), min(COLUMNS, total - lo)), np.float32)
            m[row[a:b], place[a:b] - lo] = 1
            inter += (m[left] @ m[right].T).astype(np.int64)
        linked = (inter * DEN >= (size[left][:, None] + size[right][None, :] - inter) * NUM) & (ids[left][:, None] != ids[right][None, :])
        if one:
            out, n = ids[left], linked.sum(1)
        else:
            out, n = np.concatenate([ids[left], ids[right]]), np.concatenate([linked.sum(1), linked.sum(0)])
        return pa.table({"id": pa.array(out, pa.int64()), "count": pa.array(n, pa.int64())})

    many = rows.groupBy("comp", "i", "j").applyInArrow(run, "id bigint, count bigint")
    out = common.persist(pair.unionByName(many.groupBy("id").agg(F.sum("count").alias("count"))), "nd-degree")
    common.drop(sets)
    return out


def keep_documents(df: DataFrame) -> DataFrame:
    """The rows of `df` (all columns) of each component's smallest doc_id; of rows repeating that id, all."""
    gone = dedup(df, count=False).where(~F.col("kept")).select("doc_id").distinct()
    return df.join(gone, "doc_id", "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept", "links")
