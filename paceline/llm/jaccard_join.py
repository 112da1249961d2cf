"""N-gram Jaccard join: components of documents that share most of their shingles.

Exact: every two different shingle sets with 100 * intersection >= 80 * union are
in one component.  The steps:

1.  Each text becomes a set of 64-bit shingle hashes, named by a digest; equal
    sets are one node from here on, so exact copies cost nothing more.
2.  A set's prefix is its first n - ceil(0.8 n) + 1 hashes in a fixed order; sets
    that link share a hash of their prefixes.  Hashes frequent in a sample are
    last in that order, which keeps passages of many documents out of prefixes.
    The sample changes the order only: any order finds every link.
3.  Prefix hashes of one set only are dropped.  Each node is compared with one
    leader (the smallest node of a hash), the one it shares most hashes with,
    and the links so found are contracted to components.
4.  Hashes with many pairs of different components go through rounds: every
    component still open asks one other through one pair, the links are
    contracted, and hashes left with one component drop out.  A group of near
    copies shrinks to a few components so, by work in proportion to its size.
    Rounds end when one finds no link.
5.  Tiles decide what those hashes still hold.  A tile is the nodes that share
    a hash with one leader, of one band of sizes, cut into blocks of bounded
    bytes; only nodes outside the leader's largest component ask.  The bits two
    hashed bitmaps share bound the intersection from above; where that bound
    suffices, the sorted arrays are intersected.  Pairs that a tile's earlier
    links connect are passed over, so a tile gives fewer links than it has
    components.
6.  Hashes with few pairs give theirs as rows of a join by hash and band, kept
    where the number of hashes in common allows a link, and decided in the same
    way.

Defined results: a null text or one without words has an empty set, links with
nothing and is its own component; rows with equal doc_id share a component_id
where their texts link; the id of rows with a null doc_id is null unless they
link to numbered ones; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import BROADCAST_ROWS, checkpointed, compact, fresh_name, light, released, small, table
from paceline.llm.components import components
from paceline.llm.shingles import set_id, shingle_hashes

PERCENT = 80
#: One document in so many is in the sample that orders hashes, and so many of the sample make a hash frequent.
SAMPLE_RATE = 12
FREQUENT = 4
#: Bits of the bitmap of frequent hashes (8 MB, whatever the corpus); places that coincide only change the order.
FREQUENT_BITS = 1 << 26
#: Ratio of sizes within a band; 100 / PERCENT, so that links lie in one band or two adjacent.
BAND = 100 / PERCENT
#: Pairs of one prefix hash that are joined as rows; above, rounds and tiles of about so many bytes of hashes a side.
ROW_PAIRS = 4096
TILE_BYTES = 8 << 20
#: Bits a wanted document of the bitmap that spares a scan most other documents, and the most bits (128 MB).
BITS_A_DOCUMENT = 16
BITMAP_BITS = 1 << 30
#: Bytes of one of Spark's bitmaps.
BUCKET_BYTES = 4096


def _text_hash(text: Column) -> Column:
    """Tells rows that share a doc_id apart."""
    return F.xxhash64(text.cast("string"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [np.unique(h) for h in shingle_hashes([(t.as_py() or "").encode() for t in column])]


def _bitmap_of(places: DataFrame, bits: int) -> np.ndarray:
    """The bytes of a bitmap of so many bits, with the places (column at) set."""
    one = F.col("at") + 1  # Spark's buckets count from 1, so do their values
    held = places.groupBy(F.bitmap_bucket_number(one).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits"))
    out = np.zeros((-(-bits // (8 * BUCKET_BYTES)), BUCKET_BYTES), np.uint8)
    for row in held.collect():  # these bits at most
        out[row["k"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _set_at(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def frequent_hashes(docs: DataFrame) -> np.ndarray:
    """A bitmap of the hashes in FREQUENT or more documents of the sample.

    The sample is a fixed share of the corpus, so that a passage counts as
    frequent from the same number of documents on, however large the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(released(batches)):
            sets = _sets(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64))], ["h"])

    chosen = _texts(docs).where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(SAMPLE_RATE)) == 0)
    hot = chosen.mapInArrow(run, "h bigint").groupBy("h").count().where(F.col("count") >= FREQUENT)
    return _bitmap_of(hot.select(F.pmod("h", F.lit(FREQUENT_BITS)).alias("at")), FREQUENT_BITS)


def features(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """doc_id, of (a hash of the text), n_shingles, digest (the set's name, null when empty) and its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(released(batches)):
            sizes, names, prefixes = [], [], []
            for s in _sets(batch.column(1)):
                n = len(s)
                sizes.append(n)
                names.append(set_id(s) if n else None)
                common = _set_at(hot, (s % np.uint64(FREQUENT_BITS)).view(np.int64))
                s = np.concatenate([s[~common], s[common]])
                prefixes.append(s[: n - (n * PERCENT + 99) // 100 + 1 if n else 0].view(np.int64))
            at = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*prefixes, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), lists], ["doc_id", "of", "n_shingles", "digest", "prefix"])

    texts = _texts(docs).select("doc_id", "text", _text_hash(F.col("text")).alias("of"))
    return texts.mapInArrow(run, "doc_id bigint, of bigint, n_shingles bigint, digest binary, prefix array<bigint>")


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, bool)
    out[(s >> np.uint64(40)) % np.uint64(bits)] = True
    return np.packbits(out)  # a place is a hash modulo bits


def links(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether sorted sets a and b reach the similarity; bitmaps bound it first."""
    most = min(len(a), len(b))
    need = -(-percent * (len(a) + len(b)) // (100 + percent))
    if most < need:
        return False
    bits = 1 << max(6, (2 * max(len(a), len(b))).bit_length())
    x, y = bitmap(a, bits), bitmap(b, bits)
    # each shared hash sets one bit in both; hashes that fell on a bit already set may be shared too
    lost = most - int(np.bitwise_count(x if len(a) <= len(b) else y).sum())
    if int(np.bitwise_count(x & y).sum()) + lost < need:
        return False
    return intersect(a, b, percent)


def intersect(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """The same from the exact intersection."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link; sets: node, hashes (sorted, as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            x, y = batch.column(2), batch.column(3)
            keep = [links(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)) for i in range(batch.num_rows)]
            got = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            yield got

    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return left.join(pairs, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def node_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, hashes for the nodes (node, digest, doc_id of one document that has the set).

    A bitmap of hashed doc_ids, of some bits a wanted document, lets the scan
    pass over most other documents; a join drops those it let through.
    """
    nodes, wanted = compact(nodes)
    bits = min(BITMAP_BITS, 1 << max(16, (BITS_A_DOCUMENT * wanted).bit_length()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("at")
    held = _bitmap_of(nodes.select(place), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(released(batches)):
            batch = batch.filter(pa.array(_set_at(held, batch.column(2).to_numpy())))
            sets = _sets(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "hashes"])

    placed = _texts(docs).select("*", place)
    names = nodes.select("digest", "node")
    got = placed.mapInArrow(run, "digest binary, hashes binary").join(F.broadcast(names) if wanted <= BROADCAST_ROWS else names, "digest")
    return got.select("node", "hashes").dropDuplicates(["node"])


def may_link(count: Column, n: Column, m: Column) -> Column:
    """Whether sets of sizes n and m with ``count`` common prefix hashes may link.

    All common hashes up to the earlier end of the two prefixes are among those
    counted, so the intersection is at most their number and the rest of a set.
    """
    rest = lambda x: F.ceil(x * PERCENT / 100) - 1
    need = F.ceil(F.lit(PERCENT) * (n + m) / (100 + PERCENT))
    return (count + F.greatest(rest(n), rest(m)) >= need) & (100 * F.least(n, m) >= PERCENT * F.greatest(n, m))


def _band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(BAND))).cast("int")


def node_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between nodes (node, digest, doc_id, n, prefix) that give the components of all links."""
    entries = nodes.select("node", "n", F.explode("prefix").alias("key"))
    leaders = entries.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("other")).where("leader <> other").select("key", "leader")
    shared = checkpointed(entries.join(leaders, "key").select("key", "node", "n", "leader"))
    size = nodes.select("node", "n")
    star = shared.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("count"), F.first("n").alias("n")).join(size.toDF("leader", "m"), "leader")
    star = star.where(may_link(F.col("count"), F.col("n"), F.col("m"))).groupBy("node").agg(F.max_by("leader", F.struct("count", "leader")).alias("leader"))
    found = _decided(docs, nodes, star.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    members = shared.select("key", "node", "n").join(components(found), "node", "left").select("key", "node", "n", F.coalesce("comp", "node").alias("comp"))
    rest = checkpointed(_open(members))
    hot = light(checkpointed(_hot_keys(rest)))
    busy, links = _rounds(docs, nodes, checkpointed(rest.join(hot, "key")))
    links, _ = compact(links.unionByName(_tile_links(docs, nodes, busy)))
    few = _open(_relabelled(rest.join(hot, "key", "left_anti"), components(links)))
    pairs = _row_pairs(few.withColumn("band", _band(F.col("n"))))
    return found.unionByName(links.select("a", "b")).unionByName(_decided(docs, nodes, pairs))


def _open(members: DataFrame) -> DataFrame:
    """The rows (key, node, n, comp) of keys with nodes of several components."""
    several = members.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    return members.join(several, "key")


def _relabelled(members: DataFrame, comps: DataFrame) -> DataFrame:
    """members with each component in place of those it absorbed (node, comp)."""
    names = comps.select(F.col("node").alias("comp"), F.col("comp").alias("now"))
    return members.join(names, "comp", "left").select("key", "node", "n", F.coalesce("now", "comp").alias("comp"))


def _hot_keys(rest: DataFrame) -> DataFrame:
    """Keys with more than ROW_PAIRS pairs of nodes that a largest component's nodes are not asked from."""
    held = rest.groupBy("key", "comp").count().groupBy("key").agg(F.sum("count").alias("rows"), F.max("count").alias("most"))
    return held.where(F.col("rows") * (F.col("rows") - F.col("most")) > ROW_PAIRS).select("key")


def _rounds(docs: DataFrame, nodes: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What of members stays open, with current components, and the links found.

    links: a, b, comps and nodes alike.  In each round a key offers two nodes
    of different components, picked by a hash that changes with the round; each
    component asks through the node that shares most keys with one on offer.
    Rounds go on while half of those that ask find a link: whatever is left
    then, tiles decide.
    """
    links = nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    turn = 0
    while True:
        order = F.xxhash64("node", F.lit(turn))
        offered = members.groupBy("key", "comp").agg(F.min(F.struct(order.alias("at"), "node", "n", "comp")).alias("x"))
        offered = offered.groupBy("key").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        asked = members.join(offered, "key").select("node", "n", "comp", F.when(F.col("comp") == F.col("lo.comp"), F.col("hi")).otherwise(F.col("lo")).alias("to"))
        met = asked.groupBy("node", F.col("to.node").alias("leader")).agg(F.count("*").alias("count"), *[F.first(c).alias(c) for c in ("n", "comp")], F.first("to.n").alias("m"), F.first("to.comp").alias("other"))
        met = met.where(may_link(F.col("count"), F.col("n"), F.col("m")))
        best = met.groupBy("comp").agg(F.max_by(F.struct("node", "leader", "other"), F.struct("count", "node", "leader")).alias("x"))
        best, asked = compact(best.select("comp", F.col("x.other").alias("other"), F.least("x.node", "x.leader").alias("a"), F.greatest("x.node", "x.leader").alias("b")))
        good = _decided(docs, nodes, best.select("a", "b").distinct())
        met = best.join(good, ["a", "b"], "left_semi").select(F.col("comp").alias("a"), F.col("other").alias("b"))
        links, _ = compact(links.unionByName(good).unionByName(met))
        members = checkpointed(_open(_relabelled(members, components(links))))
        if 2 * met.count() < asked or not asked:
            return members, links
        turn += 1


def _row_pairs(rest: DataFrame) -> DataFrame:
    """Candidates (a, b) of the keys with few pairs, as rows of a join by key and band.

    A pair that shares a hot key too is compared there, whatever comes out here;
    for any other pair the keys counted are all that it shares.
    """
    bands = F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band")
    right = rest.select("key", bands, F.col("node").alias("r_node"), F.col("n").alias("r_n"), F.col("comp").alias("r_comp"))
    both = rest.join(right, ["key", "band"]).where("comp <> r_comp AND node < r_node")
    met = both.groupBy(F.col("node").alias("a"), F.col("r_node").alias("b")).agg(F.count("*").alias("count"), F.first("n").alias("n"), F.first("r_n").alias("m"))
    return met.where(may_link(F.col("count"), F.col("n"), F.col("m"))).select("a", "b")


def _tile_links(docs: DataFrame, nodes: DataFrame, busy: DataFrame) -> DataFrame:
    """Links (a, b) of nodes, and of their components, that connect what busy's keys hold."""
    leaders = busy.groupBy("key").agg(F.min("node").alias("leader"))
    met = checkpointed(busy.join(leaders, "key").select("leader", "node", "n", "comp").distinct())
    held = met.groupBy("leader", "comp").agg(F.sum("n").alias("bytes"))
    split = held.groupBy("leader").agg(F.max_by("comp", F.struct("bytes", "comp")).alias("major"), (8 * F.sum("bytes")).alias("all"), (8 * (F.sum("bytes") - F.max("bytes"))).alias("few"))
    sides = F.ceil(F.col("few") / TILE_BYTES).cast("int").alias("lefts"), F.ceil(F.col("all") / TILE_BYTES).cast("int").alias("rights")
    met = met.join(split.select("leader", "major", *sides), "leader").withColumn("band", _band(F.col("n")))
    block = lambda k, blocks: F.pmod(F.xxhash64("node", F.lit(k)), blocks).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    left = met.where("comp <> major").withColumn("band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)))
    used = left.select("leader", "band").distinct()
    left = left.select("leader", "band", block(1, "lefts").alias("i"), every("rights").alias("j"), F.lit(0).alias("side"), "node", "n", "comp", "major")
    right = met.join(used, ["leader", "band"]).select("leader", "band", every("lefts").alias("i"), block(2, "rights").alias("j"), F.lit(1).alias("side"), "node", "n", "comp", "major")
    wanted = met.select("node").distinct().join(nodes.select("node", "digest", "doc_id"), "node")
    tiles = left.unionByName(right).join(node_sets(docs, wanted), "node")
    kind = "a bigint, b bigint, comp bigint, other bigint"
    found, _ = compact(tiles.groupBy("leader", "band", "i", "j").applyInArrow(_tile, kind))
    return found.select("a", "b").unionByName(found.select(F.col("comp").alias("a"), F.col("other").alias("b")))


def _tile(rows: pa.Table) -> pa.Table:
    """Links between nodes of one tile until no two of its components have one left."""
    side, node, n, comp, major = (rows.column(c).to_numpy() for c in ("side", "node", "n", "comp", "major"))
    raw = rows.column("hashes").combine_chunks()
    sets = [np.frombuffer(raw[i].as_buffer(), np.uint64) for i in range(len(raw))]
    width = 1 << max(6, (8 * int(n.max())).bit_length())
    bits = np.stack([bitmap(s, width).view(np.uint64) for s in sets])
    lost = n - np.bitwise_count(bits).sum(axis=1)
    now = np.unique(comp, return_inverse=True)[1]  # each row's component as the tile knows it
    r = np.flatnonzero(side == 1)
    out: list[tuple[int, int, int, int]] = []
    for k in np.flatnonzero(side == 0).tolist():
        fine = (now[r] != now[k]) & ((node[r] > node[k]) | (comp[r] == major[k])) & (100 * np.minimum(n[r], n[k]) >= PERCENT * np.maximum(n[r], n[k]))
        c = r[fine]
        need = -(-PERCENT * (n[c] + n[k]) // (100 + PERCENT))
        spare = np.bitwise_count(bits[c] & bits[k]).sum(axis=1) + np.minimum(lost[c], lost[k]) - need
        c = c[spare >= 0][np.argsort(-spare[spare >= 0], kind="stable")]
        for x in c.tolist():
            if now[x] != now[k] and intersect(sets[k], sets[x]):
                out.append((int(min(node[k], node[x])), int(max(node[k], node[x])), int(comp[k]), int(comp[x])))
                now[now == now[x]] = now[k]
    cols = zip(*out, strict=True) if out else [[]] * 4
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "comp", "other"])


def _decided(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the candidate pairs (a, b) that link."""
    pairs, n = compact(pairs)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    few = F.broadcast if 2 * n <= BROADCAST_ROWS else (lambda df: df)
    sets = node_sets(docs, nodes.select("node", "digest", "doc_id").join(few(ends), "node"))
    return compact(verified(few(pairs), sets))[0]


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, of (a hash of the text), n_shingles, comp (null for an empty set) for each row."""
    feats = checkpointed(features(docs, frequent_hashes(docs)))
    # numbers are given before the checkpoint, which fixes them
    nodes = feats.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix"))
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
    comp = nodes.select("digest", "node").join(components(node_links(docs, nodes)), "node", "left")
    named = comp.select(F.col("digest").alias("c_digest"), F.coalesce("comp", "node").alias("comp"))
    return checkpointed(feats.select("doc_id", "of", "n_shingles", "digest").join(named, F.col("digest") == F.col("c_digest"), "left").select("doc_id", "of", "n_shingles", "comp"))


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    placed = _grouped(docs)
    least = placed.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(least, "comp", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, but one only of each component.

    The row with the smallest doc_id stays, a null id counting as the largest
    and the hash of the text deciding between equal ids.  Rows are told apart by
    id and text, so a row is never dropped for another that shares its id; of
    rows that share both, the first by its columns' JSON stays.  Rows with an
    empty set are no copies of anything and all stay.
    """
    id_, of, copy = (fresh_name(docs, c) for c in ("k_id", "k_of", "k_row"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "of")
    held = _grouped(docs).where("comp IS NOT NULL").groupBy("comp", "doc_id", "of").agg(F.count("*").alias("n"))
    stay = held.groupBy("comp").agg(F.min_by(F.struct("doc_id", "of", "n"), order).alias("x"))
    stay = checkpointed(stay.select("comp", "x.*"))
    gone = held.join(stay.select("comp", F.col("doc_id").alias("s_id"), F.col("of").alias("s_of")), "comp").where(~(F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("of") == F.col("s_of"))))
    named = lambda rows: rows.select(F.col("doc_id").alias(id_), F.col("of").alias(of))
    same = docs["doc_id"].cast("bigint").eqNullSafe(F.col(id_)) & (_text_hash(docs["text"]) == F.col(of))
    kept = docs.join(named(gone), same, "left_anti")
    repeated = named(stay.where("n > 1"))
    if repeated.isEmpty():
        return kept
    row = F.struct(*[docs[c] for c in docs.columns])
    one = docs.join(light(checkpointed(repeated)), same).groupBy(id_, of).agg(F.min_by(row, F.to_json(row)).alias(copy))
    return kept.join(light(checkpointed(repeated)), same, "left_anti").unionByName(one.select(f"`{copy}`.*"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


#: The same by comparing all sets that share a shingle.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
  FROM d
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS c
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (n + m - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, s.s
"""
