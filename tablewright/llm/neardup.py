"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles (operator 3)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.parsing import column
from tablewright.llm.common import append_columns, map_arrow, summed_arrays
from tablewright.llm.components import components
from tablewright.llm.words import Words, mix, slices
from tablewright.session import broadcast_if_small, stored

SHINGLE = 5
SIMILARITY = 0.8
#: 14 bands of 4 samples find a pair of similarity 0.8 with probability 0.9994.
BANDS, ROWS = 14, 4
#: Of the 56 samples, so many agree in all but a millionth of the pairs of similarity 0.8.
LEAST_AGREED = 31
#: Buckets of up to so many texts are compared in full; larger ones are led by one text and divided by the differences from it.
SMALL_BUCKET = 32
#: The exact way: rounds in which large buckets are led and divided before what is left is compared by sketches, in blocks of so many texts.
DIVISIONS, BLOCK = 2, 1024
#: Rounds of leaders of the registered query and the pipeline, before all pairs of different components are looked at.
LEADER_ROUNDS = 2
#: Texts of about so many bytes are compared at a time, with ``BLOCK`` members at most.
BLOCK_BYTES = 8 << 20
#: Shingles are counted in 2**20 hashed places, so the broadcast counts take 4 MB however large the corpus is.
DF_BITS = 20
#: Weight of a shingle: tf * (1 + IDF_SHARE * ln(N / df) / ln N). A full idf would let the few changed shingles of a
#: copy outweigh the many that a large group of copies shares, since those have a high df just by being copied.
IDF_SHARE = 0.25

#: Hashed places of a text's shingles, the weights in which bound what two texts can share.
PLACE_BITS = 8
PLACES = 1 << PLACE_BITS

_SEEDS = np.random.default_rng(30_011).integers(1, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64) | np.uint64(1)
_LN_2_32 = np.float32(32 * np.log(2))
_SLICE = 1 << 18


def shingles(w: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every shingle; a text of fewer words, but not none, has one of all its words."""
    hashes = w.hashes()
    of, at = w.windows(hashes, n)
    text = w.text[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        more = []
        for i in short:
            whole = np.uint64(w.counts[i])
            for h in hashes[w.first[i] : w.first[i + 1]]:
                whole = mix(np.array([whole ^ h], np.uint64))[0]
            more.append(whole)
        text, of = np.concatenate([text, short]), np.concatenate([of, np.array(more, np.uint64)])
    return text, of


def counted(text: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, in order, with their counts."""
    order = np.lexsort((of, text))
    text, of = text[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], of[at], np.diff(np.append(at, len(of)))


def document_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """In how many texts each hashed place of the shingle space occurs, over all documents.

    A text counts once for a place, however often its shingles fall there.
    """
    places = 1 << DF_BITS

    def add(seen: np.ndarray, texts: pa.Array) -> None:
        text, of = shingles(Words(texts))
        place = np.unique(text.astype(np.int64) << DF_BITS | (of & np.uint64(places - 1)).astype(np.int64)) & (places - 1)
        np.add.at(seen, place, 1)

    return summed_arrays(docs.select(column(text).cast("string").alias("text")), places, add)


def weights_by_place(frequencies: np.ndarray, n_docs: int) -> np.ndarray:
    """idf of each hashed place, from 1 (in every document) to 1 + IDF_SHARE (in one)."""
    df = np.clip(frequencies, 1, max(n_docs, 1))
    return (1 + IDF_SHARE * np.log(max(n_docs, 1) / df) / max(np.log(max(n_docs, 2)), 1e-9)).astype(np.float32)


def weighted(w: Words, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and weight tf * idf of the distinct shingles of each text."""
    text, of, tf = counted(*shingles(w))
    return text, of, tf.astype(np.float32) * idf[of & np.uint64(len(idf) - 1)]


def samples(text: np.ndarray, of: np.ndarray, weight: np.ndarray, n_texts: int) -> np.ndarray:
    """Improved consistent weighted samples (Ioffe 2010): a row of hashes for each text.

    For each sample and shingle: r and c from Gamma(2, 1), b from U(0, 1), t = floor(ln w / r + b),
    ln a = ln c - r (t - b + 1). The shingle with the least a is the sample, together with its t. Two texts have the
    same sample with probability equal to their weighted Jaccard similarity. Texts without shingles have zeros.
    """
    out = np.zeros((n_texts, len(_SEEDS)), np.uint64)
    if not len(of):
        return out
    begin = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    rows, sizes = text[begin], np.diff(np.append(begin, len(text)))
    log_weight = np.log(weight)
    for k, (seed, factor) in enumerate(_SEEDS):
        g = (of ^ seed) * factor
        g ^= g >> np.uint64(32)
        g *= np.uint64(0x94D049BB133111EB)
        g ^= g >> np.uint64(29)
        u = g.view(np.uint16).reshape(-1, 4).astype(np.float32) + np.float32(0.5)
        b = ((g * factor) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        r = _LN_2_32 - np.log(u[:, 0] * u[:, 1])
        log_c = np.log(_LN_2_32 - np.log(u[:, 2] * u[:, 3]))
        t = np.floor(log_weight / r + b)
        a = log_c - r * (t - b + np.float32(1))
        least = np.minimum.reduceat(a, begin)
        hit = np.flatnonzero(a == np.repeat(least, sizes))
        first = hit[np.searchsorted(hit, begin)]
        out[rows, k] = mix(of[first] ^ mix(t[first].astype(np.int64).astype(np.uint64) + seed))
    return out


def band_hashes(sample: np.ndarray) -> np.ndarray:
    """One hash for each band of each text; equal where all samples of the band are."""
    out = np.empty((len(sample), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(sample), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            h = mix(h + sample[:, k])
        out[:, band] = h
    return out.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser weights over the sum of the greater ones, of (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    whole = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - shared
    return shared / whole if whole > 0 else 0.0


def _signatures(numbered: DataFrame, idf) -> DataFrame:
    def sign(texts: pa.Array) -> list[pa.Array]:
        digests, bands, sketches = [], [], []
        for a, b in slices(texts, _SLICE):
            part = texts.slice(a, b - a)
            w = Words(part)
            drawn = samples(*weighted(w, idf.value), w.n_texts)
            bands += [row if n else None for row, n in zip(band_hashes(drawn), w.counts, strict=True)]
            sketches += [row.tobytes() for row in (drawn >> np.uint64(56)).astype("u1")]
            digests += [None if t is None else hashlib.blake2b(t.encode(), digest_size=16).digest() for t in part.to_pylist()]
        return [pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]

    return stored(append_columns(numbered, ["text"], "digest binary, bands array<long>, sketch binary", sign).select("row", "doc_id", "n_bytes", "digest", "bands", "sketch"))


def _promising(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose samples agree in ``LEAST_AGREED`` places or more; their texts are worth fetching."""
    for side in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}")), side)

    def agree(a: pa.Array, b: pa.Array) -> list[pa.Array]:
        left, right = [np.frombuffer(b"".join(x.to_pylist()), "u1").reshape(len(x), -1) for x in (a, b)]
        return [pa.array((left == right).sum(1) >= LEAST_AGREED)]

    return append_columns(pairs.select("a", "b", "sketch_a", "sketch_b"), ["sketch_a", "sketch_b"], "promising boolean", agree).where("promising").select("a", "b")


def _difference_keys(mine: tuple[np.ndarray, np.ndarray], lead: tuple[np.ndarray, np.ndarray], idf: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """Hashes of ways in which a text differs from its leader, and how many of them, from the first, are short keys.

    Two alike texts have a key in common that is a short key of one of them, unless both are alike to the leader. Let
    d be the weights of a text less those of the leader, and e = (1 - s) / s of the text's weight. Alike texts
    differ by at most e, so the d of each is shared, shingle by shingle and with equal sign, but for e at most, and the
    smaller d but for e / 2. The keys are the shingles of d in an order that holds for all texts of the leader, what
    the text adds (rare ones first) before what it lacks (frequent ones first, since all others lack what the leader alone
    has), until e is passed; the short keys, until e / 2 is. The first shared shingle in this order is then among
    them. If d is smaller than that, all of it is taken, and some of it is shared.
    """
    _, i, j = np.intersect1d(mine[0], lead[0], assume_unique=True, return_indices=True)
    d = mine[1].astype(np.float64)
    d[i] -= lead[1][j]
    adds = np.flatnonzero(d > 0)
    adds = adds[np.lexsort((mine[0][adds], -idf[mine[0][adds] & np.uint64(len(idf) - 1)]))]
    lacks = np.concatenate([mine[0][d < 0], np.delete(lead[0], j)])
    lacked = np.concatenate([-d[d < 0], np.delete(lead[1], j)])
    order = np.lexsort((lacks, idf[lacks & np.uint64(len(idf) - 1)]))
    weight = np.concatenate([d[adds], lacked[order]])
    bound = (1 - similarity) / similarity * mine[1].sum(dtype=np.float64) * (1 + 1e-5)
    short, taken = np.searchsorted(np.cumsum(weight), [bound / 2, bound], side="right") + 1
    return np.concatenate([mix(mine[0][adds]), mix(~lacks[order])])[:taken].view(np.int64), int(short)


def _compared(pairs: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """Pairs ``(a, b, wide)`` with ``alike``, whether their weighted Jaccard similarity is at least ``similarity``, and
    for wide ones ``keys``, the differences of ``b`` from its leader ``a``, the first ``n_short`` of which are short keys."""
    joined = (
        pairs.join(texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "wide", "text_a", "text_b")
    )

    def sets(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        w = Words(texts)
        text, of, weight = weighted(w, idf.value)
        at = np.searchsorted(text, np.arange(w.n_texts + 1))
        return [(of[i:j], weight[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]

    def compare(text_a: pa.Array, text_b: pa.Array, wide: pa.Array) -> list[pa.Array]:
        alike, keys, n_short = [], [], []
        last, lead = None, None
        for a, b in slices(text_b, _SLICE):
            for left, mine, whole in zip(text_a.slice(a, b - a), sets(text_b.slice(a, b - a)), wide.slice(a, b - a).to_pylist(), strict=True):
                if last is None or left != last:  # pairs of one leader mostly come together
                    last, lead = left, sets(pa.array([left.as_py()], pa.large_string()))[0]
                alike.append(weighted_jaccard(lead, mine) >= similarity)
                differ, short = _difference_keys(mine, lead, idf.value, similarity) if whole else (None, 0)
                keys.append(differ)
                n_short.append(short)
        return [pa.array(alike, pa.bool_()), pa.array(keys, pa.list_(pa.int64())), pa.array(n_short, pa.int64())]

    compared = append_columns(joined, ["text_a", "text_b", "wide"], "alike boolean, keys array<long>, n_short long", compare)
    return compared.where("alike or wide").select("a", "b", "alike", "keys", "n_short")


def _open(active: DataFrame) -> DataFrame:
    """Members of buckets that hold several components and a short key, with ``home``, whether a member is of the component
    of the bucket's leader, the ``lead``, and counts.

    The most popular member leads, that whose buckets hold most: the text that a group of copies was made from meets more of
    them than any copy does.
    """
    several = (
        active.groupBy("bucket")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), F.count_if("short").alias("n_short"))
        .where("low <> high and n_short > 0")
    )
    known = stored(active.join(several.select("bucket", "size", "n_short"), "bucket"))
    popular = known.groupBy("node").agg(F.sum("size").alias("popular"))
    leads = known.join(popular, "node").groupBy("bucket").agg(F.max_by(F.struct("node", "component"), F.struct("popular", "node")).alias("lead"))
    placed = known.join(leads, "bucket").withColumn("home", F.col("component") == F.col("lead.component"))
    return stored(placed.join(placed.groupBy("bucket").agg(F.count_if(~F.col("home")).alias("n_strange")), "bucket"))


def _met(small: DataFrame) -> DataFrame:
    """Pairs of small buckets: members outside the leader's component, or those under a short key if they are fewer, with all of other components."""
    few = F.col("n_strange") <= F.col("n_short")
    probes = small.where(few & ~F.col("home") | ~few & F.col("short")).select("bucket", F.col("node").alias("probe"), F.col("component").alias("of"))
    return small.join(probes, "bucket").where("component <> of").select(F.greatest("node", "probe").alias("a"), F.least("node", "probe").alias("b")).distinct()


def _promising_in_blocks(large: DataFrame, sketches: DataFrame) -> DataFrame:
    """Promising pairs of buckets of any size: members outside the leader's component with all of other components.

    A bucket is cut into blocks of about ``BLOCK`` members; a task gets the sketches of two blocks and hands on
    only the pairs that agree often enough, so neither pairs nor large lists are made of a bucket.
    """
    members = large.join(sketches, "node").select("bucket", "size", "n_strange", "home", "node", "component", "short", "sketch")
    hosts, probes = [F.ceil(F.col(n) / BLOCK).cast("int") for n in ("size", "n_strange")]

    def own(n, salt: int):
        return F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    def side(rows: DataFrame, i, j, probe: bool) -> DataFrame:
        cut_ = rows.select("bucket", i.alias("i"), "node", "component", "short", "sketch", "size", "n_strange").withColumn("j", j)
        return cut_.select(F.xxhash64("bucket", "i", "j").alias("block"), F.lit(probe).alias("probe"), "node", "component", "short", "sketch")

    sides = side(members, own(hosts, 1), every(probes), False).unionByName(side(members.where("not home"), every(hosts), own(probes, 2), True))

    def agree(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        probe = rows.column("probe").to_numpy()
        node, component, short = [rows.column(c).to_numpy() for c in ("node", "component", "short")]
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), "u1").reshape(len(node), -1)
        a, b = np.flatnonzero(probe), np.flatnonzero(~probe)
        equal = np.zeros((len(a), len(b)), np.uint8)
        for c in range(sketch.shape[1]):
            equal += sketch[a, c, None] == sketch[None, b, c]
        at, to = np.nonzero((equal >= LEAST_AGREED) & (component[a, None] != component[None, b]) & (short[a, None] | short[None, b]))
        x, y = node[a[at]], node[b[to]]
        return np.maximum(x, y), np.minimum(x, y)

    def compare(batches):  # rows of a block come one after the other
        held: list[pa.RecordBatch] = []

        def done():
            high, low = agree(pa.Table.from_batches(held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(high, pa.int64()), pa.array(low, pa.int64())], ["a", "b"])

        for batch in batches:
            block = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if held and held[-1].column(0)[0].as_py() != int(block[a]):
                    yield done()
                held.append(batch.slice(a, b - a))
        if held:
            yield done()

    return map_arrow(sides.repartition("block").sortWithinPartitions("block"), compare, "a long, b long").distinct()


def _links(members: DataFrame, sketches: DataFrame, texts: DataFrame, idf, similarity: float, rounds: int) -> DataFrame | None:
    """Component of each node that is linked, from ``members(bucket, node)``; None if no pair is alike.

    In each of ``rounds`` rounds the buckets that hold several components are worked off. In a small one members are compared with
    those of other components. In a large one all are compared with the leader. Two others that are alike, and
    not both alike to the leader, differ from it in part in the same way (:func:`_difference_keys`), so the next round's
    buckets hold what shares such a difference, and no pair is lost. There a pair has a member under a short key, so a bucket with few
    of these is small, and one with none is done; one with few members outside its leader's component is small, too. What is still open after
    the last round, in buckets of whatever size, is compared by sketches, block by block, and promising pairs by their texts.
    """
    labels, edges = None, None
    active = members.withColumn("short", F.lit(True)).withColumn("component", F.col("node"))
    for number in range(rounds + 1):
        placed = _open(active)
        if placed.isEmpty():
            break
        small = F.least("n_short", "n_strange") <= SMALL_BUCKET
        close = _promising(_met(placed.where(small)), sketches)
        if number < rounds:
            led = placed.where(~small).select(F.col("lead.node").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
            pairs = close.withColumn("wide", F.lit(False)).unionByName(led.withColumn("wide", F.lit(True)))
        else:
            pairs = close.unionByName(_promising_in_blocks(placed.where(~small), sketches)).distinct().withColumn("wide", F.lit(False))
        found = stored(_compared(pairs, texts, idf, similarity))
        new = found.where("alike").select("a", "b")
        if not new.isEmpty():
            edges = new if labels is None else new.unionByName(labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
            labels = stored(components(edges))
        keyed = found.select("a", F.col("b").alias("node"), "n_short", F.posexplode("keys").alias("at", "key"))
        active = keyed.select(F.xxhash64("a", "key").alias("bucket"), "node", (F.col("at") < F.col("n_short")).alias("short"))
        if labels is None:
            active = active.withColumn("component", F.col("node"))
        else:
            active = active.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return labels


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("component", F.col("node"))
    return members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _merged(edges: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Components of the edges ``(a, b)`` and of those known before."""
    if labels is not None:
        edges = edges.unionByName(labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
    return stored(components(edges))


def _cells(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of buckets that hold several components, dealt to cells of bounded size in which every pair of two components meets once.

    ``strange`` members are outside the most frequent component of their bucket; a pair of two components has one at least. A bucket of up to
    ``BLOCK`` members and ``BLOCK_BYTES`` of texts is one cell. The members of a larger one are cut into blocks as hosts, the strange ones as
    probes, too, and a cell has the hosts of one block and the probes of another.
    """
    active = _labelled(members, labels)
    parts = active.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"))
    most = F.max(F.struct("n", "component", "n_bytes"))
    several = parts.groupBy("bucket").agg(most.alias("most"), F.sum("n").alias("n"), F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("parts")).where("parts > 1")

    def blocks(n, n_bytes):
        return F.greatest(F.ceil(n / BLOCK), F.ceil(n_bytes / BLOCK_BYTES), F.lit(1)).cast("int")

    counted = several.select(
        "bucket",
        F.col("most.component").alias("home"),
        blocks(F.col("n"), F.col("n_bytes")).alias("hosts"),
        blocks(F.col("n") - F.col("most.n"), F.col("n_bytes") - F.col("most.n_bytes")).alias("probes"),
    )
    placed = active.join(counted, "bucket").withColumn("strange", F.col("component") != F.col("home"))
    whole = (F.col("hosts") == 1) & (F.col("probes") == 1)

    def own(n: str, salt: int):
        return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def side(rows: DataFrame, i, j, host, probe) -> DataFrame:
        cut_ = rows.withColumn("i", i).withColumn("j", j)
        return cut_.select(F.xxhash64("bucket", "i", "j").alias("cell"), "node", "component", "strange", "band", host.alias("host"), probe.alias("probe"))

    one, yes, no = F.lit(0), F.lit(True), F.lit(False)
    large = placed.where(~whole)
    return (
        side(placed.where(whole), one, one, yes, F.col("strange"))
        .unionByName(side(large, own("hosts", 1), every("probes"), yes, no))
        .unionByName(side(large.where("strange"), every("hosts"), own("probes", 2), no, yes))
    )


def _links_of_cells(rows: pa.Table, idf: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Links within whole cells that stand one after the other: a forest of the alike pairs of two components.

    A pair is looked at in the first band that its texts share, if no link found before has joined its texts; then the weighted Jaccard
    similarity of their shingles decides. It is not computed where it cannot be reached: texts share no more than the lesser of their weights in
    each of ``PLACES`` hashed places of the shingles, summed up.
    """
    cell, node, component, strange, host, probe, band = [rows.column(c).to_numpy() for c in ("cell", "node", "component", "strange", "host", "probe", "band")]
    bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    texts = pa.concat_arrays(rows.column("text").cast(pa.large_string()).chunks)
    found = []
    for a, b in slices(texts, _SLICE):
        text, of, weight = weighted(Words(texts.slice(a, b - a)), idf)
        found.append((text + a, of, weight))
    text, of, weight = [np.concatenate(x) for x in zip(*found, strict=True)]
    begin = np.searchsorted(text, np.arange(len(node) + 1))
    total = np.bincount(text, weights=weight, minlength=len(node))
    distinct, place = np.unique(of, return_inverse=True)
    mine = np.zeros(len(distinct), np.float32)
    edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
    high, low = [], []
    by_place = np.bincount(text * PLACES + (of >> np.uint64(64 - PLACE_BITS)).astype(np.int64), weights=weight, minlength=len(node) * PLACES)
    by_place = by_place.astype(np.float32).reshape(-1, PLACES)
    least = similarity / (1 + similarity) * (1 - 1e-5)  # of the sum of both weights, less the rounding of 32 bits
    for first, end in zip(edges[:-1], edges[1:], strict=True):
        label, hosts = component[first:end].copy(), first + np.flatnonzero(host[first:end])
        for p in (first + np.flatnonzero(probe[first:end])).tolist():
            c = hosts[label[hosts - first] != label[p - first]]
            c = c[(node[c] < node[p]) | ~strange[c]]  # of two probes the greater one looks at the pair
            c = c[~(bands[c, : band[p]] == bands[p, : band[p]]).any(1)]
            c = c[np.minimum(by_place[c], by_place[p]).sum(1) >= least * (total[c] + total[p])]
            if not len(c):
                continue
            sizes = begin[c + 1] - begin[c]
            starts = np.cumsum(sizes) - sizes
            at = np.arange(sizes.sum()) + np.repeat(begin[c] - starts, sizes)
            own = slice(begin[p], begin[p + 1])
            mine[place[own]] = weight[own]
            shared = np.add.reduceat(np.minimum(mine[place[at]], weight[at]).astype(np.float64), starts)
            mine[place[own]] = 0
            for j in c[shared / (total[c] + total[p] - shared) >= similarity].tolist():
                if label[j - first] != label[p - first]:
                    high.append(max(node[p], node[j]))
                    low.append(min(node[p], node[j]))
                    label[label == label[j - first]] = label[p - first]
    return high, low


def _links_in_cells(cells: DataFrame, signatures: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """``(a, b)``, links that connect what the alike pairs of the cells connect. A text goes to its cells once, so no pairs are shuffled."""
    signs = signatures.select("node", "bands").join(texts.withColumnRenamed("row", "node"), "node")
    rows = cells.join(signs, "node").select("cell", "node", "component", "strange", "host", "probe", "band", "bands", "text")

    def compare(batches):  # rows of a cell come one after the other
        held: list[pa.RecordBatch] = []
        size = 0

        def done():
            found = _links_of_cells(pa.Table.from_batches(held), idf.value, similarity)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

        for batch in batches:
            cell = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            lengths = np.append(0, np.cumsum(pc.binary_length(batch.column(8)).to_numpy(zero_copy_only=False).astype(np.int64)))
            start = 0
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                new = a > start or not held or held[-1].column(0)[-1].as_py() != int(cell[a])
                if new and size >= _SLICE:
                    if a > start:
                        held.append(batch.slice(start, a - start))
                    yield done()
                    start, size = a, 0
                size += int(lengths[b] - lengths[a])
            if start < len(cell):
                held.append(batch.slice(start))
        if held:
            yield done()

    return map_arrow(rows.repartition("cell").sortWithinPartitions("cell"), compare, "a long, b long").distinct()


def _links_by_leaders(members: DataFrame, signatures: DataFrame, texts: DataFrame, idf, similarity: float, rounds: int) -> DataFrame | None:
    """The same by leaders, and the rest in full.

    In buckets of more than ``BLOCK`` members rounds of leaders come first, with as many comparisons as there are members in each: all members are
    compared with the leader, then those outside the leader's component with a member of that component, another one in each
    bucket and round, and with a leader of their own. They only save work: then every pair of two components that a bucket still holds is
    looked at (:func:`_links_in_cells`), so none is lost.
    """
    labels, tried = None, None
    big = stored(members.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("bucket"))
    crowded = stored(members.join(broadcast_if_small(big), "bucket", "left_semi").select("bucket", "node")) if not big.isEmpty() else None
    for number in range(rounds if crowded is not None else 0):
        large = _open(_labelled(crowded.withColumn("short", F.lit(True)), labels))
        if large.isEmpty():
            break
        if number == 0:
            led = large.select(F.col("lead.node").alias("a"), F.col("node").alias("b"))
        else:
            order = F.xxhash64("bucket", "node", F.lit(number))
            picks = [F.max_by("node", F.when(side, order)).alias(name) for side, name in ((F.col("home"), "host"), (~F.col("home"), "guest"))]
            led = large.join(large.groupBy("bucket").agg(*picks), "bucket").where("not home")
            led = led.select(F.explode(F.array("host", "guest")).alias("a"), F.col("node").alias("b"))
        pairs = led.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = stored(_compared(_promising(pairs, signatures).withColumn("wide", F.lit(False)), texts, idf, similarity))
        if not found.isEmpty():
            labels = _merged(found.select("a", "b"), labels)
    links = stored(_links_in_cells(_cells(members, labels), signatures, texts, idf, similarity))
    return labels if links.isEmpty() else _merged(links, labels)


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, rounds: int | None = None) -> DataFrame:
    """A row for each document: ``doc_id``, ``class_id``, ``class_size``, ``kept`` (and ``row``).

    Two texts are linked if the weighted Jaccard similarity of their five-word shingles is at least ``similarity``,
    as found by banded samples and verified on the shingles; equal texts are always linked. A class is what links connect; its
    id is the smallest doc_id in it, and ``kept`` marks one row of each class (smallest doc_id, null ids last, then
    the first row). Words are runs of digits, letters and characters beyond ASCII, in lower case. Texts without words are linked
    to equal texts only; null texts to none. Repeated rows are copies of each other. An empty table gives no rows.

    Every candidate pair of every bucket is followed unless links already join its texts. ``rounds=None`` divides large buckets by differences from
    a leader (:func:`_links`). With a number, so many rounds of leaders come first in buckets of more than ``BLOCK`` members, then texts are
    dealt to cells in which the remaining pairs meet and are verified by their shingles, whatever their samples say (:func:`_links_by_leaders`).
    """
    numbered = stored(docs.select(column(doc_id).alias("doc_id"), column(text).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()))
    return _classes(numbered, similarity, rounds)


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, rounds: int | None = None) -> DataFrame:
    """``docs`` with one row of each class of :func:`near_duplicate_classes`."""
    held = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("held"))
    numbered = stored(held.withColumn("row", F.monotonically_increasing_id()))
    texts = numbered.select("row", F.col("held").getField(doc_id).alias("doc_id"), F.col("held").getField(text).cast("string").alias("text"))
    dropped = _classes(texts, similarity, rounds).where("not kept").select("row")
    return numbered.join(dropped, "row", "left_anti").select(*[F.col("held").getField(c).alias(c) for c in docs.columns])


def _classes(numbered: DataFrame, similarity: float, rounds: int | None) -> DataFrame:
    spark = numbered.sparkSession
    idf = spark.sparkContext.broadcast(weights_by_place(document_frequencies(numbered), numbered.count()))
    signed = _signatures(numbered.withColumn("n_bytes", F.octet_length("text").cast("long")), idf)

    same = F.coalesce(F.hex("digest"), F.concat(F.lit("row "), F.col("row")))  # a null text is equal to none
    exact = stored(signed.select("row", same.alias("same")).groupBy("same").agg(F.min("row").alias("node")))
    nodes = signed.join(exact.select(F.col("node").alias("row")), "row", "left_semi").where("bands is not null")
    banded = nodes.select(F.col("row").alias("node"), "n_bytes", F.posexplode("bands").alias("band", "hash"))
    banded = banded.select("node", "n_bytes", "band", F.xxhash64("band", "hash").alias("bucket"))
    held = [F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("mark")]
    shared = banded.groupBy("bucket").agg(*held, F.min("band").alias("band")).where("low <> high")
    # Of buckets with the same members the one of the first band stays: it holds the same pairs.
    shared = shared.groupBy("low", "high", "n", "mark").agg(F.min_by("bucket", F.struct("band", "bucket")).alias("bucket"))
    members = stored(banded.join(shared.select("bucket"), "bucket", "left_semi"))
    wanted = broadcast_if_small(stored(members.select(F.col("node").alias("row")).distinct()))
    texts = stored(numbered.join(wanted, "row", "left_semi").select("row", "text"))
    if rounds is None:
        labels = _links(members.select("bucket", "node"), nodes.select(F.col("row").alias("node"), "sketch"), texts, idf, similarity, DIVISIONS)
    else:
        labels = _links_by_leaders(members, nodes.select(F.col("row").alias("node"), "bands", "sketch"), texts, idf, similarity, rounds)

    owned = signed.select("row", "doc_id", same.alias("same")).join(exact, "same")
    if labels is None:
        owned = owned.select("row", "doc_id", F.col("node").alias("owner"))
    else:
        owned = owned.join(labels, "node", "left").select("row", "doc_id", F.coalesce("component", "node").alias("owner"))
    owned = stored(owned)
    first = owned.groupBy("owner").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first"), F.count("*").alias("class_size"))
    return owned.join(first, "owner").select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept"), "row")
