"""Near duplicates by an inverted join of MinHash signatures.

Each text becomes the set of its 5-word shingles. Texts with the same set are one class. A class is posted under
each of its K (coordinate, minimum) tokens; two sets of similarity 0.75 agree in 48 of 64 coordinates on average,
and a pair is retained if they agree in MATCHES = 31 at least (a pair at 0.75 is missed with a chance of 3e-6).

Prefix: tokens are ordered by how many classes hold them, rare ones first. Two classes that share MATCHES tokens
share one among the first K - MATCHES + 1 of each, so only those are merged. Tokens of one class fill the prefix
of texts without relatives, so most texts, and the frequent tokens of passages that many documents share, drop out.

Skip: lists whose classes are in one component already are skipped. First the classes of a list meet its leader, the
class whose tokens most others hold, which joins most of a group in pairs that grow with its size. What still crosses
components in lists of more than SMALL_LIST classes is compared inside tasks that hold two blocks of a list at most and
return links only. A class goes through all of its long lists that way, and a pair counts in the first list that both
have. Pairs that share short lists only are joined as rows, SMALL_LIST to a class and list at most.
All retained pairs are confirmed on the full sets, so components are those of the links; pairs inside a component are not
needed.

Sets are of 64-bit hashes of shingles, made of 64-bit hashes of words without algebraic structure: two different
shingles of a pair of n shingles are taken for one with a chance of n * n * 2 ** -64, texts of one set by 128 bits.

Cases: a null or empty text, or one without words, has no shingles, is linked with nothing and stays. A text of fewer
than five words is one shingle. Repeated rows are members of the same class; rows with the smallest id of a
component are the kept ones. Rows without an id take part, and are kept where no row of the component has one.
Each row is decided by its own text: rows that share an id, or have none, stay or go one by one.
No rows: no rows. Other columns pass unchanged, those that are named as helper columns (__dup_*) as well.
"""

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftscope.llm._cluster import aside, mark, release, ship, small_side, written
from shiftscope.llm._text import SPACED, chunks, mix, ngrams, words

SHINGLE = 5
SIMILARITY = 75
K = 64
MATCHES = 31
#: Lists of more classes are compared in blocks of BLOCK.
SMALL_LIST = 32
BLOCK = 512
#: Pairs, and lists, that a task compares at a time.
PAIRS = 1 << 15
LISTS = 1 << 11

_FACTORS = np.random.default_rng(64).integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COORDINATES = mix(np.arange(1, K + 1, dtype=np.uint64))


def _shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distinct shingles in order within each row, n + 1 offsets)."""
    for first, data, offsets in chunks(column):
        hashes, _, _, by_row = words(data, offsets, SPACED)
        grams, bounds = ngrams(hashes, by_row, SHINGLE)
        sets = [np.unique(grams[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield first, np.concatenate(sets) if sets else grams, np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def _set_ids(grams: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """128 bits that name a set; None for the empty one."""
    full = np.diff(bounds) > 0
    ids = np.zeros((len(full), 2), dtype=np.uint64)
    if full.any():
        ids[full, 0] = np.add.reduceat(mix(grams), bounds[:-1][full])
        ids[full, 1] = np.add.reduceat(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds[:-1][full])
    return [row.tobytes() if some else None for row, some in zip(ids, full, strict=True)]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, grams, bounds in _shingle_sets(batch.column(1)):
            counts = np.diff(bounds)
            full = counts > 0
            tokens = np.zeros((int(full.sum()), K), dtype=np.uint64)
            if full.any():
                for k in range(K):
                    tokens[:, k] = np.minimum.reduceat(grams * _FACTORS[k], bounds[:-1][full])
                tokens = mix(tokens ^ _COORDINATES)
            ends = np.concatenate(([0], np.cumsum(full * K))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, len(counts)),
                    pa.array(counts, pa.int64()),
                    pa.array(_set_ids(grams, bounds), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.ravel().view(np.int64))),
                    *[column.slice(first, len(counts)) for column in batch.columns[2:]],
                ],
                ["__dup_id", "__dup_n", "__dup_set", "__dup_tokens", *batch.schema.names[2:]],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, grams, bounds in _shingle_sets(batch.column(0)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(_set_ids(grams, bounds), pa.binary()), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(grams.view(np.int64)))],
                ["set", "shingles"],
            )


def _digest(text: Column) -> Column:
    """16 bytes that name a text."""
    return F.unhex(F.md5(text.cast("binary")))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(__dup_id, __dup_n, __dup_set, __dup_tokens), a row for each row of docs; with digests also __dup_text."""
    kind = docs.schema[id_col].dataType.simpleString()
    also = [_digest(F.col(text_col)).alias("__dup_text")] if digests else []
    columns = f"__dup_id {kind}, __dup_n long, __dup_set binary, __dup_tokens array<long>" + ", __dup_text binary" * digests
    return docs.select(id_col, text_col, *also).mapInArrow(_signatures, columns)


def prefix_postings(classes: DataFrame) -> DataFrame:
    """(token, set, n) of the prefixes, for tokens that are in the prefix of two classes at least."""
    posted = classes.select("set", "n", F.explode("tokens").alias("token"))
    shared = posted.groupBy("token").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    # a token of one class comes first in its order, so it is counted and not carried
    held = posted.join(shared, "token")
    place = Window.partitionBy("set").orderBy("held", "token")
    ranked = held.withColumn("place", F.row_number().over(place) + K - F.count(F.lit(1)).over(Window.partitionBy("set")))
    prefix = ranked.filter(F.col("place") <= K - MATCHES + 1).select("token", "set", "n")
    lists = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").drop("members")
    return prefix.join(lists, "token")


def similar(both: Column, n_a: Column, n_b: Column) -> Column:
    return 100 * both >= SIMILARITY * (n_a + n_b - both)


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that agree in MATCHES coordinates and whose full sets are similar."""
    of = lambda t, c, names: t.select(*[F.col(x).alias(f"{x}_{c}" if x != "set" else c) for x in names])
    likely = (
        pairs.join(of(classes, "a", ["set", "tokens"]), "a")
        .join(of(classes, "b", ["set", "tokens"]), "b")
        .filter(F.size(F.array_intersect("tokens_a", "tokens_b")) >= MATCHES)
        .select("a", "b")
    )
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    full = likely.join(of(sets, "a", ["set", "shingles"]), "a").join(of(sets, "b", ["set", "shingles"]), "b")
    return full.withColumn("both", both).filter(similar(F.col("both"), F.size("shingles_a"), F.size("shingles_b"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(set, component) for the sets in links (a, b): the least name that can be reached, by smallest-neighbour steps and pointer jumps."""
    spark, start = links.sparkSession, mark(links.sparkSession)
    edges = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "dup-edges")
    labels = written(edges.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "dup-labels")
    while True:
        near = edges.join(labels.select(F.col("u").alias("v"), "p"), "v").groupBy("u").agg(F.min("p").alias("near"))
        hooked = labels.join(near, "u").select("u", "p", F.least("p", "near").alias("q"))
        jumps = labels.select(F.col("u").alias("q"), F.col("p").alias("r"))
        moved = written(hooked.join(jumps, "q", "left").select("u", "p", F.least("q", "r").alias("q")), "dup-labels")
        changed = moved.filter("p != q").limit(1).count()
        labels = moved.select("u", F.col("q").alias("p"))
        release(spark, start, (edges, moved))
        if not changed:
            return labels.select(F.col("u").alias("set"), F.col("p").alias("component"))


def _labelled(postings: DataFrame, parts: DataFrame | None) -> DataFrame:
    if parts is None:
        return postings.withColumn("component", F.col("set"))
    return postings.join(parts, "set", "left").withColumn("component", F.coalesce("component", "set"))


def _open(postings: DataFrame, parts: DataFrame | None) -> DataFrame:
    """(token, members, set, n, component) of the lists that hold more than one component."""
    now = _labelled(postings, parts)
    lists = now.groupBy("token").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("least"), F.max("component").alias("most"))
    return written(now.join(lists.filter("least != most").drop("least", "most"), "token"), "dup-open")


def _sized(n_a: str, n_b: str) -> Column:
    return 100 * F.least(n_a, n_b) >= SIMILARITY * F.greatest(n_a, n_b)


def leader_pairs(here: DataFrame) -> DataFrame:
    """(a, b): each class with the leader that it meets in most lists."""
    weights = here.groupBy("set").agg(F.sum("members").alias("weight"))
    rank = F.struct((-F.col("weight")).alias("rank"), F.col("set").alias("leader"), F.col("component").alias("leads"), F.col("n").alias("n_l"))
    leaders = here.join(weights, "set").groupBy("token").agg(F.min(rank).alias("first")).select("token", "first.leader", "first.leads", "first.n_l")
    met = here.join(leaders, "token").filter((F.col("component") != F.col("leads")) & _sized("n", "n_l"))
    collisions = met.groupBy("set", "leader").agg(F.count(F.lit(1)).alias("collisions"))
    best = collisions.groupBy("set").agg(F.max(F.struct("collisions", "leader")).alias("best")).select("set", "best.leader")
    return best.select(F.least("set", "leader").alias("a"), F.greatest("set", "leader").alias("b")).distinct()


def wide_lists(here: DataFrame) -> DataFrame:
    """(set, wide, minus): the long lists that a class is in, as an array of tokens, largest first, and their members below 0."""
    gathered = here.filter(F.col("members") > SMALL_LIST).groupBy("set").agg(F.sort_array(F.collect_list(F.struct((-F.col("members")).alias("m"), "token"))).alias("wide"))
    return gathered.select("set", F.col("wide.token").alias("wide"), F.col("wide.m").alias("minus"))


def _share(lists: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether the lists of each left and each right row have one in common."""
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    _, number = np.unique(np.concatenate(lists), return_inverse=True)
    both = np.zeros((len(left), len(right)), dtype=bool)
    for first in range(0, int(number.max(initial=-1)) + 1, LISTS):
        own = (number >= first) & (number < first + LISTS)
        held = np.zeros((len(lists), LISTS), dtype=np.float32)
        held[rows[own], number[own] - first] = 1
        both |= held[left] @ held[right].T > 0
    return both


def _block_links(key: tuple, table: pa.Table) -> pa.Table:
    """The links across components among the classes of two blocks of a list (or of one), as far as they join anything."""
    table = table.combine_chunks()
    names, part = table["set"].to_pylist(), table["component"].to_pylist()
    side = table["side"].to_numpy()
    n = table["n"].to_numpy()
    tokens = np.stack(table["tokens"].to_numpy())
    shingles = table["shingles"].to_numpy()
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while root.get(x, x) != x:
            x = root[x]
        return x

    found_a, found_b = [], []
    two = bool((side == 0).any() and (side == 1).any())
    parts = np.unique(np.array([int.from_bytes(p, "little") for p in part], dtype=object), return_inverse=True)[1]
    left = np.flatnonzero(side == 0) if two else np.arange(len(names))
    right = np.flatnonzero(side == 1) if two else left
    of, to = n[left][:, None], n[right][None, :]
    met = (parts[left][:, None] != parts[right][None, :]) & (100 * np.minimum(of, to) >= SIMILARITY * np.maximum(of, to))
    if not two:
        met &= left[:, None] < right[None, :]
    # pairs that share a list that comes before this one are compared there
    met &= ~_share(list(table["earlier"].to_numpy()), left, right)
    i, j = np.nonzero(met)
    i, j = left[i], right[j]
    agree = [(tokens[i[at : at + PAIRS]] == tokens[j[at : at + PAIRS]]).sum(axis=1) for at in range(0, len(i), PAIRS)]
    agree = np.concatenate(agree) if agree else np.zeros(0, dtype=np.int64)
    retained = np.flatnonzero(agree >= MATCHES)
    for at in retained[np.argsort(-agree[retained], kind="stable")]:
        a, b = int(i[at]), int(j[at])
        p, q = find(part[a]), find(part[b])
        if p == q:
            continue
        common = len(np.intersect1d(shingles[a], shingles[b], assume_unique=True))
        if 100 * common >= SIMILARITY * (n[a] + n[b] - common):
            root[max(p, q)] = min(p, q)
            found_a.append(min(names[a], names[b]))
            found_b.append(max(names[a], names[b]))
    return pa.table({"a": pa.array(found_a, pa.binary()), "b": pa.array(found_b, pa.binary())})


def block_links(here: DataFrame, wide: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) across components within long lists, found in pairs of blocks.

    Half of each token is sent: others that agree by chance are seen when the full sets are compared.
    """
    half = F.transform("tokens", lambda t: F.shiftright(t, 32).cast("int")).alias("tokens")
    of = here.select("set", "component").distinct()
    full = classes.select("set", "n", half).join(of, "set").join(sets, "set").join(wide, "set")
    listed = full.select("*", F.posexplode("wide").alias("at", "token")).withColumn("blocks", F.ceil(-F.col("minus")[F.col("at")] / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    dealt = listed.withColumn("earlier", F.slice("wide", F.lit(1), F.col("at"))).withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = (F.col("block") > F.col("other")).cast("int").alias("side")
    dealt = dealt.select("set", "n", "tokens", "component", "shingles", "earlier", "token", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), side)
    return dealt.groupBy("token", "first", "second").applyInArrow(_block_links, "a binary, b binary")


def crossing_pairs(here: DataFrame, wide: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) of different components that share a list of SMALL_LIST classes at most, none of the long ones, and MATCHES tokens."""
    known = here.filter(F.col("members") <= SMALL_LIST).join(wide.select("set", "wide"), "set", "left")
    known = known.withColumn("wide", F.coalesce("wide", F.array().cast("array<long>"))).join(classes.select("set", "tokens"), "set")
    other = known.select(
        F.col("token").alias("token_b"),
        F.col("set").alias("b"),
        F.col("n").alias("n_b"),
        F.col("component").alias("other"),
        F.col("wide").alias("wide_b"),
        F.col("tokens").alias("tokens_b"),
    )
    crossing = (F.col("set") < F.col("b")) & (F.col("component") != F.col("other")) & _sized("n", "n_b") & ~F.arrays_overlap("wide", "wide_b")
    retained = F.size(F.array_intersect("tokens", "tokens_b")) >= MATCHES
    return known.join(other, (F.col("token") == F.col("token_b")) & crossing & retained).select(F.col("set").alias("a"), "b").distinct()


def link_components(classes: DataFrame, postings: DataFrame, sets: DataFrame) -> DataFrame | None:
    """(set, component) of the linked classes, None if there are none."""
    links: list[DataFrame] = []
    parts: DataFrame | None = None

    def join_up(found: DataFrame) -> None:
        nonlocal parts
        if found.limit(1).count():
            links.append(found)
            parts = components(functools.reduce(DataFrame.union, links))

    here = _open(postings, parts)
    join_up(written(confirmed(written(leader_pairs(here), "dup-pairs"), classes, sets), "dup-links"))
    here = _open(postings, parts)
    wide = written(wide_lists(here), "dup-wide")
    join_up(written(block_links(here, wide, classes, sets), "dup-links"))
    here = _open(postings, parts)
    join_up(written(confirmed(written(crossing_pairs(here, wide, classes), "dup-pairs"), classes, sets), "dup-links"))
    return parts


def _decided(docs: DataFrame, id_col: str, text_col: str, digests: bool) -> DataFrame:
    """(id, n_shingles, component_id, kept), a row for each row of docs; with digests also __dup_text."""
    ship(docs.sparkSession)
    start = mark(docs.sparkSession)
    members = written(signatures(docs, id_col, text_col, digests), "dup-members")
    worded = members.filter("__dup_n > 0")
    first = F.min(F.struct(F.col("__dup_id").isNull().alias("none"), F.col("__dup_id").alias("id"), F.col("__dup_tokens").alias("tokens"))).alias("first")
    classes = written(
        worded.groupBy(F.col("__dup_set").alias("set"), F.col("__dup_n").alias("n")).agg(first).select("set", "n", F.col("first.id").alias("id"), F.col("first.tokens").alias("tokens")),
        "dup-classes",
    )
    postings = written(prefix_postings(classes), "dup-postings")
    listed = postings.select("set").distinct()
    ids = small_side(written(classes.join(listed, "set").select(F.col("id").alias(id_col)).distinct(), "dup-ids"))
    texts = docs.select(id_col, text_col)
    texts = texts.join(ids, id_col, "left_semi").unionAll(texts.filter(F.col(id_col).isNull()))
    sets = texts.select(text_col).mapInArrow(_sets, "set binary, shingles array<long>").filter("set is not null")
    sets = written(sets.join(listed, "set", "left_semi").dropDuplicates(["set"]), "dup-sets")
    parts = link_components(classes, postings, sets)
    named = classes.select("set", "id")
    if parts is None:
        ends = named.select("set", F.col("id").alias("component_id"))
    else:
        joined = named.join(parts, "set", "left").withColumn("component", F.coalesce("component", "set"))
        least = joined.groupBy("component").agg(F.min("id").alias("component_id"))
        ends = joined.join(least, "component").select("set", "component_id")
    ends = written(ends, "dup-ends")
    release(docs.sparkSession, start, (members, ends))
    also = ["__dup_text"] if digests else []
    out = members.select("__dup_id", "__dup_n", "__dup_set", *also).join(ends, F.col("__dup_set") == ends["set"], "left")
    own = F.when(F.col("__dup_n") == 0, F.col("__dup_id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("__dup_id").alias(id_col),
        F.col("__dup_n").alias("n_shingles"),
        own.alias("component_id"),
        F.col("__dup_id").eqNullSafe(own).alias("kept"),
        *also,
    )


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept), a row for each row of docs with an id and one for each without."""
    return _decided(docs, id_col, text_col, False)


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the near duplicates of another: of each component the rows with its smallest id stay."""
    docs, back = aside(docs, "__dup_")
    gone = _decided(docs, id_col, text_col, True).filter(~F.col("kept")).select(F.col(id_col).alias("__dup_gone"), "__dup_text").distinct()
    gone = small_side(written(gone, "dup-gone"))
    # rows of one id and one text have one set, so they share their decision
    same = docs[id_col].eqNullSafe(gone["__dup_gone"]) & (_digest(docs[text_col]) == gone["__dup_text"])
    return docs.join(gone, same, "left_anti").select(*back)
