"""MinHash near-dedup by chosen-path set similarity join.

Texts with equal word sequences are one class. In each of TREES independent trees a class goes down a path of minwise
tokens: nodes are the classes that agree on the coordinates chosen so far. Small nodes are compared exhaustively by
signature; larger ones branch on two further coordinates. What is still large at the last level is tied together
without a comparison. Classes that candidates connect are one mass, and every mass is searched whole on the full
shingle sets, so that a candidate decides only where is looked, and a link inside a mass is never lost. A mass that is
too large for one task is cut into parts: parts are searched by themselves, the largest clusters of the parts are held
together, and what is outside the mass's largest cluster then meets every part. Components come from min-label
propagation with pointer jumping over written edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, numbered, small, table, written
from .words import SPACED, mixed, tokens

#: Words of a shingle; coordinates of a signature; trees; coordinates of the first level; levels; rows of a small node.
SHINGLE, COORDS, TREES, FIRST, LEVELS, SMALL = 5, 96, 14, 3, 3, 24
#: Shingles of a part: masses are cut into parts of about as many, and small masses are searched together up to as many.
PART = 400_000
#: Share of equal coordinates, below the threshold, that a candidate needs: about four standard errors.
SLACK = 0.15
#: Rows of classes that are asked for their sets, up to which they may be broadcast.
ASKED = 400_000
_A = np.random.default_rng(9).integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Class (a hash of the word sequence, 0 without words) and sorted distinct shingle hashes of each text."""
    for _, words, ends in tokens(texts, SPACED):
        h = np.zeros(max(len(words) - SHINGLE + 1, 0), np.uint64)
        for i in range(SHINGLE):
            h = mixed((h ^ words[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15))
        # The class takes every word with its place.
        begins = np.r_[0, ends[:-1]]
        place = np.arange(len(words), dtype=np.uint64) - np.repeat(begins, ends - begins).astype(np.uint64)
        each = mixed((words ^ (place * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15))
        sums = np.r_[np.uint64(0), np.cumsum(each)]
        classes = (sums[ends] - sums[begins]).view(np.int64)
        for k, (a, e) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
            yield int(classes[k]), np.unique(h[a : e - SHINGLE + 1].view(np.int64)) if e - a >= SHINGLE else classes[k : k + int(e > a)]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    return next(_sets(pa.array([text], pa.string())))[1]


def signature(s: np.ndarray) -> np.ndarray:
    """COORDS minima over the whole set, in slices that bound memory."""
    best = np.full(COORDS, 2**64 - 1, np.uint64)
    u = s.view(np.uint64)
    for i in range(0, len(u), 1024):
        best = np.minimum(best, np.multiply.outer(u[i : i + 1024], _A).min(0))
    return (best >> np.uint64(32)).astype(np.uint32)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *values])))


def _with(batch: pa.RecordBatch, without: str, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch without one column and with others."""
    own = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != without} | columns
    return pa.RecordBatch.from_arrays(list(own.values()), names=list(own))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(c, len(s), signature(s).tobytes() if len(s) else None) for c, s in _sets(batch.column("text"))]
        c, n, sig = zip(*found, strict=True) if found else ((), (), ())
        yield _with(batch, "text", {"class": pa.array(c, pa.int64()), "n": pa.array(n, pa.int64()), "sig": pa.array(sig, pa.binary())})


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the rows whose class is asked for."""
    for batch in batches:
        found = list(_sets(batch.column("text")))
        own = np.array([c for c, _ in found], np.int64) == batch.column("rep").to_numpy()
        kept = _with(batch, "text", {}).filter(pa.array(own))
        yield _with(kept, "", {"s": _lists([s for (_, s), x in zip(found, own.tolist(), strict=True) if x])})


def _signatures(column: pa.Array) -> np.ndarray:
    """Rows of a matrix; signatures are never null and all of one size."""
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(data, np.uint8)[first : first + len(column) * COORDS * 4].view(np.uint32).reshape(-1, COORDS) if len(column) else np.empty((0, COORDS), np.uint32)


def _key(tree: int, picks: list[int], sig: np.ndarray) -> np.ndarray:
    h = np.full(len(sig), tree + 1, np.uint64)
    for p in picks:
        h = (h ^ sig[:, p].astype(np.uint64) ^ np.uint64(p << 40)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def _paths(level: int) -> list[tuple[int, list[int]]]:
    """(tree, coordinates) of every path of a level: the first ones, then two branches at each level."""
    out = []
    for tree in range(TREES):
        order = np.random.default_rng(100 + tree).permutation(COORDS)
        paths = [list(order[:FIRST])]
        for lv in range(1, level + 1):
            paths = [[*p, int(order[FIRST + 2 * lv + b])] for p in paths for b in range(2)]
        out += [(tree, p) for p in paths]
    return out


def _hung(level: int):
    """rep, path, key: the nodes of a level that each class hangs on."""
    paths = _paths(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _signatures(batch.column("sig"))
            keys = np.concatenate([_key(t, p, sig) for t, p in paths])
            path = np.repeat(np.arange(len(paths), dtype=np.int32), len(sig))
            rep = np.tile(batch.column("rep").to_numpy(), len(paths))
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(path), pa.array(keys)], names=["rep", "path", "key"])

    return run


def _agreeing(least: int):
    """a, b of the pairs whose signatures agree on enough coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_numpy(), batch.column("y").to_numpy()
            keep = (_signatures(batch.column("xs")) == _signatures(batch.column("ys"))).sum(1) >= least
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[keep]), pa.array(np.maximum(x, y)[keep])], names=["a", "b"])

    return run


def candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """a, b: classes whose signatures agree on enough coordinates, and what a large node of the last level ties together."""
    slim, found, used = sets.select("rep", "sig"), [], []
    for level in range(LEVELS):
        hung = slim.select("rep", "sig").mapInArrow(_hung(level), "rep long, path int, key long")
        tally = written(hung.groupBy("path", "key").agg(F.count("*").alias("rows")).filter("rows > 1"), f"near_nodes_{level}")
        members = written(hung.join(small(tally), ["path", "key"]).join(slim, "rep"), f"near_members_{level}")
        node = Window.partitionBy("path", "key").orderBy("sig", "rep")
        near = members.filter(f"rows <= {SMALL}")
        ahead = near.withColumn("later", F.collect_list(F.struct("rep", "sig")).over(node.rowsBetween(1, SMALL)))
        pairs = ahead.select(F.col("rep").alias("x"), F.col("sig").alias("xs"), F.explode("later").alias("o")).select("x", "xs", F.col("o.rep").alias("y"), F.col("o.sig").alias("ys"))
        good = pairs.mapInArrow(_agreeing(int((threshold - SLACK) * COORDS)), "a long, b long")
        found.append(written(good.distinct(), f"near_pairs_{level}"))
        # Classes of large nodes go on; those of small nodes are done in that tree.
        large = members.filter(f"rows > {SMALL}")
        used += [tally, members]
        if level + 1 < LEVELS:
            slim = written(large.select("rep", "sig").dropDuplicates(["rep"]), f"near_slim_{level}")
            used.append(slim)
    heads = large.groupBy("path", "key").agg(F.min("rep").alias("a"))
    out = large.join(heads, ["path", "key"]).select("a", F.col("rep").alias("b")).filter("a <> b")
    for more in found:
        out = out.union(more)
    out = written(out.distinct(), "near_candidates")
    dropped(*used, *found)
    return out


def clusters(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """For each set the number of its cluster's hub: clusters are what links connect, the hub has the most links seen.

    Each set that is reached is held against all others; the search ends when all are reached.
    """
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(codes, kind="stable")]
    first = np.cumsum(np.r_[0, np.bincount(codes)])
    hub, free, percent = np.arange(len(sets)), np.ones(len(sets), bool), round(threshold * 100)
    for seed in range(len(sets)):
        if not free[seed]:
            continue
        free[seed] = False
        todo, reached, best, most = [seed], [seed], seed, -1
        while todo and (most < 0 or free.any()):
            x = todo.pop()
            own = codes[ends[x] - sizes[x] : ends[x]]
            n = first[own + 1] - first[own]
            at = np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(holders[at], minlength=len(sets))
            linked = 100 * both >= percent * (sizes[x] + sizes - both)
            if linked.sum() > most:
                best, most = x, linked.sum()
            hit = np.flatnonzero(free & linked)
            free[hit] = False
            reached += hit.tolist()
            todo += hit.tolist()
        hub[reached] = best
    return hub


def _searched(groups: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """hub, rep for every class of each group of sets."""

    def links(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        reps, first = np.unique(group.column("rep").to_numpy(), return_index=True)
        own = group.column("s").combine_chunks()
        values, at = own.values.to_numpy(), own.offsets.to_numpy()
        return pa.table({"hub": reps[clusters([values[at[i] : at[i + 1]] for i in first.tolist()], threshold)], "rep": reps})

    return groups.groupBy(*keys).applyInArrow(links, "hub long, rep long")


def mass_links(sets: DataFrame, threshold: float) -> DataFrame:
    """a, b: links that hold together whatever is linked inside a mass; sets has rep, s, mass, n and parts (of its mass)."""
    together = F.when(F.col("parts") == 1, F.lit(None)).otherwise(F.col("mass"))
    total = sets.filter("parts = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    part = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("mass"), F.lit(total // PART + 1))).otherwise(F.pmod(F.xxhash64("rep"), F.col("parts")))
    sets = sets.select("rep", "s", "n", "parts", together.alias("mass"), part.alias("part"))
    inside = written(_searched(sets.select("mass", "part", "rep", "s"), ["mass", "part"], threshold), "near_inside")
    edges = inside.filter("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    big = sets.filter("parts > 1")
    if big.select("rep").isEmpty():
        return edges
    # The largest cluster of each part has a hub; hubs of one mass are held together.
    own = inside.join(big.select("rep", "mass", "part", "parts", "n"), "rep")
    sizes = own.groupBy("mass", "part", "hub").agg(F.count("*").alias("rows"))
    hubs = sizes.groupBy("mass", "part").agg(F.max_by("hub", F.struct("rows", "hub")).alias("rep")).select("rep")
    met = big.join(hubs, "rep").select("mass", F.pmod(F.xxhash64("part"), F.ceil(F.col("parts") / 1000)).alias("part"), "rep", "s")
    over = written(_searched(met, ["mass", "part"], threshold), "near_hubs")
    edges = edges.union(over.filter("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")))
    # What is outside the largest cluster of its mass meets every part.
    named = components(big.select("rep"), edges.join(big.select(F.col("rep").alias("b")), "b", "left_semi").select("a", "b")).join(big.select("rep", "mass", "n"), "rep")
    named = written(named, "near_clusters")
    largest = named.groupBy("mass", "component").agg(F.count("*").alias("rows")).groupBy("mass").agg(F.max_by("component", F.struct("rows", "component")).alias("largest"))
    rest = named.join(largest, "mass").filter("component <> largest").select("mass", "rep", "n")
    cut = written(rest.groupBy("mass").agg(F.ceil(F.sum("n") / PART).alias("cuts")), "near_cuts")
    if cut.isEmpty():
        return edges
    outside = rest.join(small(cut), "mass").select("rep", F.pmod(F.xxhash64("rep", F.lit(1)), "cuts").alias("cut"))
    left = big.join(outside, "rep").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1)))
    right = big.join(small(cut), "mass").withColumn("cut", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1)))
    columns = ["mass", "part", "cut", "rep", "s"]
    last = written(_searched(left.select(*columns).union(right.select(*columns)), ["mass", "part", "cut"], threshold).filter("hub <> rep").distinct(), "near_rest")
    return edges.union(last.select(F.col("hub").alias("a"), F.col("rep").alias("b")))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rep, component: the smallest rep reachable. Each round is a written table, so a lost executor costs a round."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "near_edges")
    label = written(both.select(F.col("a").alias("rep")).distinct().withColumn("component", F.col("rep")), "near_label")
    while True:
        heard = both.join(label, both["b"] == label["rep"]).groupBy("a").agg(F.min("component").alias("c"))
        near = label.join(heard, label["rep"] == heard["a"]).select("rep", F.col("component").alias("was"), F.least("component", "c").alias("component"))
        up = near.select(F.col("rep").alias("r"), F.col("component").alias("cc"))
        step = near.join(up, near["component"] == up["r"], "left").select("rep", "was", F.least("component", F.coalesce("cc", "component")).alias("component"))
        step = written(step, "near_label")
        label = step.select("rep", "component")
        if step.filter("was <> component").isEmpty():
            break
    return nodes.select("rep").join(label, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"))


def near_rows(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, component, component_id: a row for each row of docs; text_key is xxhash64 of the text.

    Rows without words (null, empty, blank) have no shingles and stand alone. A row without id is in no group
    (component_id null). Rows with one id and unlike texts are told apart by their texts: each has the component of its
    own text; such components may share their smallest id, and component parts them. Equal word sequences and shingles are known by 64-bit hashes. A pair at the threshold t that is in no
    common mass is missed with a chance of about (1 - t^3)^TREES: 4e-5 at 0.8, 2e-6 at 0.85. An empty table gives an
    empty result; other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    keyed = source.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    rows = written(keyed.mapInArrow(_features, f"doc_id {kind}, text_key long, class long, n long, sig binary"), "near_rows")
    worded = rows.filter("n > 0 and doc_id is not null")
    classes = written(worded.groupBy(F.col("class").alias("rep")).agg(F.min("doc_id").alias("first_id"), F.first("sig").alias("sig"), F.first("n").alias("n")), "near_classes")
    pairs = candidates(classes.select("rep", "sig"), threshold)
    masses = written(components(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), pairs).join(classes.select("rep", "n", "first_id"), "rep").withColumnRenamed("component", "mass"), "near_masses")
    parts = masses.groupBy("mass").agg(F.ceil(F.sum("n") / PART).alias("parts")).filter("parts > 1")
    asked = written(masses.join(small(written(parts, "near_parts")), "mass", "left").withColumn("parts", F.coalesce("parts", F.lit(1))), "near_asked")
    # Full sets, of one text of each class in a mass only.
    texts = source.filter("doc_id is not null").join(small(asked.withColumnRenamed("first_id", "doc_id"), ASKED), "doc_id")
    full = texts.select("rep", "mass", "n", "parts", "text").mapInArrow(_full, "rep long, mass long, n long, parts long, s array<long>")
    if not worded.groupBy("doc_id", "class").count().filter("count > 1").isEmpty():
        full = full.dropDuplicates(["rep"])
    sets = written(full, "near_sets")
    edges = written(mass_links(sets, threshold), "near_links")
    dropped(sets, pairs, masses, asked)
    named = components(edges.select(F.col("a").alias("rep")).union(edges.select("b")).distinct(), edges)
    own = written(classes.select("rep", "first_id").join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "near_components")
    heads = own.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("linked")).filter("linked > 1")
    final = written(own.join(heads, "component", "left").select(F.col("rep").alias("class"), "component", F.coalesce("component_id", "first_id").alias("component_id")), "near_final")
    dropped(classes, edges, own)
    # Many rows may share a class; they are the large side of the join, which Spark splits.
    alone = rows.filter("n = 0 or doc_id is null").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"), F.when(F.col("n") == 0, F.col("doc_id")).alias("component_id"))
    return worded.join(small(final), "class").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component", "component_id").union(alone)


def near_groups(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of near_rows(); kept rows are those with the smallest id of a component, and those in none."""
    found = near_rows(docs, threshold, id_col, text_col).drop("text_key", "component")
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs without near copies: of each component the row with the smallest id (ties: smallest text_key, once).

    Rows without words or id stay, all of them. All columns of docs keep their names and values, whatever they are called.
    """
    names = docs.columns
    docs, (id_col, text_col) = numbered(docs, "doc_id", "text")
    found = near_rows(docs, threshold, id_col, text_col)
    grouped = found.filter("n_shingles > 0 and doc_id is not null")
    chosen = grouped.filter("doc_id = component_id").groupBy("component", F.col("component_id").alias("chosen")).agg(F.min("text_key").alias("key")).drop("component")
    chosen = written(grouped.join(chosen, (F.col("doc_id") == F.col("chosen")) & (F.col("text_key") == F.col("key"))).groupBy("chosen", "key").agg(F.count("*").alias("copies")), "near_chosen")
    gone = grouped.select("doc_id", "text_key").distinct().join(chosen, (F.col("doc_id") == F.col("chosen")) & (F.col("text_key") == F.col("key")), "left_anti")
    gone = written(gone.select(F.col("doc_id").alias("chosen"), F.col("text_key").alias("key")), "near_gone")
    own = (F.col(id_col) == F.col("chosen")) & (F.xxhash64(text_col) == F.col("key"))
    left = docs.join(small(gone, ASKED), own, "left_anti")
    again = written(chosen.filter("copies > 1").drop("copies"), "near_again")
    if again.isEmpty():
        return left.toDF(*names)
    repeated = left.join(small(again), own, "left_semi")
    once = repeated.withColumn("near_key", F.xxhash64(text_col)).dropDuplicates([id_col, "near_key"]).select(*docs.columns)
    return left.join(small(again), own, "left_anti").unionByName(once).toDF(*names)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), 0.85)


QUERIES = {"op9_near_dedup": op9_near_dedup}
SQL = {
    "op9_near_dedup": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') as ws
  from documents),
s as (select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                          when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as other from documents union select r.doc_id, e.b from r join e on e.a = r.other),
m as (select doc_id, min(other) as component_id from r group by doc_id)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, m.component_id, w.doc_id = m.component_id as kept
from w join m on m.doc_id = w.doc_id left join n on n.doc_id = w.doc_id
"""
}
