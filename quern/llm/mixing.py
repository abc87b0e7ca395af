"""Mixing sources to target weights with exact block quotas.

Targets.  Sources in code point order (null last) get the weights in turn and share all words by weight; a target stops
at ``max_repeats`` times its source's size and the excess is reshared.  This is water filling: over sources sorted by
size per weight the capped ones are a prefix, found with running sums over one row per source (per range of sources first, then
over the ranges, so that no task holds all sources).

Quotas.  A block is one document in one pass over its source.  A source's target gives whole passes and a rest.  The rest
is taken first-fit in a permuted order (by md5 of seed, id and text): a document is taken if what is left has room for it.  That walk goes
by buckets of the order (about 256 documents, at most the source's 65,536th part): up to the bucket where the rest runs out
all documents with room are taken, that one is walked in order.  Behind it, what is left has room for so many documents of each size at most, and
only the buckets that hold the first so many are walked.

Shards.  ``splitting_tree`` halves the output shards again and again, and splits the sources' block quotas between the halves by
multivariate-hypergeometric draws until each shard has its exact count of each source.  Each shard then gets a disjoint run of each source's
permuted blocks and orders them by a local key.  Trees run in tasks, one per group of sources: a group's counts by shard
come first, from the same kind of draws along the halves of all groups.  Draws are exact at any size and seeded by their node, so tasks
that run twice agree.  ``mix`` counts each document's blocks in the shards; ``mix_documents`` deals the documents themselves: a
partition is a shard, in its shuffled order.

Sizes and keys are thin, equal ones are counted before anything is ranked; sources, picks and the keys at which runs begin are joined by
value, and the session decides by their measured size whether to broadcast them.  ``mix`` doesn't shuffle text; ``mix_documents``
shuffles it once, to its shard, and once more where the table of run beginnings is too large to broadcast.  The driver
holds one number per group of sources.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own; rows of equal id, source and
text stand or fall together; without any words all targets are 0; an empty table gives an empty one; further columns are
ignored, and kept by ``mix_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS, MAX_BUCKETS = 256, 65536
#: Words of a shard; beyond so many shards they grow instead.  Cells (sources times shards) of one task's tree.
SHARD_WORDS, MAX_SHARDS, TREE_CELLS = 1 << 21, 65536, 1 << 22
_FEW = 32


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def order_key(doc_id: Column, text: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def _buckets(n: str) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(MAX_BUCKETS), F.floor(F.col(n) / BUCKET_ROWS))).cast("bigint")


def _bucket(lead: Column, buckets: Column) -> Column:
    """Buckets follow the order of the keys, whose leading 16 bits are given."""
    return F.floor(lead.cast("bigint") * buckets / F.lit(65536)).cast("bigint")


def _key_bucket(key: Column, buckets: Column) -> Column:
    return _bucket(F.conv(F.substring(key, 1, 4), 16, 10), buckets)


def _block_bucket(block: Column, buckets: Column) -> Column:
    return _bucket(F.shiftright(block, 48) + 32768, buckets)


def _running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``df`` with running sums in ``order``, which must tell all rows apart: within ranges, after the sums of the ranges before."""
    laid = cut(df.withColumns(sums).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = laid.groupBy("_range").agg(*[F.sum(c).alias(c) for c in sums]).select(F.col("_range").alias("_r"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row per partition of the exchange
    return laid.join(F.broadcast(ranges), F.col("_range") == F.col("_r")).select(*df.columns, *[(F.col(f"_{c}") + F.sum(c).over(inside)).alias(c) for c in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source of (source, size): source_size, buckets, target, passes and rest."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    placed = _running(by, [F.col("source").asc_nulls_last()], place=F.lit(1).cast("bigint"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")).cast("bigint")
    out = placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats)
    out = _running(out, [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()], cap_upto=F.col("cap"), weight_upto=F.col("weight"))
    whole = out.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    before, weight_on = F.col("cap_upto") - F.col("cap"), F.lit(whole.weight) - F.col("weight_upto") + F.col("weight")
    out = out.withColumn("capped", (F.lit(whole.words) - before).cast("double") * F.col("weight") >= F.col("cap").cast("double") * weight_on)
    free = out.agg(F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0)).alias("given"), F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))), F.lit(0)).alias("weight")).first()
    share = F.lit(float(whole.words - free.given) / free.weight if free.weight else 0.0)
    out = out.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * share))
    out = out.withColumn("goal", F.floor(F.col("target") + 0.5).cast("bigint")).withColumn("passes", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0).cast("bigint")))
    return out.select("source", "source_size", _buckets("n").alias("buckets"), "target", "passes", (F.col("goal") - F.col("passes") * F.col("source_size")).alias("rest"))


_PICKED = "source string, key string, unit bigint"


def _first_fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("key")
    left, taken = int(rows["left"].iloc[0]), []
    for unit in rows["unit"]:
        taken.append(fits := unit <= left)
        left -= unit * fits
    return rows.loc[taken, ["source", "key", "unit"]]


def plan(thin: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame]:
    """From (source, size, key): the sources with ``edge``, the bucket before which the rest takes all documents of up to ``rest`` words (null: no
    end), and the picks (source, key) from there on."""
    sources = cut(source_targets(thin, weights, max_repeats), "targets")
    s = sources.filter("rest > 0").select(F.col("source").alias("_s"), "buckets", "rest")
    able = thin.select("source", "size", "key").join(s, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") > 0) & (F.col("size") <= F.col("rest"))).withColumn("bucket", _key_bucket(F.col("key"), F.col("buckets")))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = able.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(upto))
    over = F.col("upto") > F.col("rest")
    edges = cut(sums.groupBy(F.col("source").alias("_e"), "rest").agg(F.min(F.when(over, F.col("bucket"))).alias("edge"), F.coalesce(F.max(F.when(~over, F.col("upto"))), F.lit(0)).alias("whole")).select("_e", "edge", (F.col("rest") - F.col("whole")).alias("left")).filter("edge is not null"), "edges")
    at_edge = able.join(edges, F.col("source").eqNullSafe(F.col("_e")) & (F.col("bucket") == F.col("edge"))).groupBy("source", "key", "left").agg(F.sum("size").alias("unit"))
    first = cut(at_edge.groupBy("source").applyInPandas(_first_fit, _PICKED), "picks")
    used = first.groupBy(F.col("source").alias("_u")).agg(F.sum("unit").alias("used"))
    room = edges.join(used, F.col("_e").eqNullSafe(F.col("_u")), "left").select("_e", "edge", (F.col("left") - F.coalesce("used", F.lit(0))).alias("room")).filter("room > 0")
    behind = able.select("source", "size", "key", "bucket").join(room, F.col("source").eqNullSafe(F.col("_e")) & (F.col("bucket") > F.col("edge")) & (F.col("size") <= F.col("room")))
    # of one size at most room / size more have a place: the buckets that hold the first so many
    units = behind.groupBy("source", "bucket", "key", F.col("room").alias("left")).agg(F.sum("size").alias("unit"))
    earlier = Window.partitionBy("source", "unit").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    enough = units.groupBy("source", "unit", "bucket", "left").agg(F.count("*").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).filter(F.col("earlier") < F.expr("left div unit"))
    near = units.join(enough.select(F.col("source").alias("_n"), F.col("unit").alias("_nu"), F.col("bucket").alias("_nb")), F.col("source").eqNullSafe(F.col("_n")) & (F.col("unit") == F.col("_nu")) & (F.col("bucket") == F.col("_nb")))
    more = near.select("source", "key", "left", "unit").groupBy("source").applyInPandas(_first_fit, _PICKED)
    picks = cut(first.select("source", "key").unionByName(more.select("source", "key")), "all-picks")
    return sources.join(edges.select("_e", "edge"), F.col("source").eqNullSafe(F.col("_e")), "left").drop("_e"), picks


def _with_copies(rows: DataFrame, sources: DataFrame, picks: DataFrame) -> DataFrame:
    """Adds _copies and the columns of ``sources`` to rows that have _source, _size and _key."""
    p = picks.select(F.col("source").alias("_ps"), F.col("key").alias("_pk"), F.lit(1).alias("_picked"))
    out = rows.join(sources.withColumnRenamed("source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).join(p, F.col("_source").eqNullSafe(F.col("_ps")) & (F.col("_key") == F.col("_pk")), "left")
    bucket = _key_bucket(F.col("_key"), F.col("buckets"))
    chosen = (F.col("_size") <= F.col("rest")) & (F.col("edge").isNull() | (bucket < F.col("edge"))) | F.col("_picked").isNotNull()
    copies = F.when(F.col("_size") > 0, F.col("passes") + chosen.cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return out.withColumn("_copies", copies).drop("_s", "_ps", "_pk", "_picked")


def _blocks(rows: DataFrame, seed: int) -> DataFrame:
    """A row per copy, and one without a block for rows that the mix doesn't take."""
    copies = F.when(F.col("_copies") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))
    return rows.select("*", F.explode_outer(copies).alias("_copy")).withColumn("_block", F.when(F.col("_copy").isNotNull(), F.xxhash64(F.lit(seed), "_copy", "_key")))


# --- the splitting tree


def draw(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """Of ``n`` draws without replacement from ``counts`` items of each kind, how many are of each kind; exact at any size.

    Items that are taken independently with probability n / total are, given their number, a uniform choice; what is missing is drawn
    from the others in the same way, what is too much from those taken.  The difference falls to its square root each time."""
    out, left, sign = np.zeros_like(counts), counts.copy(), 1
    while n:
        total = int(left.sum())
        if 2 * n > total:  # rather choose what stays
            out, left, n, sign = out + sign * left, left.copy(), total - n, -sign
        elif n <= _FEW:
            for _ in range(n):
                k = int(np.searchsorted(np.cumsum(left), rng.integers(total), side="right"))
                out[k] += sign
                left[k] -= 1
                total -= 1
            n = 0
        else:
            some = rng.binomial(left, n / total)
            got = int(some.sum())
            out = out + sign * some
            if got <= n:
                left, n = left - some, n - got
            else:
                left, n, sign = some, got - n, -sign
    return out


def splitting_tree(quotas: list[int] | np.ndarray, capacities: np.ndarray, seed: tuple[int, ...] = (SEED,)) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, its count of each source) in the shards' order.  Each node splits its counts between its two halves of shards by a
    multivariate-hypergeometric draw; the quotas' and the capacities' sums are equal."""
    upto = np.concatenate([[0], np.cumsum(capacities)]).astype(np.int64)
    stack = [(0, len(capacities), np.array(quotas, dtype=np.int64))]
    while stack:
        low, high, counts = stack.pop()
        if high - low == 1:
            yield low, counts
            continue
        mid = (low + high) // 2
        left = draw(np.random.default_rng([*seed, low, high]), counts, int(upto[mid] - upto[low]))
        stack += [(mid, high, counts - left), (low, mid, left)]


def group_capacities(totals: np.ndarray, group: int, n_shards: int, seed: int = SEED) -> np.ndarray:
    """How many blocks of a group of sources each shard gets: along the halves of all groups, each half's counts by shard are drawn from
    those of both.  With one group: the shards' sizes, which differ by one at most."""
    upto = np.concatenate([[0], np.cumsum(totals)]).astype(np.int64)
    total = int(upto[-1])
    counts = np.diff(np.array([total * k // n_shards for k in range(n_shards + 1)], dtype=np.int64))
    low, high = 0, len(totals)
    while high - low > 1:
        mid = (low + high) // 2
        left = draw(np.random.default_rng([seed, 1, low, high]), counts, int(upto[mid] - upto[low]))
        low, high, counts = (low, mid, left) if group < mid else (mid, high, counts - left)
    return counts


_RUNS = "_s string, _b bigint, _first bigint, _places array<bigint>, _shards array<bigint>"


def _runs_of(rows: pd.DataFrame, capacities: np.ndarray, seed: tuple[int, ...]) -> pd.DataFrame:
    """From a group's (source, bucket, n) each bucket's first shard, and the places inside where other shards' runs begin."""
    rows = rows.sort_values(["source", "bucket"], na_position="last")
    names = rows["source"].astype(object).where(rows["source"].notna(), None).to_numpy()
    edges = np.flatnonzero(np.array([True, *(a != b for a, b in zip(names[1:], names[:-1]))]))
    ends, n = np.append(edges[1:], len(rows)), rows["n"].to_numpy()
    begins: list[list[int]] = [[] for _ in edges]
    shards: list[list[int]] = [[] for _ in edges]
    upto = np.zeros(len(edges), dtype=np.int64)
    for shard, counts in splitting_tree(np.add.reduceat(n, edges), capacities, seed):
        for s in np.flatnonzero(counts):
            begins[s].append(int(upto[s]))
            shards[s].append(shard)
        upto += counts
    first, places, after = [], [], []
    for s, (a, b) in enumerate(zip(edges, ends)):
        at, to = np.array(begins[s], dtype=np.int64), np.array(shards[s], dtype=np.int64)
        low = np.concatenate([[0], np.cumsum(n[a:b])])
        i, j = np.searchsorted(at, low[:-1], side="right"), np.searchsorted(at, low[1:], side="left")
        for x, y, start in zip(i, j, low):
            first.append(int(to[x - 1]))
            places.append((at[x:y] - start).tolist())
            after.append(to[x:y].tolist())
    return pd.DataFrame({"_s": names, "_b": rows["bucket"].to_numpy(), "_first": first, "_places": places, "_shards": after})


def deal(blocks: DataFrame, n_shards: int, n_sources: int, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """From (source, block), block being a key of the permuted order: each source's number of buckets (_q, _n), and by source and bucket (_s, _b) the first shard and
    ``_cuts``, the (key, nth, shard) from which on another shard's run goes: at the nth of the blocks of that key."""
    keys = cut(blocks.groupBy("source", "block").agg(F.count("*").alias("n")), "blocks")
    quotas = cut(keys.groupBy(F.col("source").alias("_q")).agg(F.count("*").alias("m"), F.sum("n").alias("blocks")).select("_q", _buckets("m").alias("_n"), "blocks"), "block-quotas")
    n_groups = max(1, -(-n_sources * n_shards // TREE_CELLS))
    group = F.pmod(F.xxhash64("_q"), F.lit(n_groups))
    totals = np.zeros(n_groups, dtype=np.int64)
    for r in quotas.groupBy(group.alias("g")).agg(F.sum("blocks").alias("n")).collect():  # one number per group
        totals[r.g] = r.n
    given = keys.sparkSession.sparkContext.broadcast(totals)
    placed = keys.join(quotas.select("_q", "_n", group.cast("int").alias("g")), F.col("source").eqNullSafe(F.col("_q"))).withColumn("bucket", _block_bucket(F.col("block"), F.col("_n")))
    counts = placed.groupBy("g", "source", "bucket").agg(F.sum("n").alias("n"))

    def runs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        g = int(key[0])
        return _runs_of(rows, group_capacities(given.value, g, n_shards, seed), (seed, 2, g))

    begun = cut(counts.groupBy("g").applyInPandas(runs, _RUNS), "runs")
    inside = Window.partitionBy("source", "bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parted = placed.join(begun.filter(F.size("_places") > 0), F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b"))).withColumn("begin", F.sum("n").over(inside) - F.col("n"))
    here = F.filter(F.arrays_zip("_places", "_shards"), lambda p: (p["_places"] >= F.col("begin")) & (p["_places"] < F.col("begin") + F.col("n")))
    cuts = parted.select("source", "bucket", "block", "begin", F.explode(here).alias("p")).groupBy(F.col("source").alias("_cs"), F.col("bucket").alias("_cb"))
    cuts = cuts.agg(F.array_sort(F.collect_list(F.struct(F.col("block").alias("key"), (F.col("p._places") - F.col("begin")).alias("nth"), F.col("p._shards").alias("shard")))).alias("_cuts"))
    table = begun.join(cuts, F.col("_s").eqNullSafe(F.col("_cs")) & (F.col("_b") == F.col("_cb")), "left").select("_s", "_b", "_first", "_cuts")
    return quotas.drop("blocks"), cut(table, "run-beginnings")


def _with_shards(rows: DataFrame, quotas: DataFrame, table: DataFrame) -> DataFrame:
    """Adds _shard to rows that have _source and _block (null: no shard).  Blocks of one key that a run's beginning parts are numbered:
    within the partitions of a written table, then over them."""
    joined = rows.join(quotas, F.col("_source").eqNullSafe(F.col("_q")), "left").withColumn("_bucket", _block_bucket(F.col("_block"), F.col("_n")))
    joined = joined.join(table, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")), "left")

    def shard(nth: Column) -> Column:
        before = F.filter("_cuts", lambda c: (c["key"] < F.col("_block")) | ((c["key"] == F.col("_block")) & (c["nth"] <= nth)))
        return F.coalesce(F.try_element_at(before, F.lit(-1))["shard"], F.col("_first"))

    split = F.coalesce(F.exists("_cuts", lambda c: (c["key"] == F.col("_block")) & (c["nth"] > 0)), F.lit(False))
    if table.filter(F.exists("_cuts", lambda c: c["nth"] > 0)).isEmpty():
        return joined.select(*rows.columns, shard(F.lit(0)).alias("_shard"))
    whole = joined.filter(~split).select(*rows.columns, shard(F.lit(0)).alias("_shard"))
    parts = cut(joined.filter(split).select(*rows.columns, "_first", "_cuts", F.spark_partition_id().alias("_part")), "parted")
    over = Window.partitionBy("_source", "_block").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy("_source", "_block", "_part").agg(F.count("*").alias("n")).select(F.col("_source").alias("_ws"), F.col("_block").alias("_wb"), F.col("_part").alias("_wp"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_source", "_block", "_part").orderBy(F.lit(0))) - 1
    numbered = parts.withColumn("_own", own).join(before, F.col("_source").eqNullSafe(F.col("_ws")) & (F.col("_block") == F.col("_wb")) & (F.col("_part") == F.col("_wp")))
    return whole.unionByName(numbered.select(*rows.columns, shard(F.col("_before") + F.col("_own")).alias("_shard")))


def shards_for(words: float) -> int:
    """Shards of about SHARD_WORDS words."""
    return max(1, min(-int(-words // SHARD_WORDS), MAX_SHARDS))


def _thin(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    doc_id = df[id_col].cast("bigint")
    return [doc_id.alias("_id"), df[source_col].cast("string").alias("_source"), size_of(df[text_col]).alias("_size"), order_key(doc_id, df[text_col], seed).alias("_key")]


def _dealt(rows: DataFrame, thin: DataFrame, weights: tuple[int, ...], max_repeats: int, seed: int, n_shards: int | None) -> tuple[DataFrame, int]:
    """``rows``' blocks with _shard, ``thin`` being their _source, _size and _key."""
    sources, picks = plan(thin.select(F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_key").alias("key")), weights, max_repeats)
    all_ = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("words"), F.count("*").alias("n")).first()
    shards = n_shards or shards_for(all_.words)
    blocks = lambda x: _blocks(_with_copies(x, sources, picks), seed)
    quotas, table = deal(blocks(thin).filter("_block is not null").select(F.col("_source").alias("source"), F.col("_block").alias("block")), shards, all_.n, seed)
    return _with_shards(blocks(rows), quotas, table), shards


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED, n_shards: int | None = None) -> DataFrame:
    """One row per row of ``df``: doc_id, source, size, source_size, target, copies, the times the mix takes it as counted in the drawn
    blocks, and their shards."""
    thin = cut(df.select(*_thin(df, id_col, text_col, source_col, seed)), "sizes")
    drawn, _ = _dealt(thin, thin, weights, max_repeats, seed, n_shards)
    first = F.coalesce(F.col("_copy"), F.lit(1)) == 1
    units = drawn.groupBy("_id", "_source", "_size", "_key", "source_size", "target").agg(F.count("_shard").alias("_drawn"), F.sum(first.cast("bigint")).alias("_rows"), F.array_sort(F.collect_set("_shard")).alias("shards"))
    each = units.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_rows"))))
    return each.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", F.expr("_drawn div _rows").alias("copies"), "shards")


def mix_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED, n_shards: int | None = None) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it, dealt to shards: partition k is shard k in its shuffled order."""
    own = _thin(df, id_col, text_col, source_col, seed)[1:]
    thin = cut(df.select(*own), "sizes")
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"), *own)
    drawn, shards = _dealt(rows, thin, weights, max_repeats, seed, n_shards)
    dealt = drawn.filter("_block is not null").select("_row", "_block", F.col("_shard").cast("int").alias("_shard"))
    return dealt.repartitionById(shards, F.col("_shard")).sortWithinPartitions(F.xxhash64(F.lit(seed), "_block"), "_block").select("_row.*")
