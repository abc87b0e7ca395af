r"""Secret scans with corpus-wide ownership frequency.  DataFrame functions only.

Base patterns (assign, access, hex) are always reported.  Further candidates are keys with a provider's prefix, signed
tokens, key blocks and long tokens.  Every candidate's value, a base one's too, is hashed, and each hash's distinct owners and repositories
are counted over the whole corpus before anything else is decided.  A value that more than ``max_owners`` owners or ``max_repos``
repositories hold is a copied example; one that fewer hold is theirs.  Each span carries both counts and that verdict.  A further candidate's span is
added if its value is owner-specific and looks live (a provider's prefix, or digits with both cases; ten different signs at least)
and no base span overlaps it.

Positions: a text's matches and the pieces between them (split at the same pattern) alternate, so running sums of their
lengths in code points are the places.

Shuffles carry hashes and ids, never text: (hash, owner, repository) is pre-aggregated on the map side, so a value in a third
of all rows costs one row per owner and repository; the counts go back to the documents by hash, once per document and value.

Defined cases: a null text is empty; null owners or repositories count as one unnamed one; rows of equal id and text have equal
spans; an empty table gives an empty one; further columns are ignored by ``secret_spans`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, running, text_or_empty

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Runs that the length rule keeps; shorter ones are dropped without effect on others, as a maximal run ends where the pattern ends.
ACCESS_KEPT, HEX_KEPT = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
EXTRA = r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----|[A-Za-z0-9+/_-]{32,}"
PREFIXED = r"^(gh[pousr]_|xox[abprs]-|AIza|[sr]k_live_|eyJ|-----BEGIN)"
KINDS = ("assign", "access", "hex", "live")
MAX_OWNERS, MAX_REPOS, LEAST_SIGNS = 2, 4, 10
_SPAN = "struct<start:bigint,rank:int,end:bigint,hash:string,looks:boolean>"


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _looks_live(value: Column) -> Column:
    """Prefixes of providers and key blocks speak for themselves; other values mix digits and both cases."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    mixed = value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
    return (value.rlike(PREFIXED) | mixed) & (distinct >= LEAST_SIGNS)


def _spans(text: Column, pattern: str, rank: int, holds: Column) -> Column:
    """Array of (start, rank, end, hash, looks) for the pattern's matches in ``text``, which is searched only if ``holds``."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if rank == 0 else found
    gap = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    before = running(F.zip_with(found, gap, lambda m, g: (F.length(m) + F.length(g)).cast("bigint")), "sum")
    starts = F.zip_with(before, gap, lambda at, g: at + F.length(g))
    values = F.zip_with(found, value, lambda m, v: F.struct(F.length(m).alias("n"), v.alias("v")))
    looks = _looks_live if rank == 3 else lambda v: F.lit(True)
    made = F.zip_with(starts, values, lambda at, x: F.struct(at.alias("start"), F.lit(rank).alias("rank"), (at + x["n"]).alias("end"), F.md5(x["v"]).alias("hash"), looks(x["v"]).alias("looks"), F.length(x["v"]).alias("n")))
    kept = F.filter(made, lambda x: x["n"] >= 6) if rank == 0 else made
    return F.when(holds & (F.size(found) > 0), F.transform(kept, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "rank", "end", "hash", "looks")]))).otherwise(_none(_SPAN))


def _scan(df: DataFrame, id_col: str, text_col: str, owner_col: str, repo_cols: tuple[str, ...]) -> DataFrame:
    repo = F.xxhash64(*[F.coalesce(df[c].cast("string"), F.lit("")) for c in repo_cols])
    rows = df.select(df[id_col].cast("bigint").alias("doc_id"), text_or_empty(df[text_col]).alias("text"), F.coalesce(df[owner_col].cast("string"), F.lit("")).alias("owner"), repo.alias("repo"))
    text = F.col("text")
    base = F.concat(_spans(text, ASSIGN, 0, text.contains("=") | text.contains(":")), _spans(text, ACCESS_KEPT, 1, text.contains("AKIA")), _spans(text, HEX_KEPT, 2, F.lit(True)))
    return rows.select("doc_id", "owner", "repo", F.xxhash64("text").alias("text_hash"), F.array_sort(base).alias("base"), _spans(text, EXTRA, 3, F.lit(True)).alias("extra"))


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per row of ``df``: doc_id, text_hash, base and spans, arrays of (start, rank, end, hash, owners, repos, live) in order of start and kind
    (``KINDS[rank]``); spans holds base's and the method's own."""
    scanned = cut(_scan(df, id_col, text_col, owner_col, repo_cols), "secret-candidates")
    held = scanned.select("doc_id", "text_hash", "owner", "repo", F.explode(F.array_distinct(F.transform(F.concat("base", "extra"), lambda s: s["hash"]))).alias("hash"))
    counts = held.groupBy("hash", "owner", "repo").agg(F.lit(1)).groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repos"))
    each = held.select("doc_id", "text_hash", "hash").distinct().join(counts, "hash").groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(F.map_from_entries(F.collect_list(F.struct("hash", F.struct("owners", "repos")))).alias("of"))
    out = scanned.join(each, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left")

    def judged(spans: Column) -> Column:
        n = lambda s, c: F.try_element_at("of", s["hash"])[c]
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["hash"].alias("hash"), n(s, "owners").alias("owners"), n(s, "repos").alias("repos"), ((n(s, "owners") <= max_owners) & (n(s, "repos") <= max_repos)).alias("live")))

    free = F.filter("extra", lambda x: x["looks"] & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    out = out.select("doc_id", "text_hash", judged(F.col("base")).alias("base"), judged(free).alias("extra"))
    return out.select("doc_id", "text_hash", "base", F.array_sort(F.concat("base", F.filter("extra", lambda x: x["live"]))).alias("spans"))


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def verdicts(spans: str) -> Column:
    """owners:repositories:verdict of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["owners"], s["repos"], F.when(s["live"], "live").otherwise("copied"))), ",")


def count_kind(spans: str, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("bigint")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, mask: str = "[SECRET]", copied: str = "[COPIED SECRET]") -> DataFrame:
    """``df`` with each found span replaced by ``mask``, or by ``copied`` if its value is a copied example (overlapping spans as one, by the verdict of the
    first); all rows stay."""
    found = secret_spans(df, id_col, text_col, owner_col, repo_cols, max_owners, max_repos).filter(F.size("spans") > 0)
    found = cut(found.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "spans").distinct(), "secrets")
    text = text_or_empty(df[text_col])
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"), text.alias("_text")).withColumn("_x", F.xxhash64("_text")).join(found, F.col(f"_row.{id_col}").cast("bigint").eqNullSafe(F.col("_d")) & (F.col("_x") == F.col("_h")), "left")
    # a span that begins before an earlier one ends adds no mask, and only what it has beyond that one goes too
    done = running(F.transform("spans", lambda s: s["end"]), "max")
    sub = lambda a, b: F.substr(F.col("_text"), (a + 1).cast("int"), (b - a).cast("int"))
    heads = F.zip_with("spans", done, lambda s, at: F.when(s["start"] >= at, F.concat(sub(at, s["start"]), F.when(s["live"], mask).otherwise(copied))).otherwise(""))
    tail = sub(F.array_max(F.transform("spans", lambda s: s["end"])), F.length("_text").cast("bigint"))
    masked = F.when(F.col("spans").isNull(), F.col(f"_row.{text_col}")).otherwise(F.concat(F.array_join(heads, ""), tail))
    return rows.select(*[masked.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in df.columns])
