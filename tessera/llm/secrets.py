"""Secret scan in DataFrame functions only, with corpus-wide ownership frequency of the candidate values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.skew import hot_join, weighed
from tessera.runtime import materialize

#: Kind: (pattern, group of the value, least length of the value). Runs of hex digits and of AKIA end where no such character follows, so the least length stands in the pattern.
BASE = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Long mixed tokens that only their ownership can tell from identifiers; the method's own kind.
OWNED = ("owned", (r"[A-Za-z0-9+/_-]{24,}={0,2}", 0, 24))
KINDS = [*BASE, OWNED[0]]


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Per match: characters before it since the last one, its length, and its value."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    rows = F.transform(F.arrays_zip(whole.alias("w"), value.alias("v"), gaps.alias("g")), lambda m: F.struct(m["g"].alias("gap"), F.length(m["w"]).alias("n"), m["v"].alias("v")))
    # split gives one gap more than there are matches
    return F.when(F.regexp_like(text, F.lit(pattern)), F.filter(rows, lambda m: m["n"].isNotNull()))


def scan_secrets(docs: DataFrame, example_owners: int = 3, live_repositories: int = 5) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example for each row of docs (doc_id, text, source).

    Base spans are the leftmost non-overlapping matches of each kind.  The method
    hashes every candidate value and counts, over the whole corpus, its distinct
    repositories (documents) and owners (sources): a value of example_owners or more
    owners is a widely copied example, one of a single owner in at most
    live_repositories documents looks live.  Long mixed tokens (capital, small letter
    and digit, at least ten different characters) that overlap no base span are added
    as kind `owned` if they look live.

    One narrow pass over the texts; everything after it works on candidates only.
    Counts pre-aggregate by (value, owner, document), and what is known of a value
    that many documents hold is broadcast to its candidates, so a value that a third
    of all documents hold is dealt out.  Null texts are empty, null sources are one owner,
    repeated rows get equal results, an empty table gives an empty result.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("owner"), body.alias("text"))
    patterns = {**BASE, OWNED[0]: OWNED[1]}
    rows = rows.select(
        "doc_id", "owner", F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"),
        *[_matches(F.col("text"), p, g).alias(kind) for kind, (p, g, _) in patterns.items()],
    )
    rows = materialize(rows, "secrets")
    some = rows.where(" or ".join(f"{k} is not null" for k in KINDS)).dropDuplicates(["doc_id", "owner", "k1", "k2"])
    each = None
    for kind, (_, _, least) in patterns.items():
        part = some.select("doc_id", "owner", "k1", "k2", F.lit(kind).alias("kind"), F.lit(least).alias("least"), F.posexplode(kind).alias("i", "m"))
        each = part if each is None else each.unionByName(part)
    order = Window.partitionBy("doc_id", "owner", "k1", "k2", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("m.gap") + F.col("m.n")).cast("long")).over(order)
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("m.n")).withColumn("v", F.col("m.v")).where(F.length("v") >= F.col("least"))
    signs = F.size(F.array_distinct(F.split("v", "")))
    mixed = F.col("v").rlike("[A-Z]") & F.col("v").rlike("[a-z]") & F.col("v").rlike("[0-9]") & (signs >= 10)
    each = each.where((F.col("kind") != OWNED[0]) | mixed).select("doc_id", "owner", "k1", "k2", "kind", "start", "end", F.xxhash64("v", F.length("v")).alias("v"))
    each = materialize(each, "candidates")
    owners = each.groupBy("v", "owner", "doc_id").agg(F.count("*").alias("c")).groupBy("v", "owner").agg(F.count("*").alias("n"), F.sum("c").alias("c")).groupBy("v")
    owners, sizes = weighed(owners.agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"), F.sum("c").alias("c")), "c", "owners")
    known = hot_join(each, owners, ["v"], "c", known=sizes)
    known = known.withColumn("live", (F.col("owners") == 1) & (F.col("repositories") <= live_repositories)).withColumn("example", F.col("owners") >= example_owners)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    found = known.groupBy("doc_id", "owner", "k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "live", "example"))).alias("all"))
    is_base = lambda s: s["kind"] != OWNED[0]
    base = F.filter("all", is_base)
    found = found.withColumn("base", base)
    added = lambda s: s["live"] & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    spans = F.filter("all", lambda s: is_base(s) | added(s))
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    found = found.withColumn("kept", spans).select(
        F.col("doc_id").alias("d"), F.col("owner").alias("o"), F.col("k1").alias("h1"), F.col("k2").alias("h2"), *[count(k).alias(f"n_{k}") for k in BASE], shown(F.col("base")).alias("base"),
        shown(F.col("kept")).alias("spans"), F.size(F.filter("kept", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("kept", lambda s: s["example"])).cast("long").alias("n_example"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("owner").eqNullSafe(F.col("o")) & (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2"))
    out = rows.select("doc_id", "owner", "k1", "k2").join(found, same, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "doc_id", *[zero(f"n_{k}") for k in BASE], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_live"), zero("n_example"),
    )
