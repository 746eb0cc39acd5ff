"""Evidence records: content identity, idempotent appends, duplicates, families along lineage, citations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import canonical_json, content_id, first_usable
from loomwork.operators.ranking import placed
from loomwork.session import cut_lineage


def with_content_id(df: DataFrame, prefix: str, fields: Sequence[str], name: str = "content_id") -> DataFrame:
    return df.withColumn(name, content_id(prefix, canonical_json(**{f: F.col(f).cast("string") for f in fields})))


def exact_duplicates(df: DataFrame, digest: str, key: str) -> DataFrame:
    """The first key of every digest, whether the row is a duplicate, and how many share it. Rows without a
    digest are nobody's duplicates and have neither."""
    same = df.where(F.col(digest).isNotNull()).groupBy(F.col(digest).alias("__d")).agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("n_same"))
    joined = df.join(same, F.col(digest) == F.col("__d"), "left")
    return joined.select(*df.columns, "first_key", "n_same", F.coalesce(F.col(key) > F.col("first_key"), F.lit(False)).alias("is_duplicate"))


def classify_append(incoming: DataFrame, store: DataFrame, key: str, digest: str, body: str, keys: DataFrame | None = None) -> DataFrame:
    """What an append of each incoming row is, in the order of key, digest and body: ``new``, ``duplicate`` (same
    digest and body), ``collision`` (same digest, another body) or ``rejected_mutation`` (same key, another digest).
    Rows of one batch are held against each other as they are against the store. ``keys`` (key, digest) serves where the
    store's rows were looked up by digest alone."""
    by_digest = store.groupBy(F.col(digest).alias("__d")).agg(F.min(body).alias("__body"))
    by_key = (store if keys is None else keys).groupBy(F.col(key).alias("__k")).agg(F.min(digest).alias("__digest"))
    # the first row of a digest or a key in the batch speaks for it, as if it were stored; groups are folded before they meet
    rows = cut_lineage(incoming.withColumn("__row", F.monotonically_increasing_id()))
    order = F.struct(F.col(key).alias("k"), F.col(digest).alias("g"), F.col(body).alias("b"), "__row")
    first_digest = rows.groupBy(F.col(digest).alias("__bd")).agg(F.min(order).alias("__one"))
    first_key = rows.groupBy(F.col(key).alias("__bk")).agg(F.min(order).alias("__two"))
    joined = rows.join(by_digest, F.col(digest) == F.col("__d"), "left").join(by_key, F.col(key) == F.col("__k"), "left")
    joined = joined.join(first_digest, F.col(digest) == F.col("__bd"), "left").join(first_key, F.col(key) == F.col("__bk"), "left")
    known = F.coalesce(F.col("__body"), F.col("__one.b"))
    first = F.col("__d").isNull() & F.coalesce(F.col("__one.__row") == F.col("__row"), F.lit(False))
    held = F.coalesce(F.col("__digest"), F.col("__two.g"))
    outcome = (
        F.when(~known.eqNullSafe(F.col(body)) & F.col(digest).isNotNull(), "collision")
        .when(~first & F.col(digest).isNotNull(), "duplicate")
        .when(F.col(key).isNotNull() & (held != F.col(digest)), "rejected_mutation")
        .otherwise("new")
    )
    return joined.withColumn("outcome", outcome).select(*incoming.columns, "outcome")


def append_audit(classified: DataFrame, key: str, digest: str, first_id: int = 1) -> DataFrame:
    """(event_id, key, digest, event) for every row that wasn't new, numbered on from ``first_id``."""
    rows = classified.where("outcome <> 'new'").select(F.col(key).alias("item"), F.col(digest).alias("digest"), F.col("outcome").alias("event"))
    numbered = placed(rows.withColumn("__row", F.monotonically_increasing_id()), [F.asc("item"), F.asc("digest"), F.asc("event"), F.asc("__row")], (), "event_id")
    return numbered.select((F.col("event_id") + first_id - 1).alias("event_id"), "item", "digest", "event")


def own_family(df: DataFrame, precedence: Sequence[str], source: str, source_id: str, name: str = "family") -> DataFrame:
    """The first usable of the ids in order of precedence, else source and source id, else null (ineligible)."""
    tagged = [F.when(first_usable(F.col(c)).isNotNull(), F.concat(F.lit(c + ":"), first_usable(F.col(c)))) for c in precedence]
    pair = F.when(first_usable(F.col(source)).isNotNull() & first_usable(F.col(source_id)).isNotNull(), F.concat(F.lit("source:"), first_usable(F.col(source)), F.lit(":"), first_usable(F.col(source_id))))
    return df.withColumn(name, F.coalesce(*tagged, pair))


def lineage_roots(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, root) for every node and each root it descends from. Round k adds what hops of exactly 2**k links
    reach, so that a chain of n takes log n joins of n rows. Roots are nodes without parents; nodes that only
    reach a cycle have no row (``rootless`` lists them)."""
    links = edges.select(F.col(child).alias("node"), F.col(parent).alias("up")).where("node is not null and up is not null").distinct()
    tops = links.select(F.col("up").alias("root")).join(links.select(F.col("node").alias("root")), "root", "left_anti").distinct()
    now, found, seen = cut_lineage(links), cut_lineage(tops.select(F.col("root").alias("node"), "root")), -1
    while (n := found.count()) != seen:
        seen = n
        reached = now.join(found.withColumnRenamed("node", "up"), "up").select("node", "root")
        found = cut_lineage(found.unionByName(reached).distinct())
        hop = now.select(F.col("node").alias("up"), F.col("up").alias("far"))
        now = cut_lineage(now.join(hop, "up").select("node", F.col("far").alias("up")).distinct())
    return found


def rootless(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """Nodes that descend from no root: members of cycles, and what hangs below cycles alone."""
    nodes = edges.select(F.col(child).alias("node")).union(edges.select(F.col(parent))).where("node is not null").distinct()
    return nodes.join(lineage_roots(edges, child, parent).select("node"), "node", "left_anti")


def cycle_members(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, cycle): the nodes of each cycle (its name is its largest node), apart from what hangs below or leads to it.

    Nodes without parents, or without children, among those left are trimmed in turn, as many rounds as the longest chain. In what is
    left every node takes the largest name among those it can be reached from; the nodes of a name that also lead to their
    namesake are one cycle. These go, and the rest is trimmed and named anew.
    """
    links = cut_lineage(edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c is not null and p is not null").distinct())

    def trimmed(nodes: DataFrame) -> DataFrame:
        now, n = nodes, nodes.count()
        while n:
            inside = links.join(now.select(F.col("node").alias("c")), "c", "left_semi").join(now.select(F.col("node").alias("p")), "p", "left_semi")
            now = cut_lineage(inside.select(F.col("c").alias("node")).distinct().join(inside.select(F.col("p").alias("node")).distinct(), "node", "left_semi"))
            if (left := now.count()) == n:
                break
            n = left
        return now

    core = trimmed(links.select(F.col("c").alias("node")).union(links.select("p")).distinct())
    found = core.select("node", F.col("node").alias("cycle")).limit(0)
    while not core.isEmpty():
        inside = links.join(core.select(F.col("node").alias("c")), "c", "left_semi").join(core.select(F.col("node").alias("p")), "p", "left_semi")
        inside = cut_lineage(inside.select("c", "p"))
        named = cut_lineage(core.select("node", F.col("node").alias("name")))
        while True:
            above = inside.join(named, F.col("p") == F.col("node")).groupBy("c").agg(F.max("name").alias("above"))
            new = cut_lineage(named.join(above, F.col("node") == F.col("c"), "left").select("node", F.greatest("name", F.coalesce("above", "name")).alias("name"), (F.col("above") > F.col("name")).alias("moved")))
            still = new.where("moved").isEmpty()
            named = new.select("node", "name")
            if still:
                break
        own = inside.join(named.withColumnsRenamed({"node": "c", "name": "cn"}), "c").join(named.withColumnsRenamed({"node": "p", "name": "pn"}), "p").where("cn = pn").select("c", "p")
        own = cut_lineage(own)
        reached, n = cut_lineage(named.where("node = name")), -1
        while (now := reached.count()) != n:
            n = now
            more = own.join(reached.withColumnRenamed("node", "c"), "c").select(F.col("p").alias("node"), "name")
            reached = cut_lineage(reached.unionByName(more).distinct())
        # a single node is a cycle only with a link to itself
        sizes = reached.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        loops = links.where("c = p").select(F.col("c").alias("name")).withColumn("loop", F.lit(True))
        real = reached.join(sizes.join(loops, "name", "left").where("n > 1 or loop"), "name", "left_semi").select("node", F.col("name").alias("cycle"))
        found = cut_lineage(found.unionByName(real))
        core = trimmed(cut_lineage(core.join(reached.select("node"), "node", "left_anti")))
    return found


def inherited_family(items: DataFrame, edges: DataFrame, key: str, family: str) -> DataFrame:
    """A root's own family; a descendant takes its roots' single family or a sorted composite of several."""
    roots = lineage_roots(edges)
    derived = edges.select(F.col("child").alias("__n")).distinct()
    above = roots.join(items.select(F.col(key).alias("root"), F.col(family).alias("__f")), "root").groupBy("node").agg(F.array_sort(F.collect_set("__f")).alias("__fs"), F.count_if(F.col("__f").isNull()).alias("__none"))
    joined = items.join(derived, F.col(key) == F.col("__n"), "left").join(above, F.col(key) == F.col("node"), "left")
    several = F.concat(F.lit("composite:"), F.concat_ws("+", "__fs"))
    taken = F.when(F.col("__none") > 0, F.lit(None)).when(F.size("__fs") == 1, F.col("__fs")[0]).when(F.size("__fs") > 1, several)
    return joined.select(*items.columns, F.when(F.col("__n").isNull(), F.col(family)).otherwise(taken).alias("assigned_family"))


def dangling(edges: DataFrame, items: DataFrame, key: str) -> DataFrame:
    return edges.join(items.select(F.col(key).alias("parent")), "parent", "left_anti")


def verify_citations(claims: DataFrame, documents: DataFrame, doc: str, quote: str, text: str) -> DataFrame:
    """Why a quote isn't verified, or ``verified``: no quote, no document, blank document, not literal."""
    have = documents.select(F.col(doc).alias("__d"), F.col(text).alias("__t"))
    joined = claims.join(have, F.col(doc) == F.col("__d"), "left")
    empty = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    reason = F.when(empty(quote), "missing_quote").when(F.col("__d").isNull(), "missing_document").when(empty("__t"), "empty_document").when(~F.contains("__t", F.col(quote)), "quote_not_literal").otherwise("verified")
    return joined.withColumn("verification", reason).drop("__d", "__t")


def card_metrics(df: DataFrame, by: Sequence[str], distinct: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.count_distinct(F.when(F.trim(c) != "", F.col(c))).alias(f"n_{c}") for c in distinct))


def contradictions(df: DataFrame, by: Sequence[str], value: str, key: str | None = None, conflicting: Column | None = None) -> DataFrame:
    """Groups with more than one distinct value, or a row marked ``conflicting``; with ``key`` a row for each of their members.

    Nulls of the group's columns are equal. Members come as rows, never as an array.
    """
    marked = F.count_if(conflicting if conflicting is not None else F.lit(False))
    groups = df.groupBy(*by).agg(F.count_distinct(value).alias("n_values"), F.count(F.lit(1)).alias("n"), marked.alias("n_marked")).where("n_values > 1 or n_marked > 0")
    if key is None:
        return groups.drop("n_marked")
    other = groups.select(*(F.col(c).alias(f"__{c}") for c in by))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return df.join(other, same).select(*by, key)


def state_coverage(df: DataFrame, by: DataFrame, states: Sequence[str], state: str) -> DataFrame:
    """Counts of every state for every row of ``by``, zeros included."""
    keys = by.columns
    counted = df.groupBy(*keys).agg(F.map_from_entries(F.array(*(F.struct(F.lit(s), F.count_if(F.col(state) == s)) for s in states))).alias("__m"))
    wide = by.join(counted, keys, "left")
    return wide.select(*keys, F.explode(F.array(*(F.struct(F.lit(s).alias(state), F.coalesce(F.col("__m")[s], F.lit(0)).alias("n")) for s in states))).alias("x")).select(*keys, f"x.{state}", "x.n")


def conflicting_groups(df: DataFrame, keys: Sequence[str], stance: str, opposites: tuple[str, str] = ("supports", "contradicts")) -> DataFrame:
    """One row per key group with both stances, and how many rows take each. Pairs aren't expanded."""
    count = lambda s: F.count_if(F.col(stance) == s)
    return df.groupBy(*keys).agg(count(opposites[0]).alias("n_for"), count(opposites[1]).alias("n_against")).where("n_for > 0 and n_against > 0")


def conflicting_members(df: DataFrame, keys: Sequence[str], stance: str, key: str, opposites: tuple[str, str] = ("supports", "contradicts")) -> DataFrame:
    """The rows of such groups that take one of the two stances."""
    groups = conflicting_groups(df, keys, stance, opposites).select(*keys)
    return df.where(F.col(stance).isin(*opposites)).join(groups, list(keys), "left_semi").select(*keys, stance, key)
