"""Joins of discovery and bookkeeping. All are equi joins, or have an equi key from which the rest follows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, in an explicit order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def pages_of_entities(entities: DataFrame, pages: DataFrame, entity: str, page: str, keep: Column, n: int = 25) -> DataFrame:
    """Entities with their first n pages by id; the test that drops redirects comes after the limit."""
    return first_per_key(entities.join(pages, entity), [entity], [F.asc(page)], n).filter(keep)


def neighbours(anchors: DataFrame, edges: DataFrame, anchor: str, subject: str, relation: str, target: str, inward: list, outward: list) -> DataFrame:
    """(anchor, relation, direction, other): edges into anchors by some relations, out of them by others."""
    a = anchors.select(F.col(anchor).alias("anchor")).distinct()
    into = edges.filter(F.col(relation).isin(inward)).join(a, F.col(target) == F.col("anchor")).select("anchor", F.col(relation).alias("relation"), F.lit("in").alias("direction"), F.col(subject).alias("other"))
    out = edges.filter(F.col(relation).isin(outward)).join(a, F.col(subject) == F.col("anchor")).select("anchor", F.col(relation).alias("relation"), F.lit("out").alias("direction"), F.col(target).alias("other"))
    return into.unionByName(out)


def prefix_join(aliases: DataFrame, titles: DataFrame, alias: str, title: str, *, key_chars: int = 3, most_per_alias: int | None = None, most: int | None = None) -> DataFrame:
    """Titles from each alias to the alias with U+FFFF.

    The first ``key_chars`` characters are an equi key; shorter aliases meet titles on as many
    characters as they have. So no plan compares all pairs.
    """
    sized = aliases.withColumn("_n", F.least(F.lit(key_chars), F.length(alias)))
    parts = []
    for n in range(1, key_chars + 1):
        left = sized.filter(F.col("_n") == n).withColumn("_k", F.substring(alias, 1, n)).drop("_n")
        right = titles.withColumn("_k", F.substring(title, 1, n))
        parts.append(left.join(right, "_k").filter((F.col(title) >= F.col(alias)) & (F.col(title) < F.concat(alias, F.lit("￿")))).drop("_k"))
    found = reduce(DataFrame.unionByName, parts)
    if most_per_alias is not None:
        found = first_per_key(found, [alias], [F.asc(title)], most_per_alias)
    return found if most is None else found.orderBy(alias, title).limit(most)


def interval_join(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, *, keys: list[str] | None = None) -> DataFrame:
    """Points in closed intervals, by an equi join on cells.

    An interval is dealt to cells of the least power of two that isn't shorter than it: two cells at most,
    however long it is. A point is dealt to one cell of each length that some interval has (64 at most).
    """
    keys = keys or []
    level = F.ceil(F.log2(F.greatest(F.lit(1), F.col(end) - F.col(start) + 1).cast("double"))).cast("int")
    sized = intervals.filter(F.col(start) <= F.col(end)).withColumn("_level", level)
    levels = sorted(r[0] for r in sized.select("_level").distinct().collect())
    width = F.pow(F.lit(2.0), F.col("_level"))
    cells = sized.withColumn("_cell", F.explode(F.array_distinct(F.array(F.floor(F.col(start) / width), F.floor(F.col(end) / width)))))
    dealt = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_cell", F.floor(F.col(point) / width))
    return dealt.join(cells, [*keys, "_level", "_cell"]).filter(F.col(point).between(F.col(start), F.col(end))).drop("_cell", "_level")


def unified_links(legacy: DataFrame, by_id: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, category, kind) of both layouts; an id that is no category has a null title."""
    named = by_id.join(targets, "target_id", "left").select("source", F.when(F.col("ns") == 14, F.col("title")).alias("category"), "kind")
    return legacy.select("source", "category", "kind").unionByName(named)


def resolved_links(links: DataFrame, targets: DataFrame, pages: DataFrame, *, salts: int = 32, block: int = 1000) -> DataFrame:
    """(source, page): links to pages by (namespace, title), each once, none to itself.

    What a source links to and the names of pages are made distinct before they meet, so it meets a page of
    one name once, and those rows aren't shuffled; only pages of several names are made distinct afterwards.
    What sources link to is dealt once, by name and ``salts`` shares of the sources: there it is made distinct, sorted
    and merged with blocks of about ``block`` pages of the name. So sources of a name follow each other, and a file of
    the result repeats their pages.
    """
    salt = F.pmod(F.xxhash64("source"), F.lit(salts)).cast("int").alias("_salt")
    wanted = links.join(targets, "target_id").select("source", "ns", "title", salt).repartition("ns", "title", "_salt").distinct()
    names = pages.select("ns", "title", "page").filter("ns is not null and title is not null").distinct()
    named = names.join(names.groupBy("page").agg(F.count(F.lit(1)).alias("_names")), "page")

    def meet(own: str) -> DataFrame:
        some = named.filter(own)
        blocks = F.ceil(F.count(F.lit(1)) / block).alias("_blocks")
        dealt = some.join(some.groupBy("ns", "title").agg(blocks), ["ns", "title"]).withColumn("_block", F.pmod(F.xxhash64("page"), F.col("_blocks")))
        lists = dealt.groupBy("ns", "title", "_block").agg(F.collect_list("page").alias("_pages"))
        shares = lists.withColumn("_salt", F.explode(F.array(*map(F.lit, range(salts)))))
        found = wanted.join(shares.hint("merge"), ["ns", "title", "_salt"]).select("source", F.explode("_pages").alias("page"))
        return found.filter(F.col("source") != F.col("page"))

    return meet("_names = 1").unionByName(meet("_names > 1").distinct())


def cardinality_classes(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(left, n_right, n_left_of_right, class): NO, AMBIGUOUS or SINGLE match in both directions."""
    known = pairs.filter(F.col(left).isNotNull()).select(left, right).distinct()
    back = known.filter(F.col(right).isNotNull()).groupBy(right).agg(F.count(F.lit(1)).alias("_back"))
    per = known.join(back, right, "left").groupBy(left).agg(F.count(right).alias("n_right"), F.coalesce(F.max("_back"), F.lit(0)).alias("n_left_of_right"))
    kind = F.when(F.col("n_right") == 0, "NO").when((F.col("n_right") > 1) | (F.col("n_left_of_right") > 1), "AMBIGUOUS").otherwise("SINGLE")
    return per.withColumn("class", kind)


def paths(edges: DataFrame, a: str, b: str, sources: DataFrame | None = None) -> DataFrame:
    """(start, end, hops): one or two edges without coming back, the shortest for each pair; only from ``sources``."""
    one = edges.select(F.col(a).alias("start"), F.col(b).alias("mid")).filter("start <> mid").distinct()
    if sources is not None:
        one_from = one.join(sources.select(F.col(sources.columns[0]).alias("start")).distinct(), "start", "left_semi")
    else:
        one_from = one
    two = one_from.join(one.select(F.col("start").alias("mid"), F.col("mid").alias("end")), "mid").filter("end <> start").select("start", "end", F.lit(2).alias("hops"))
    return one_from.select("start", F.col("mid").alias("end"), F.lit(1).alias("hops")).unionByName(two).groupBy("start", "end").agg(F.min("hops").alias("hops"))


def identity_check(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of both sides with the names of the columns that differ (nulls are equal)."""
    other = right.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    differ = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), c) for c in columns]))
    return left.join(other, key).withColumn("mismatch", differ).drop(*[f"_{c}" for c in columns])


def row_actions(incoming: DataFrame, stored: DataFrame, key: str, columns: list[str], protected: list[str]) -> DataFrame:
    """(key, action, changed, protected_changed): NEW, UPDATE, IGNORE (nothing changed) or MISSING."""
    old = stored.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = incoming.join(old, F.col(key) == F.col("_key"), "full")
    names = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), c) for c in columns]))
    there = F.col(key).isNotNull() & F.col("_key").isNotNull()
    changed = F.when(there, names).otherwise(F.array().cast("array<string>"))
    action = F.when(F.col("_key").isNull(), "NEW").when(F.col(key).isNull(), "MISSING").when(F.size(changed) > 0, "UPDATE").otherwise("IGNORE")
    guarded = F.filter(changed, lambda c: c.isin(protected))
    return both.select(F.coalesce(key, "_key").alias(key), action.alias("action"), changed.alias("changed"), guarded.alias("protected_changed"))


def checked_zip(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with the side that each key is missing on (null: on none)."""
    a, b = left.withColumn("_a", F.lit(1)), right.withColumn("_b", F.lit(1))
    return a.join(b, keys, "full").withColumn("missing", F.when(F.col("_a").isNull(), "left").when(F.col("_b").isNull(), "right")).drop("_a", "_b")


def by_alias(df: DataFrame, roles: dict[str, list[str]]) -> DataFrame:
    """Columns renamed to their roles by the first of their alternative names that is there."""
    found = {}
    for role, names in roles.items():
        match = next((c for n in names for c in df.columns if c.lower() == n.lower()), None)
        if match is None:
            raise ValueError(f"no column for {role}: {names}")
        found[role] = match
    return df.select(*[F.col(c).alias(r) for r, c in found.items()])


def usable_flags(dossier: DataFrame, extracted: DataFrame, key: str, columns: list[str], redirect: str) -> DataFrame:
    """Dossier rows with ``usable``: extracted, all columns equal, no redirect."""
    other = extracted.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.col(redirect).alias("_redirect"), F.lit(True).alias("_there"))
    equal = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns], F.coalesce("_there", F.lit(False)))
    return dossier.join(other, key, "left").withColumn("usable", equal & (F.coalesce("_redirect", F.lit(0)) == 0)).drop("_there", "_redirect", *[f"_{c}" for c in columns])


def looked_up(df: DataFrame, steps: list[tuple[DataFrame, str, str, list[str], str]]) -> DataFrame:
    """``df`` with columns of other tables, one lookup after another.

    A step is (table, key in what is there so far, key in the table, columns to take, ``inner`` or ``left``).
    Tables are cut to their key and those columns before the join, and the table's key doesn't stay.
    """
    out = df
    for i, (table, own, key, columns, how) in enumerate(steps):
        other = table.select(F.col(key).alias(f"_key{i}"), *columns)
        out = out.join(other, F.col(own) == F.col(f"_key{i}"), how).drop(f"_key{i}")
    return out


def semi_chain(df: DataFrame, own: str, steps: list[tuple[DataFrame, str, str | None]]) -> DataFrame:
    """Rows that a chain of semi joins leaves; steps are (table, its key towards ``df``, its key to the next step)."""
    wanted = None
    for table, key, onward in reversed(steps):
        rows = table if wanted is None else table.join(wanted.withColumnRenamed("_k", "_w"), F.col(onward) == F.col("_w"), "left_semi")
        wanted = rows.select(F.col(key).alias("_k"))
    return df.join(wanted, F.col(own) == F.col("_k"), "left_semi")


def fan_out(df: DataFrame, children: DataFrame, key: str, child: str, status: str, counted: dict[str, str]) -> DataFrame:
    """(key, children, rows, and how many rows have each status): what hangs on each key, over all children."""
    rows = df.select(key).join(children, key)
    tallies = [F.sum(F.when(F.col(status) == value, 1).otherwise(0)).alias(name) for name, value in counted.items()]
    return rows.groupBy(key).agg(F.countDistinct(child).alias("children"), F.count(F.lit(1)).alias("rows"), *tallies)


def keyset_batch(df: DataFrame, key: str, after: object, n: int, item: str, name: str) -> DataFrame:
    """The next n keys after a cursor, each with its items as a sorted array."""
    keys = df.filter(F.col(key) > F.lit(after)).select(key).distinct().orderBy(key).limit(n)
    return df.join(keys, key, "left_semi").groupBy(key).agg(F.sort_array(F.collect_list(item)).alias(name))


def described(df: DataFrame, entities: DataFrame, number: str, text_id: str, entity_text_id: str, columns: list[str]) -> DataFrame:
    """Rows with columns of the entity of their number, and ``error`` where the entity's text id is another."""
    other = entities.select(F.col(number).alias("_number"), F.col(entity_text_id).alias("_text_id"), *columns)
    out = df.join(other, F.col(number) == F.col("_number"), "left")
    error = F.when(F.col("_number").isNull(), "unknown entity").when(~F.col(text_id).eqNullSafe(F.col("_text_id")), "another id")
    return out.withColumns({"error": error, **{c: F.when(error.isNull(), F.col(c)) for c in columns}}).drop("_number", "_text_id")
