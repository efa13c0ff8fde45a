"""Search over titles, expansion over categories and links, and bounded crawls."""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.operators.joins import first_per_key


def token_index(df: DataFrame, item: str, text: str, stop: tuple[str, ...] = ()) -> DataFrame:
    """(item, token, position): an inverted index with positions."""
    words = T.tokens(F.translate(text, "_", " "), least=2, stop=stop, distinct=False)
    return df.select(item, F.posexplode(words).alias("position", "token"))


def _found(index: DataFrame, item: str, phrases: dict[str, list[str]]) -> DataFrame:
    """(item, terms): the names of the phrases that each item has.

    Only the phrases' own words leave the index, and items are grouped once, whatever the number of phrases.
    """
    words = sorted({w for ws in phrases.values() for w in ws[:5]})
    own = index.filter(F.col("token").isin(words)).groupBy(item, "token").agg(F.sort_array(F.collect_set("position")).alias("at"))
    places = own.groupBy(item).agg(F.map_from_entries(F.collect_list(F.struct("token", "at"))).alias("m"))

    def test(ws: list[str]) -> Column:
        every = reduce(lambda a, b: a & b, [F.map_contains_key("m", w) for w in sorted(set(ws[:4]))])
        follows = lambda p: reduce(lambda a, b: a & b, [F.array_contains(F.col("m")[w], p + i) for i, w in enumerate(ws[:5])])
        phrase = F.exists(F.coalesce(F.col("m")[ws[0]], F.array().cast("array<int>")), lambda p: F.coalesce(follows(p), F.lit(False)))
        return every | phrase

    hits = F.array_compact(F.array(*[F.when(test(ws), F.lit(name)) for name, ws in phrases.items() if ws]))
    return places.select(item, hits.alias("terms")).filter(F.size("terms") > 0)


def title_search(index: DataFrame, item: str, words: list[str]) -> DataFrame:
    """Items with the first five words as a phrase, or the first four all there."""
    return _found(index, item, {"": words}).select(item) if words else index.select(item).limit(0)


def category_probe(index: DataFrame, item: str, phrases: dict[str, list[str]], explicit: DataFrame | None = None) -> DataFrame:
    """(item, terms): items of any phrase, with the phrases that found them; explicit ones come along."""
    found = _found(index, item, phrases).select(item, F.explode("terms").alias("term"))
    if explicit is not None:
        found = found.unionByName(explicit.select(item, F.lit("EXPLICIT").alias("term")))
    return found.groupBy(item).agg(F.sort_array(F.collect_set("term")).alias("terms"))


def breadth_first(roots: DataFrame, edges: DataFrame, node: str, parent: str, child: str, *, depth: int, most_children: int | None = None, save=None) -> DataFrame:
    """(root, node, depth): what is reached from each root within ``depth`` steps, first at its least depth.

    Nodes with more than ``most_children`` children aren't expanded. ``save`` writes a round's
    table to shared storage and rereads it, which cuts the lineage of deep expansions.
    """
    e = edges.select(F.col(parent).alias("_from"), F.col(child).alias("_to")).distinct()
    if most_children is not None:
        small = e.groupBy("_from").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= most_children).select("_from")
        e = e.join(small, "_from", "left_semi")
    seen = roots.select(F.col(node).alias("root"), F.col(node).alias("node"), F.lit(0).alias("depth")).distinct()
    front = seen
    for d in range(1, depth + 1):
        new = front.join(e, F.col("node") == F.col("_from")).select("root", F.col("_to").alias("node"), F.lit(d).alias("depth")).distinct()
        front = new.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        if save is not None:
            front = save(front)
        seen = seen.unionByName(front)
    return seen


def seed_expansion(seeds: DataFrame, links: DataFrame, categories: DataFrame, seed: str, most_members: int = 5_000) -> DataFrame:
    """(seed, page, kind): pages linked from a seed, and pages that share a category, without known pairs.

    Categories of more than ``most_members`` pages tell nothing and are left out whole, before any join.
    """
    small = categories.select("category", "page").distinct().groupBy("category").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= most_members).select("category")
    categories = categories.join(small, "category", "left_semi")
    s = seeds.select(F.col(seed).alias("seed")).distinct()
    linked = s.join(links.select(F.col("source").alias("seed"), F.col("page")), "seed").select("seed", "page", F.lit("WIKILINK").alias("kind"))
    own = s.join(categories.select(F.col("page").alias("seed"), "category"), "seed")
    shared = own.join(categories, "category").select("seed", "page", F.lit("SHARED_CATEGORY").alias("kind"))
    return linked.unionByName(shared).filter("seed <> page").distinct()


def weak_first(concepts: DataFrame, found: DataFrame, concept: str, order: list[Column], *, enough: int, per_concept: int) -> DataFrame:
    """Candidates of concepts that have fewer than enough, at most some for each."""
    have = found.groupBy(concept).agg(F.count(F.lit(1)).alias("_n"))
    weak = concepts.select(concept).distinct().join(have, concept, "left").filter(F.coalesce("_n", F.lit(0)) < enough).select(concept)
    return first_per_key(found.join(weak, concept, "left_semi"), [concept], order, per_concept)


def tree_parents(relations: DataFrame, child: str, parent: str, local: DataFrame, key: str) -> DataFrame:
    """(child, parent): the first broader concept among local ones; null for roots."""
    ids = local.select(F.col(key).alias("_p")).distinct()
    first = relations.join(ids, F.col(parent) == F.col("_p"), "left_semi").filter(F.col(child) != F.col(parent)).groupBy(child).agg(F.min(parent).alias("parent"))
    return local.select(F.col(key).alias(child)).distinct().join(first, child, "left")


def best_first(group: str, edges: DataFrame, seeds: DataFrame, *, pages: int, links: int, depth: int) -> DataFrame:
    """(group, node, depth, score, expanded): a best-first crawl for each group of seeds.

    Edges are (group, source, target, gain), seeds (group, node, score). Every node taken from the
    heap uses up the page budget, also at the greatest depth. Only the first ``links`` targets of a source
    and the best ``pages`` seeds of a group can count: the others go before the groups are formed.
    """
    edges = first_per_key(edges.select(group, "source", "target", "gain"), [group, "source"], [F.asc("target"), F.desc("gain")], links)
    seeds = first_per_key(seeds.select(group, "node", "score"), [group], [F.desc("score"), F.asc("node")], pages)

    def run(key: tuple, e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out = {a: list(zip(g["target"], g["gain"], strict=True))[:links] for a, g in e.sort_values(["source", "target"]).groupby("source")}
        score = dict(zip(s["node"], s["score"], strict=True))
        level = dict.fromkeys(score, 0)
        heap = [(-v, k) for k, v in score.items()]
        heapq.heapify(heap)
        done: set = set()
        while heap and len(done) < pages:
            _, a = heapq.heappop(heap)
            if a in done:
                continue
            done.add(a)
            if level[a] >= depth:
                continue
            for b, gain in out.get(a, ()):
                new = round(70 - 22 * (level[a] + 1) + gain, 3)
                if b not in score or (new > score[b] and level[b]):
                    score[b] = new
                    level[b] = min(level.get(b, level[a] + 1), level[a] + 1)
                    heapq.heappush(heap, (-new, b))
        nodes = list(score)
        return pd.DataFrame({group: key[0], "node": nodes, "depth": [level[n] for n in nodes], "score": [float(score[n]) for n in nodes], "expanded": [n in done for n in nodes]})

    kind = edges.schema[group].dataType.simpleString()
    node = edges.schema["target"].dataType.simpleString()
    return edges.groupBy(group).cogroup(seeds.groupBy(group)).applyInPandas(run, f"{group} {kind}, node {node}, depth int, score double, expanded boolean")
