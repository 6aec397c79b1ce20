"""Embedding near-duplicates by range search on a robust-pruned flat graph.

1. Equal vectors become one node. Nodes are dealt to overlapping cluster shards: a shard above `SHARD` nodes is split among centroids
   learned on a sample of its own, level by level; a node goes to its nearest centroid, and at each level one further copy of it
   to the second nearest, so shards are bounded and copies grow with the number of levels only.
2. Every shard builds adjacency lists (nearest candidates, robust pruning, reverse edges); a node's lists are united over its shards. A
   shard then holds its nodes, and the out-of-shard neighbours that the united lists add.
3. Every node searches its home shard: a greedy search from the shard's medoids, that goes on from each node within range until none is
   left. Where it meets nodes in range whose home is another shard, it visits that shard next, starting from them, and a node that
   was found by a visitor visits the visitor's home in turn; so a group of near copies may be larger than any shard.
4. A link counts at the home of the node found, by its cosine in double precision, so none is counted twice and none below the threshold.
   Tasks return counts, visits to be made and spanning forests: one row per node and shard, never the pairs of a group.
5. The links of a hash sample of nodes are counted by brute force over all nodes. While the share found is under `RECALL`, all is done again
   with other shards and twice the beam, at most `ROUNDS` times; then the shortfall is logged.

Vectors that are null, zero or hold a null or non-finite component link with nothing; neither do vectors of different lengths with
each other. A row with a null id takes no part and has no component. Repeated rows are vectors each: equal rows link as copies. An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermaline.llm.common import hash_sample, staged
from thermaline.llm.components import components
from thermaline.llm.hashing_index import _valid
from thermaline.llm.simhash import forest

COSINE = 0.95
#: Nodes of a shard, at most.
SHARD = 4_096
#: Centroids of one split, and rows on which they are learned per centroid.
FAN, SAMPLE = 256, 16
#: Nodes that one task assigns to centroids, and queries that one task searches.
ROWS = 16_384
#: Candidates and out-degree of a node, factor of the robust pruning, width of the greedy search, medoids of a shard.
CANDIDATES, DEGREE, ALPHA, BEAM, MEDOIDS = 48, 16, 1.2, 8, 8
#: Queries of the audit, the share of links to be found, and the graphs built for it at most.
AUDIT, RECALL, ROUNDS = 1_024, 0.99, 3


def matrix(packed: pd.Series) -> np.ndarray:
    """The rows that a binary column holds as doubles."""
    return np.frombuffer(b"".join(packed)).reshape(len(packed), -1)


def points(clean: DataFrame) -> DataFrame:
    """node, d, x (the unit vector, packed), k1, k2, first (smallest id) and n (rows) of each distinct vector of `clean`."""
    groups = clean.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.first("x").alias("x"))

    def run(batches):
        for batch in batches:
            packed = []
            for v in batch["x"]:
                v = np.asarray(v, dtype=np.float64)
                v = v / np.abs(v).max()
                packed.append((v / np.sqrt((v * v).sum())).tobytes())
            yield batch.assign(d=batch["x"].map(len), x=packed)

    out = groups.mapInPandas(run, "k1 long, k2 long, first long, n long, x binary, d int")
    return staged(out.withColumn("node", F.monotonically_increasing_id()))


def learn(x: np.ndarray, fan: int, seed: int, rounds: int = 4) -> np.ndarray:
    """Centroids of x: some rounds of k-means from distinct rows."""
    known = np.unique(x, axis=0)
    c = known[np.random.default_rng(seed).permutation(len(known))[:fan]].copy()
    for _ in range(rounds):
        own = (known @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, known)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def shards(nodes: DataFrame, size: int = SHARD, seed: int = 0) -> DataFrame:
    """shard, node, home (one row per node), x: the overlapping shards, none above `size`."""
    rows = nodes.select(F.col("d").cast("string").alias("shard"), "node", F.lit(True).alias("home"), "x")
    done, level = None, 0
    while True:
        sizes = staged(rows.groupBy("shard").agg(F.count("*").alias("rows")))
        full = sizes.where(F.col("rows") > size)
        fits = rows.join(full, "shard", "left_anti")
        done = fits if done is None else done.union(fits)
        if full.isEmpty():
            return done
        fan = F.greatest(F.lit(8), F.least(F.lit(FAN), F.ceil(4 * F.col("rows") / size))).cast("int")
        salts = F.ceil(F.col("rows") / ROWS).cast("int")
        big = rows.join(full.select("shard", "rows", fan.alias("fan"), salts.alias("salts")), "shard")
        drawn = F.pmod(F.xxhash64("node", F.lit(seed), F.lit(level)), F.lit(1 << 30)) < (1 << 30) * (SAMPLE * F.col("fan") / F.col("rows"))

        draw = seed + level

        def fit(part: pd.DataFrame) -> pd.DataFrame:
            c = learn(matrix(part.sort_values("node")["x"]), int(part["fan"].iloc[0]), draw)
            return pd.DataFrame({"shard": part["shard"].iloc[:1], "salts": part["salts"].iloc[:1], "centroids": [c.tobytes()]})

        def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            x, c = matrix(left["x"]), np.frombuffer(right["centroids"].iloc[0])
            c = c.reshape(-1, x.shape[1])
            near = (x @ c.T - (c * c).sum(axis=1) / 2)
            one = near.argmax(axis=1)
            near[np.arange(len(x)), one] = -np.inf
            two, home = near.argmax(axis=1), left["home"].to_numpy(bool) & (len(c) > 1)
            first, more = left[["shard", "node", "home", "x"]].copy(), left.loc[home, ["shard", "node", "home", "x"]].copy()
            first["shard"] += "." + pd.Series(one, index=first.index).astype(str)
            more["shard"] += "." + pd.Series(two[home], index=more.index).astype(str)
            more["home"] = False
            return pd.concat([first, more])

        fitted = big.where(drawn).groupBy("shard").applyInPandas(fit, "shard string, salts int, centroids binary")
        fitted = staged(fitted).select("shard", "centroids", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)).alias("salt"))
        dealt = big.withColumn("salt", F.pmod(F.xxhash64("node"), "salts"))
        split = dealt.groupBy("shard", "salt").cogroup(fitted.groupBy("shard", "salt")).applyInPandas(assign, "shard string, node long, home boolean, x binary")
        rows, level = staged(split), level + 1


def robust_prune(x: np.ndarray, alpha: float = ALPHA, degree: int = DEGREE, candidates: int = CANDIDATES) -> list[np.ndarray]:
    """Neighbours of each row: the nearest candidate stays and drops those that are `alpha` times nearer to it than to the row; so on."""
    n, some = len(x), min(candidates, len(x) - 1)
    out = []
    for lo in range(0, n, 256):
        part = x[lo:lo + 256]
        score = part @ x.T
        score[np.arange(len(part)), lo + np.arange(len(part))] = -np.inf
        near = np.argpartition(-score, some - 1, axis=1)[:, :some] if some else np.zeros((len(part), 0), dtype=int)
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, axis=1), axis=1, kind="stable"), axis=1)
        own = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(score, near, axis=1), 0))
        v = x[near]
        between = np.sqrt(np.maximum(2 - 2 * (v @ v.transpose(0, 2, 1)), 0))
        alive, kept = np.ones(near.shape, dtype=bool), np.zeros(near.shape, dtype=bool)
        for j in range(some):
            take = alive[:, j] & (kept.sum(axis=1) < degree)
            kept[:, j] = take
            alive &= ~(take[:, None] & (alpha * between[:, j] <= own))
        out += [row[k] for row, k in zip(near, kept, strict=True)]
    return out


class Graph:
    """Vectors and adjacency of one shard, and the range search on them."""

    def __init__(self, x: np.ndarray, source: np.ndarray, target: np.ndarray, medoids: int = MEDOIDS):
        """source, target: edges as row numbers, used both ways."""
        self.x = x
        edges = np.unique(np.concatenate([source * len(x) + target, target * len(x) + source]))
        self.target = edges % max(1, len(x))
        self.start = np.searchsorted(edges, np.arange(len(x) + 1) * len(x))
        self.medoids = np.unique((learn(x, medoids, 0) @ x.T).argmax(axis=1))

    def _near(self, row: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, neighbour) of all neighbours of each node."""
        n = self.start[node + 1] - self.start[node]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(row, n), self.target[np.repeat(self.start[node], n) + offset]

    def search(self, q: np.ndarray, start: np.ndarray, cosine: float, beam: int = BEAM) -> np.ndarray:
        """found[i, j]: row j was found with a cosine of at least `cosine` to query i. start: a row per query, or -1 for the medoids."""
        size = len(self.x)
        found, seen = np.zeros((len(q), size), dtype=bool), np.zeros(len(q) * size, dtype=bool)
        top = np.full((len(q), beam), -np.inf)  # the best of each query, and where they are; -1 once expanded
        where = np.full((len(q), beam), -1)
        free = np.flatnonzero(start < 0)
        pair = np.concatenate([np.flatnonzero(start >= 0) * size + start[start >= 0], (free[:, None] * size + self.medoids[None, :]).ravel()])
        while len(pair):
            seen[pair] = True
            row, node = np.divmod(np.sort(pair), size)
            score = np.concatenate([np.einsum("ij,ij->i", q[row[at:at + 65536]], self.x[node[at:at + 65536]]) for at in range(0, len(row), 65536)])
            hit = score >= cosine
            found[row[hit], node[hit]] = True
            order = np.lexsort((-score, row))
            nth = np.arange(len(row)) - np.searchsorted(row, row)  # rows are sorted, so this holds in either order
            best = order[nth < beam]
            new, at = np.full((len(q), beam), -np.inf), np.full((len(q), beam), -1)
            new[row[best], nth[nth < beam]], at[row[best], nth[nth < beam]] = score[best], node[best]
            new, at = np.concatenate([top, new], axis=1), np.concatenate([where, at], axis=1)
            keep = np.argsort(-new, axis=1, kind="stable")[:, :beam]
            top, where = np.take_along_axis(new, keep, axis=1), np.take_along_axis(at, keep, axis=1)
            r, slot = np.nonzero(where >= 0)
            ask = np.unique(np.concatenate([r * size + where[r, slot], row[hit] * size + node[hit]]))  # in range: always expanded
            where[:] = -1
            row, node = self._near(*np.divmod(ask, size))
            pair = row * size + node
            pair = np.unique(pair[~seen[pair]])
        return found


def graph(copies: DataFrame, nodes: DataFrame) -> DataFrame:
    """shard, node, home (the node's home shard), n, x, near: what each shard holds; near is null for neighbours from outside."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        ids = part["node"].to_numpy()
        near = robust_prune(matrix(part["x"]))
        a, b = np.repeat(np.arange(len(ids)), [len(v) for v in near]), np.concatenate([*near, np.zeros(0, dtype=int)]).astype(int)
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.argsort(a, kind="stable")
        return pd.DataFrame({"node": ids, "near": np.split(ids[b[order]], np.searchsorted(a[order], np.arange(1, len(ids))))})

    lists = copies.groupBy("shard").applyInPandas(build, "node long, near array<long>")
    united = staged(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    homes = copies.where("home").select("node", F.col("shard").alias("at"))
    known = staged(nodes.select("node", "n", "x").join(homes, "node").join(united, "node"))
    members = copies.select("shard", "node").join(known, "node")
    inside = members.select("shard", "node", F.col("at").alias("home"), "n", "x", "near")
    outside = known.select(F.col("at").alias("shard"), F.explode("near").alias("node")).distinct().join(copies.select("shard", "node"), ["shard", "node"], "left_anti")
    outside = outside.join(known, "node").select("shard", "node", F.col("at").alias("home"), "n", "x", F.lit(None).cast("array<long>").alias("near"))
    return staged(inside.union(outside))


_FOUND = "kind string, node long, links long, shard string, at long"


def visit(held: DataFrame, asks: DataFrame, cosine: float, beam: int) -> DataFrame:
    """Rows of kind `links` (node, links), `visit` (node, shard, at: where to start there) and `edge` (node, at).

    asks: shard, node, x, home, at of the queries, whose number per shard is not bounded: they go to tasks of at most about `ROWS`.
    """
    chunks = asks.groupBy("shard").agg(F.ceil(F.count("*") / ROWS).cast("long").alias("chunks"))
    left = held.join(chunks, "shard").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    right = asks.join(chunks, "shard").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks"))

    def run(key: tuple, part: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        part, queries = part.sort_values("node", kind="stable"), queries.sort_values("node", kind="stable")
        nodes, home, weight = part["node"].to_numpy(), part["home"].to_numpy(), part["n"].to_numpy()
        here = home == key[0]
        lists = [np.asarray(v if v is not None else (), dtype=np.int64) for v in part["near"]]
        source, target = np.repeat(np.arange(len(nodes)), [len(v) for v in lists]), np.concatenate([*lists, np.zeros(0, np.int64)])
        row = np.minimum(np.searchsorted(nodes, target), len(nodes) - 1)
        known = nodes[row] == target
        shard = Graph(matrix(part["x"]), source[known], row[known])
        ids, q, begin = queries["node"].to_numpy(), matrix(queries["x"]), queries["at"].to_numpy()
        own = queries["home"].to_numpy() == key[0]
        first = np.minimum(np.searchsorted(nodes, begin), len(nodes) - 1)
        first = np.where(nodes[first] == begin, first, -1)
        foreign = pd.Series(home).where(~here)
        out, edges, links = [], [], np.zeros(len(ids), np.int64)
        both = np.zeros((len(ids), int(here.sum())), dtype=bool) if own.all() else None  # at home: at most a shard by a shard
        for lo in range(0, len(ids), 256):
            block = slice(lo, lo + 256)
            found = shard.search(q[block], first[block], cosine, beam)
            found &= nodes[None, :] != ids[block, None]
            links[block] = found[:, here] @ weight[here]
            if both is not None:
                both[block] = found[:, here]
            i, j = np.nonzero(found)
            if len(i):
                all_ids = np.concatenate([ids[block], nodes])
                child, root = forest(len(all_ids), i, j + len(ids[block]))
                edges.append(pd.DataFrame({"node": all_ids[child], "at": all_ids[root]}))
            abroad = ~here[j]
            to = pd.DataFrame({"node": ids[block][i[abroad]], "shard": foreign.to_numpy()[j[abroad]], "at": nodes[j[abroad]]})
            out.append(to.drop_duplicates(["node", "shard"]))
            guest = here[j] & ~own[block][i]
            back = pd.DataFrame({"node": nodes[j[guest]], "shard": queries["home"].to_numpy()[block][i[guest]], "at": ids[block][i[guest]]})
            out.append(back.drop_duplicates(["node", "shard"]))
        if both is not None and len(ids) == both.shape[1]:  # all nodes of this home are asked at once: a link found one way counts both ways
            links = (both | both.T) @ weight[here]
        frames = [pd.DataFrame({"kind": "links", "node": ids, "links": links})]
        if out:
            frames.append(pd.concat(out).drop_duplicates(["node", "shard"]).assign(kind="visit"))
        if edges:
            frames.append(pd.concat(edges).drop_duplicates().assign(kind="edge"))
        done = pd.concat(frames)
        return pd.DataFrame({c: pd.array(done[c], dtype="Int64") if c in ("links", "at") else done[c] for c in ("kind", "node", "links", "shard", "at")})

    return left.drop("chunks").groupBy("shard", "chunk").cogroup(right.drop("chunks").groupBy("shard", "chunk")).applyInPandas(run, _FOUND)


def searched(held: DataFrame, copies: DataFrame, nodes: DataFrame, cosine: float, beam: int) -> tuple[DataFrame, DataFrame]:
    """((node, n_links), (a, b) edges that join what links) of all nodes; see the module."""
    homes = copies.where("home").select("node", "x", F.col("shard").alias("home"))
    asks = homes.select(F.col("home").alias("shard"), "node", "x", "home", F.lit(-1).cast("long").alias("at"))
    done, rounds = None, []
    while True:
        rounds.append(staged(visit(held, asks, cosine, beam)))
        visited = asks.select("node", "shard")
        done = visited if done is None else done.union(visited)
        todo = rounds[-1].where("kind = 'visit'").groupBy("node", "shard").agg(F.min("at").alias("at"))
        todo = staged(todo.join(done, ["node", "shard"], "left_anti"))
        if todo.isEmpty():
            break
        asks = staged(todo.join(homes, "node").select("shard", "node", "x", "home", "at"))
    found = rounds[0]
    for more in rounds[1:]:
        found = found.union(more)
    links = found.where("kind = 'links'").groupBy("node").agg(F.sum("links").alias("links"))
    links = staged(links.join(nodes.select("node", "n"), "node").select("node", (F.col("links") + F.col("n") - 1).alias("n_links")))
    return links, found.where("kind = 'edge'").select(F.col("node").alias("a"), F.col("at").alias("b"))


def audited(nodes: DataFrame, links: DataFrame, cosine: float, rows: int = AUDIT) -> float:
    """Share of the links of a hash sample of nodes that `links` (node, n_links) holds, counted against all nodes."""
    asked = hash_sample(nodes.select("node", "d", "n", "x"), rows, "node").collect()
    by_length = {d: (np.array([r["node"] for r in asked if r["d"] == d]), np.array([np.frombuffer(r["x"]) for r in asked if r["d"] == d]))
                 for d in {r["d"] for r in asked}}
    if not asked:
        return 1.0

    def run(batches):
        for batch in batches:
            for d, part in batch.groupby("d"):
                if d in by_length:
                    ids, q = by_length[d]
                    yield pd.DataFrame({"node": ids, "true": (q @ matrix(part["x"]).T >= cosine) @ part["n"].to_numpy()})

    true = nodes.select("d", "n", "x").mapInPandas(run, "node long, true long").groupBy("node").agg((F.sum("true") - 1).alias("true"))
    got = true.join(links.join(F.broadcast(true.sparkSession.createDataFrame([(r["node"],) for r in asked], "node long")), "node"), "node")
    found, all_ = got.agg(F.coalesce(F.sum(F.least("n_links", "true")), F.lit(0)), F.coalesce(F.sum("true"), F.lit(0))).first()
    return found / all_ if all_ else 1.0


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, shard: int = SHARD,
                    recall: float = RECALL, rounds: int = ROUNDS) -> DataFrame:
    """id, n_links and component (smallest id reachable) of each row of `vectors`."""
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda v: v + F.lit(0.0))  # no negative zeros
    read = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    ok = F.col("id").isNotNull() & F.coalesce(_valid(F.col("x")), F.lit(False))
    clean = read.where(ok).withColumns({"k1": F.xxhash64("x"), "k2": F.xxhash64(F.lit(1), "x")})
    nodes = points(clean)
    for attempt in range(rounds):
        copies = staged(shards(nodes, shard, attempt))
        links, edges = searched(graph(copies, nodes), copies, nodes, cosine, BEAM << attempt)
        found = audited(nodes, links, cosine)
        if found >= recall:
            break
    if found < recall:
        logging.getLogger(__name__).warning("the audit found a share of %.4f of the links", found)
    tops = staged(components(edges)).select(F.col("a").alias("node"), F.col("b").alias("top"))
    placed = nodes.select("node", "k1", "k2", "first").join(tops, "node", "left")
    placed = staged(placed.withColumn("top", F.coalesce("top", "node")).join(links, "node"))
    least = placed.groupBy("top").agg(F.min("first").alias("component"))
    result = placed.join(least, "top").select("k1", "k2", "n_links", "component")
    alone = read.where(~ok).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return clean.select("id", "k1", "k2").join(result, ["k1", "k2"]).select("id", "n_links", "component").union(alone)


def op11(vectors: DataFrame) -> DataFrame:
    out = near_duplicates(vectors)
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


#: All pairs; small tables only.
OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS k, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
c AS (
  SELECT k, vec_id, x, sqrt(list_sum(list_transform(x, lambda e: e * e))) AS size FROM v
  WHERE vec_id IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(x, lambda e: e <> 0)) > 0),
l AS (
  SELECT a.k AS a, b.k AS b FROM c a JOIN c b ON a.k <> b.k AND len(a.x) = len(b.x)
  WHERE list_inner_product(a.x, b.x) / (a.size * b.size) >= 0.95),
r AS (
  SELECT k AS a, k AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
t AS (
  SELECT r.a AS k, min(v.vec_id) AS component_id FROM r JOIN v ON v.k = r.b GROUP BY r.a),
n AS (
  SELECT a AS k, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN t USING (k) LEFT JOIN n USING (k)
"""
