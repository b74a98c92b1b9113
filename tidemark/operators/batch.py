"""The best documents of many queries at once.

Joining every query with the postings of its terms makes a row for each query, term and
document, so ten times the queries over ten times the documents are a hundred times the
rows. Here a slice of the documents meets all queries in one Arrow batch function, which
scores by matrix products and hands on only what can be among the best of its slice.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most documents of a slice and of a block of it, most queries that meet a slice at once, terms in a block's matrix, queries in one product.
SLICE_DOCS, BLOCK_DOCS, SLICE_QUERIES, DENSE, CHUNK = 262_144, 16_384, 131_072, 256, 256


def _labels(spark: SparkSession, parts: int) -> list[int]:
    """A number for each of ``parts`` hash partitions that falls into it, so that no two slices share a task."""
    found: dict[int, int] = {}
    while len(found) < parts:
        ids = spark.range(0, 32 * parts + 1_000 + 1_000 * len(found)).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("at"))
        found = {r["at"]: r["id"] for r in ids.groupBy("at").agg(F.min("id").alias("id")).collect()}
    return [found[i] for i in range(parts)]


def best(qterms: DataFrame, stored: DataFrame, stats: DataFrame, queries: int, depth: int, formula: tuple[float, ...], candidates: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score: of every slice of documents the best ``depth`` of each query, hence all of the whole's best.

    ``qterms`` (query_id, term, weight) and ``stored`` as in ``ranking.score_entries``;
    ``formula`` has its fixed values.
    """
    spark = stored.sparkSession
    terms = qterms.where("query_id is not null").withColumnRenamed("term", "key")
    found = stored.join(terms.select("key").distinct(), "key", "left_semi")
    known = terms.join(found.select("key").distinct(), "key")
    asked = known.groupBy("query_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("q_norm"), F.collect_list("key").alias("keys"), F.collect_list("weight").alias("weights"))
    if candidates is not None:
        found = found.join(candidates.select("doc_id"), "doc_id", "left_semi")
    whole = stats.select("n", "mean").first()
    n, mean = (float(whole["n"]), float(whole["mean"] or 0)) if whole else (0.0, 0.0)
    slices, shares = max(spark.sparkContext.defaultParallelism, -(-int(n) // SLICE_DOCS)), max(1, -(-queries // SLICE_QUERIES))
    labels = F.array(*[F.lit(x).cast("bigint") for x in _labels(spark, slices * shares)])
    at = F.pmod(F.xxhash64("doc_id"), F.lit(slices)) * shares
    share = F.pmod(F.xxhash64("query_id"), F.lit(shares))
    left = found.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).select("key", "doc_id", "tf", "df", "length", "max_tf", F.get(labels, (at + F.col("share")).cast("int")).alias("cell"))
    right = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select("query_id", "q_norm", "keys", "weights", F.get(labels, (F.col("slice") * shares + share).cast("int")).alias("cell"))
    kinds = {f.name: f.dataType.simpleString() for f in (qterms.schema["query_id"], stored.schema["doc_id"])}
    left, right = left.repartition(slices * shares, "cell"), right.repartition(slices * shares, "cell")
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(_scorer(n, mean, depth, formula), f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")


def _scorer(n: float, mean: float, depth: int, formula: tuple[float, ...]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    bm25_weight, cosine_weight, k, b, smooth = formula
    dense, chunk, block = DENSE, CHUNK, BLOCK_DOCS

    def run(posts: pa.Table, asked: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        if not posts.num_rows or not asked.num_rows:
            return out(asked, none, none, np.zeros(0), posts["doc_id"])
        # Documents are numbered in the order of doc_id, which decides between equal scores.
        ids = pc.unique(posts["doc_id"])
        ids = ids.take(pc.sort_indices(ids))
        doc = pc.index_in(posts["doc_id"], value_set=ids).to_numpy().astype(np.int64)
        words = pc.unique(posts["key"])
        term = pc.index_in(posts["key"], value_set=words).to_numpy().astype(np.int64)
        tf, df, length, max_tf = (posts[c].to_numpy() for c in ("tf", "df", "length", "max_tf"))
        order = np.argsort(doc, kind="stable")
        doc, term, tf, df, length, max_tf = (x[order] for x in (doc, term, tf, df, length, max_tf))
        n_docs, n_terms = len(ids), len(words)
        df_of, len_of, top_of = np.zeros(n_terms), np.zeros(n_docs), np.ones(n_docs)
        df_of[term], len_of[doc], top_of[doc] = df, length, max_tf
        damp = k * (1 - b + b * len_of / mean)
        idf, lift = np.log2((n - df_of + smooth) / (df_of + smooth)) * (k + 1), np.log2(n / df_of)

        # The queries' terms that this slice has, as rows (q, t, w).
        lists = asked["keys"].combine_chunks()
        t = pc.index_in(lists.flatten(), value_set=words)
        q = np.repeat(np.arange(asked.num_rows), pc.list_value_length(lists).to_numpy())
        here = t.is_valid().to_numpy(zero_copy_only=False)
        q, t, w = q[here], t.drop_null().to_numpy().astype(np.int64), asked["weights"].combine_chunks().flatten().to_numpy()[here]
        q_norm = asked["q_norm"].to_numpy()

        # The terms that would make the most rows stand in a matrix; the others, and those that lower a score, stay postings.
        rows = np.bincount(t, minlength=n_terms) * np.bincount(term, minlength=n_terms)
        chosen = np.argsort(-np.where(idf > 0, rows, -1), kind="stable")[:dense]
        chosen = chosen[(idf[chosen] > 0) & (rows[chosen] > 0)]
        place = np.full(n_terms, -1)
        place[chosen] = np.arange(len(chosen))
        idf_c, lift_c = np.append(idf[chosen], 0.0), np.append(lift[chosen], 0.0)

        # Queries with the same terms in the matrix lie together and share its products.
        c = place[t]
        wide = int(np.bincount(q[c >= 0]).max()) if (c >= 0).any() else 0
        slots, weights = np.full((asked.num_rows, wide), len(chosen), np.int32), np.zeros((asked.num_rows, wide))
        order = np.lexsort((c, q))
        order = order[c[order] >= 0]
        col = np.arange(len(order)) - np.searchsorted(q[order], q[order])
        slots[q[order], col], weights[q[order], col] = c[order], w[order]
        lowered = np.zeros(asked.num_rows, bool)
        lowered[q[idf[t] <= 0]] = True
        queue = np.lexsort(slots.T[::-1]) if wide else np.arange(asked.num_rows)
        rest = np.flatnonzero(c < 0)
        rest = rest[np.argsort(q[rest], kind="stable")]
        rest_at = np.searchsorted(q[rest], np.arange(asked.num_rows + 1))
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(none, none, np.zeros(0))] * -(-len(queue) // chunk)  # q, doc, score of each product's queries
        for base in range(0, n_docs, block):
            size = min(block, n_docs - base)
            own = slice(*np.searchsorted(doc, (base, base + size)))
            p_doc, p_term, p_tf = doc[own] - base, term[own], tf[own]
            b_damp, b_top = damp[base : base + size], top_of[base : base + size]
            counts = np.zeros((len(chosen) + 1, size), np.float32)  # the last row is empty
            part = np.zeros((len(chosen), size), np.float32)
            m = place[p_term] >= 0
            at = place[p_term[m]], p_doc[m]
            counts[at] = p_tf[m]
            part[at] = idf[p_term[m]] * p_tf[m] / (p_tf[m] + b_damp[p_doc[m]])
            m = np.flatnonzero(~m)
            m = m[np.argsort(p_term[m], kind="stable")]
            post_doc, post_tf = p_doc[m], p_tf[m]
            starts = np.concatenate([[0], np.cumsum(np.bincount(p_term[m], minlength=n_terms))])
            bucket = max(1, size // max(2_048, 8 * depth))
            full = size // bucket
            for i, lo in enumerate(range(0, len(queue), chunk)):
                qs = queue[lo : lo + chunk]
                old_q, old_d, old_s = kept[i]
                pairs = none
                if wide:
                    cores, core_of = np.unique(slots[qs], axis=0, return_inverse=True)
                    core_of = core_of.ravel()
                    has = np.zeros((len(cores), len(chosen) + 1), np.float32)
                    has[np.arange(len(cores))[:, None], cores] = 1
                    s = has[:, :-1] @ part
                    # The depth-th largest of the buckets' highest sums is no more than the depth-th largest sum. A document
                    # whose sum is lower by more than a cosine can make up for has as many better ones, here or in an earlier block.
                    limit = np.zeros(len(cores))
                    if full >= depth:
                        peaks = s[:, : full * bucket].reshape(len(cores), full, bucket).max(2)
                        limit = np.partition(peaks, full - depth, axis=1)[:, full - depth].astype(float)
                    last = np.full(len(qs), -np.inf)
                    ends = np.searchsorted(old_q, np.arange(len(qs) + 1))
                    enough = np.flatnonzero(np.diff(ends) == depth)
                    last[enough] = old_s[ends[enough + 1] - 1] / bm25_weight
                    weakest = np.full(len(cores), np.inf)
                    np.minimum.at(weakest, core_of, last)
                    limit = np.maximum(limit, weakest)
                    limit[core_of[lowered[qs]]] = 0
                    least = np.maximum(limit - cosine_weight / bm25_weight - 1e-3 - 1e-5 * limit, 1e-30).astype(np.float32)
                    hit = np.flatnonzero(s >= least[:, None])
                    core, hit = hit // size, hit % size
                    first = np.searchsorted(core, np.arange(len(cores) + 1))
                    many = (first[1:] - first[:-1])[core_of]
                    pairs = np.repeat(np.arange(len(qs)) * size, many) + hit[spans(first[core_of], many)]
                # Documents with any other term of a query are all scored.
                many = rest_at[qs + 1] - rest_at[qs]
                row, row_q = rest[spans(rest_at[qs], many)], np.repeat(np.arange(len(qs)), many)
                many = starts[t[row] + 1] - starts[t[row]]
                at = spans(starts[t[row]], many)
                more = np.repeat(row_q, many) * size + post_doc[at]
                keys = np.unique(np.concatenate([pairs, more]))
                if not len(keys):
                    continue
                pq, pd = keys // size, keys % size
                bm, dot, norm = (np.zeros(len(keys)) for _ in range(3))
                if len(more):
                    to, tt = np.searchsorted(keys, more), np.repeat(t[row], many)
                    x = lift[tt] * post_tf[at] / b_top[post_doc[at]]
                    bm += np.bincount(to, idf[tt] * post_tf[at] / (post_tf[at] + b_damp[post_doc[at]]), len(keys))
                    dot += np.bincount(to, x * np.repeat(w[row], many), len(keys))
                    norm += np.bincount(to, x * x, len(keys))
                for j in range(wide):
                    slot = slots[qs, j][pq]
                    f = counts[slot, pd].astype(float)
                    bm += idf_c[slot] * f / (f + b_damp[pd])
                    x = lift_c[slot] * f / b_top[pd]
                    dot += x * weights[qs, j][pq]
                    norm += x * x
                under = np.sqrt(norm) * q_norm[qs][pq]
                score = bm25_weight * bm + cosine_weight * np.divide(dot, under, out=np.zeros(len(keys)), where=under > 0)
                pq, pd, score = (np.concatenate(x) for x in ((old_q, pq), (old_d, pd + base), (old_s, score)))
                order = np.lexsort((pd, -np.round(score, 6), pq))
                pq = pq[order]
                order = order[np.arange(len(order)) - np.searchsorted(pq, pq) < depth]
                pq = pq[np.arange(len(pq)) - np.searchsorted(pq, pq) < depth]
                kept[i] = pq, pd[order], score[order]
        q_of = [queue[i * chunk + pq] for i, (pq, _, _) in enumerate(kept)]
        return out(asked, *(np.concatenate(x) for x in (q_of, [d for _, d, _ in kept], [s for _, _, s in kept])), ids)

    def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """start, start + 1, ... of each span, one after the other."""
        return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)

    def out(asked: pa.Table, q: np.ndarray, d: np.ndarray, s: np.ndarray, ids: pa.Array) -> pa.Table:
        plain = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        return pa.table({"query_id": plain(asked["query_id"]).take(pa.array(q)), "doc_id": plain(ids).take(pa.array(d)), "score": pa.array(s)})

    return run
