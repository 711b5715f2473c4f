"""Queries over vectors and over turns as a knowledge base."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from convoq import adapters as A
from convoq.functions.text import overlap_ratio, tokenize, utterance_line
from convoq.functions.vectors import cosine
from convoq.operators import index as I
from convoq.operators import vectors as V
from convoq.plugins import extractive, lexical_reranker, lexical_similarity

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _vectors(spark, d):
    return A.table(spark, d, "embeddings")


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def _cos(a: str, b: str) -> str:
    return f"{_dot(a, b)} / ((sqrt({_dot(a, a)}) + 1e-9) * (sqrt({_dot(b, b)}) + 1e-9))"


_KNN = f"""kn AS (SELECT q.vec_id AS query_id, v.vec_id, round({_cos('q.embedding', 'v.embedding')}, 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
  top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM kn QUALIFY rank <= 30)"""


def _top30(spark, d):
    v = _vectors(spark, d)
    return V.knn(v.where("vec_id % 50 = 0"), v, 30)


@query("WITH " + _KNN + " SELECT query_id, rank, vec_id, round(score, 6) AS score FROM top")
def knn_top30(spark, d):
    return _top30(spark, d).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


_TOKENS = r"list_distinct(list_filter(string_split_regex(trim(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g')), ' +'), lambda t: t <> ''))"


@query("WITH " + A.UTTERANCES + f""", t AS (SELECT meeting_id, utt_idx, {_TOKENS} AS k FROM utterances), q AS (SELECT meeting_id, k AS qk FROM t WHERE utt_idx = 0),
  s AS (SELECT t.meeting_id, utt_idx, CASE WHEN len(qk) > 0 AND len(k) > 0 THEN len(list_intersect(qk, k)) / sqrt(len(qk) * len(k)) ELSE 0 END AS sim, CASE WHEN len(qk) > 0 THEN len(list_intersect(qk, k)) / len(qk) ELSE 0 END AS again FROM t JOIN q USING (meeting_id) WHERE utt_idx > 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY round(sim, 9) DESC, utt_idx) AS rank FROM s QUALIFY rank <= 30),
  n AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY round(again, 9) DESC, rank) AS new_rank FROM r QUALIFY new_rank <= 5)
  SELECT meeting_id, utt_idx, rank, new_rank, round(sim, 6) AS score, round(again, 6) AS rerank_score FROM n""")
def rerank_top5(spark, d):
    """A meeting's first turn as the question: the 30 turns nearest by the default embedder, of these the 5 that the default reranker puts first."""
    u = A.utterances(spark, d).select("meeting_id", "utt_idx", "text")
    q = u.where("utt_idx = 0").select("meeting_id", F.col("text").alias("question"))
    j = u.where("utt_idx > 0").join(q, "meeting_id").withColumn("score", F.round(lexical_similarity(F.col("question"), F.col("text")), 9))
    rank = F.row_number().over(Window.partitionBy("meeting_id").orderBy(F.desc("score"), "utt_idx"))
    top = j.withColumn("rank", rank).where("rank <= 30").withColumn("query_id", F.col("meeting_id"))
    r = V.rerank(top, F.round(lexical_reranker(F.col("question"), F.col("text")), 9))
    long = lambda c: F.col(c).cast("long").alias(c)
    return r.select("meeting_id", "utt_idx", long("rank"), long("new_rank"), F.round("score", 6).alias("score"), F.round("rerank_score", 6).alias("rerank_score"))


@query("WITH " + _KNN + """, q AS (SELECT query_id, min(rank) FILTER (v.label = w.label AND top.vec_id <> query_id) AS first FROM top JOIN embeddings v USING (vec_id) JOIN embeddings w ON w.vec_id = query_id GROUP BY query_id)
  SELECT count(*) AS n_queries, round(avg(CASE WHEN first <= 2 THEN 1 ELSE 0 END), 6) AS hit_at_2, round(avg(CASE WHEN first <= 5 THEN 1 ELSE 0 END), 6) AS hit_at_5, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM q""")
def hit_rate_mrr(spark, d):
    """A hit is another vector of the query's label; the query itself is the first of its neighbours."""
    v = _vectors(spark, d).select("vec_id", "label")
    h = _top30(spark, d).join(v, "vec_id").join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label")), "query_id")
    first = F.min(F.when((F.col("label") == F.col("q_label")) & (F.col("vec_id") != F.col("query_id")), F.col("rank")))
    q = h.groupBy("query_id").agg(first.alias("first"))
    hit = lambda k: F.round(F.avg(F.when(F.col("first") <= k, 1).otherwise(0)), 6)
    return q.agg(F.count("*").alias("n_queries"), hit(2).alias("hit_at_2"), hit(5).alias("hit_at_5"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


@query()
def knn_indexed(spark, d):
    """The same search by the index: approximate, so index_recall measures it."""
    return _indexed(spark, d).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


def _indexed(spark, d):
    v = _vectors(spark, d)
    c = I.fit_cells(v)
    return I.search(v.where("vec_id % 50 = 0"), I.build(v, c), c, 30)


@query()
def index_recall(spark, d):
    """How much of the exact neighbours the index finds."""
    return I.recall(_indexed(spark, d), _top30(spark, d))


_LINE = "'[' || start_ms || '] ' || speaker || ': ' || text"


@query("WITH " + A.UTTERANCES + f""", l AS (SELECT meeting_id, utt_idx, {_LINE} AS line FROM utterances),
  c AS (SELECT meeting_id, utt_idx, string_agg(line, chr(10)) OVER (PARTITION BY meeting_id ORDER BY utt_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM l)
  SELECT * FROM c""")
def context_window(spark, d):
    u = A.utterances(spark, d)
    line = utterance_line(F.col("start_ms").cast("string"), F.col("speaker"), F.col("text"))
    near = F.collect_list(F.struct("utt_idx", line.alias("t"))).over(Window.partitionBy("meeting_id").orderBy("utt_idx").rowsBetween(-1, 1))
    return u.select("meeting_id", "utt_idx", F.array_join(F.transform(F.array_sort(near), lambda s: s["t"]), "\n").alias("context"))


#: Hits of a meeting in order of their token overlap with its first turn.
@query("WITH RECURSIVE " + A.UTTERANCES + r""", h AS (SELECT meeting_id, utt_idx, row_number() OVER (PARTITION BY meeting_id ORDER BY (utt_idx * 7 + meeting_id) % 5, utt_idx) AS r FROM utterances),
  n AS (SELECT meeting_id, max(utt_idx) AS last FROM utterances GROUP BY 1),
  f AS (SELECT meeting_id, r, [utt_idx] AS kept, list_filter([utt_idx - 1, utt_idx, utt_idx + 1], lambda x: x >= 0 AND x <= last) AS done FROM h JOIN n USING (meeting_id) WHERE r = 1
    UNION ALL SELECT f.meeting_id, h.r, CASE WHEN list_contains(done, h.utt_idx) THEN kept ELSE list_append(kept, h.utt_idx) END, CASE WHEN list_contains(done, h.utt_idx) THEN done ELSE list_concat(done, list_filter([h.utt_idx - 1, h.utt_idx, h.utt_idx + 1], lambda x: x >= 0 AND x <= last)) END
      FROM f JOIN h ON h.meeting_id = f.meeting_id AND h.r = f.r + 1 JOIN n ON n.meeting_id = f.meeting_id WHERE h.r <= 5)
  SELECT meeting_id, CAST(len(arg_max(kept, r)) AS BIGINT) AS n_kept, array_to_string(arg_max(kept, r), ',') AS kept FROM f GROUP BY meeting_id""")
def neighbour_dedupe(spark, d):
    """Of five ranked hits those are skipped that a better hit already brought in as a neighbour."""
    u = A.utterances(spark, d)
    r = F.row_number().over(Window.partitionBy("meeting_id").orderBy((F.col("utt_idx") * 7 + F.col("meeting_id")) % 5, "utt_idx"))
    last = F.max("utt_idx").over(Window.partitionBy("meeting_id"))
    h = u.select("meeting_id", "utt_idx", r.alias("r"), last.alias("last")).where("r <= 5")
    g = h.groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "utt_idx"))), lambda s: s["utt_idx"]).alias("hits"), F.max("last").alias("last"))
    empty = F.array().cast("array<bigint>")

    def fold(acc, x):
        near = F.filter(F.array(x - 1, x, x + 1), lambda i: (i >= 0) & (i <= F.col("last")))
        skip = F.array_contains(acc["done"], x)
        return F.struct(F.when(skip, acc["kept"]).otherwise(F.array_append(acc["kept"], x)).alias("kept"), F.when(skip, acc["done"]).otherwise(F.concat(acc["done"], near)).alias("done"))

    k = g.select("meeting_id", F.aggregate("hits", F.struct(empty.alias("kept"), empty.alias("done")), fold, lambda a: a["kept"]).alias("k"))
    return k.select("meeting_id", F.size("k").cast("long").alias("n_kept"), F.array_join(F.transform("k", lambda x: x.cast("string")), ",").alias("kept"))


@query("WITH " + A.UTTERANCES + f" SELECT meeting_id, count(*) AS n, string_agg({_LINE}, chr(10) ORDER BY utt_idx) AS full_text FROM utterances GROUP BY meeting_id")
def kb_full_text(spark, d):
    u = A.utterances(spark, d)
    line = utterance_line(F.col("start_ms").cast("string"), F.col("speaker"), F.col("text"))
    return u.groupBy("meeting_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("utt_idx", line.alias("t")))), lambda s: s["t"]), "\n").alias("full_text"))


@query("WITH " + A.UTTERANCES + r""", t AS (SELECT meeting_id, utt_idx, text, list_distinct(list_filter(string_split_regex(trim(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g')), ' +'), lambda t: t <> '')) AS k FROM utterances),
  q AS (SELECT meeting_id, k AS qk FROM t WHERE utt_idx = 0), s AS (SELECT t.meeting_id, utt_idx, text, CASE WHEN len(qk) > 0 THEN len(list_intersect(qk, k)) / len(qk) ELSE 0 END AS score FROM t JOIN q USING (meeting_id) WHERE utt_idx > 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY score DESC, utt_idx) AS rank FROM s QUALIFY rank <= 2)
  SELECT meeting_id, round(max(score), 6) AS best, string_agg(text, chr(10) ORDER BY rank) AS answer FROM r GROUP BY meeting_id""")
def extractive_answer(spark, d):
    """The default text generator: the two turns nearest to the first one by its tokens."""
    u = A.utterances(spark, d).select("meeting_id", "utt_idx", "text")
    q = u.where("utt_idx = 0").select("meeting_id", F.col("text").alias("question"))
    return extractive(u.where("utt_idx > 0").join(q, "meeting_id"), "meeting_id", "utt_idx", k=2)


# Clusters --------------------------------------------------------------------------------------------------------------

_CENT = """x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m, count(*) AS n FROM x GROUP BY ALL),
  cent AS (SELECT label, max(n) AS n, list(m ORDER BY i) AS centroid FROM m GROUP BY label)"""


@query("WITH " + _CENT + " SELECT label, i AS dim, n, round(m, 5) AS mean FROM m")
def centroids(spark, d):
    c = V.centroids(_vectors(spark, d), ["label"])
    return c.select("label", "n", F.posexplode("centroid").alias("p", "m")).select("label", (F.col("p") + 1).cast("long").alias("dim"), "n", F.round("m", 5).alias("mean"))


_NEAR = _CENT + f""", s AS (SELECT vec_id, e.label, c.label AS cluster, round({_cos('embedding', 'centroid')}, 9) AS score FROM embeddings e, cent c),
  nc AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cluster) = 1)"""


def _nearest(spark, d):
    v = _vectors(spark, d)
    return V.nearest_centroid(v, V.centroids(v, ["label"])).join(v.select("vec_id", "label"), "vec_id")


@query("WITH " + _NEAR + " SELECT vec_id, cluster, round(score, 6) AS score FROM nc")
def nearest_centroid(spark, d):
    return _nearest(spark, d).select("vec_id", "cluster", F.round("score", 6).alias("score"))


_OUT = _CENT + """, di AS (SELECT vec_id, e.label, embedding, sqrt(list_sum(list_transform(list_zip(embedding, centroid), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2])))) AS dist FROM embeddings e JOIN cent USING (label)),
  outl AS (SELECT *, dist > avg(dist) OVER w + 1.5 * stddev_pop(dist) OVER w AS is_outlier FROM di WINDOW w AS (PARTITION BY label))"""


@query("WITH " + _OUT + " SELECT vec_id, label, round(dist, 5) AS distance, is_outlier FROM outl")
def outliers(spark, d):
    return V.outliers(_vectors(spark, d), ["label"]).select("vec_id", "label", F.round("distance", 5).alias("distance"), "is_outlier")


@query("WITH " + _OUT + f""", ca AS (SELECT vec_id, embedding, 'outlier' AS origin FROM outl WHERE is_outlier AND vec_id % 5 <> 0 UNION ALL SELECT vec_id, embedding, 'skipped' FROM embeddings WHERE vec_id % 5 = 0),
  s AS (SELECT vec_id, origin, c.label AS cluster, round({_dot('embedding', 'centroid')}, 9) AS score FROM ca, cent c), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cluster) = 1)
  SELECT vec_id, origin, cluster, round(score, 5) AS score, score < 0.35 AS tentative FROM b""")
def reassign_candidates(spark, d):
    v = _vectors(spark, d)
    out = V.outliers(v, ["label"]).where("is_outlier and vec_id % 5 <> 0").select("vec_id").join(v, "vec_id")
    r = V.reassign(out, v.where("vec_id % 5 = 0"), V.centroids(v, ["label"]))
    return r.select("vec_id", "origin", "cluster", F.round("score", 5).alias("score"), "tentative")


@query("WITH " + _NEAR + " SELECT label AS gt, cluster AS sys, count(*) AS n FROM nc GROUP BY ALL")
def contingency(spark, d):
    return V.contingency(_nearest(spark, d), "label", "cluster")


@query("WITH " + _NEAR + """, ct AS (SELECT label AS g, cluster AS s, count(*) AS n FROM nc GROUP BY ALL), a AS (SELECT g, sum(n) AS a FROM ct GROUP BY g), b AS (SELECT s, sum(n) AS b FROM ct GROUP BY s), t AS (SELECT sum(n) AS t, sum(n * (n - 1) / 2) AS p FROM ct),
  pa AS (SELECT sum(a * (a - 1) / 2) AS pa, -sum(a / t * ln(a / t)) AS ha FROM a, t), pb AS (SELECT sum(b * (b - 1) / 2) AS pb, -sum(b / t * ln(b / t)) AS hb FROM b, t), mi AS (SELECT sum(n / t * ln(n * t / (a * b))) AS mi FROM ct JOIN a USING (g) JOIN b USING (s), t)
  SELECT CAST(t AS BIGINT) AS n, round(CASE WHEN (pa + pb) / 2 - pa * pb / (t * (t - 1) / 2) <> 0 THEN (p - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)) ELSE 1 END, 6) AS ari, round(CASE WHEN (ha + hb) / 2 > 0 THEN mi / ((ha + hb) / 2) ELSE 1 END, 6) AS nmi FROM t, pa, pb, mi""")
def cluster_ari_nmi(spark, d):
    return V.agreement(V.contingency(_nearest(spark, d), "label", "cluster"))


@query(f"""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt({_dot('v', 'v')})) AS v FROM e),
  p AS (SELECT a.vec_id, a.label, b.label AS other, sum(1 - {_dot('a.v', 'b.v')}) AS d, count(*) AS n FROM u a, u b WHERE a.vec_id <> b.vec_id GROUP BY ALL),
  s AS (SELECT vec_id, label, max(d / n) FILTER (other = label) AS a, min(d / n) FILTER (other <> label) AS b FROM p GROUP BY ALL)
  SELECT label, count(*) AS n, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(b, a) END), 5) AS silhouette FROM s GROUP BY label""")
def silhouette(spark, d):
    s = V.silhouette(_vectors(spark, d))
    return s.select("label", "n", F.round("silhouette", 5).alias("silhouette"))


@query("WITH " + _CENT + f""", di AS (SELECT e.label, sqrt(list_sum(list_transform(list_zip(embedding, centroid), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2])))) AS dist FROM embeddings e JOIN cent USING (label)),
  sp AS (SELECT label, count(*) AS n, avg(dist) AS spread FROM di GROUP BY label), pr AS (SELECT a.label, (a.spread + b.spread) / sqrt(list_sum(list_transform(list_zip(p.centroid, q.centroid), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS r
    FROM sp a, sp b, cent p, cent q WHERE a.label <> b.label AND p.label = a.label AND q.label = b.label)
  SELECT label, n, round(spread, 5) AS spread, round(coalesce(max(r), 0), 5) AS worst FROM sp LEFT JOIN pr USING (label) GROUP BY label, n, spread""")
def davies_bouldin(spark, d):
    """The index is the mean of `worst`."""
    r = lambda c: F.round(c, 5).alias(c)
    return V.davies_bouldin(_vectors(spark, d)).select("label", "n", r("spread"), r("worst"))


@query()
def embedding_scatter(spark, d):
    """The data of a scatter plot."""
    return V.scatter(_vectors(spark, d))


@query("WITH " + _NEAR + " SELECT CAST(least(floor(score * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM nc WHERE score BETWEEN 0 AND 1 GROUP BY 1")
def confidence_histogram(spark, d):
    return V.confidence_histogram(_nearest(spark, d))


@query("SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR))) AS pivot_rank FROM embeddings QUALIFY pivot_rank <= 3")
def pivot_sample(spark, d):
    return V.pivots(_vectors(spark, d), "label").select("vec_id", "label", F.col("pivot_rank").cast("long").alias("pivot_rank"))


@query("WITH " + _NEAR + """, ct AS (SELECT label AS g, cluster AS s, count(*) AS n FROM nc GROUP BY ALL)
  SELECT count(*) AS n, CAST(count(*) FILTER (label = cluster) AS BIGINT) AS n_same, round(avg(score), 5) AS mean_score, round(min(score), 5) AS min_score, round(max(score), 5) AS max_score FROM nc""")
def assignment_summary(spark, d):
    n = _nearest(spark, d)
    r = lambda f: F.round(f("score"), 5)
    return n.agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("cluster")).alias("n_same"), r(F.avg).alias("mean_score"), r(F.min).alias("min_score"), r(F.max).alias("max_score"))


def _groups(spark, d):
    """Groups of bounded size, as many as the vectors fill."""
    return _vectors(spark, d).withColumn("meeting_id", F.expr("vec_id div 250"))


@query()
def cluster_refinement(spark, d):
    """Sub-clusters and outliers of each label in each group."""
    return V.refine_clusters(_groups(spark, d).withColumnRenamed("vec_id", "seq").withColumnRenamed("label", "speaker"))[0]


@query()
def cluster_comparison(spark, d):
    """All of a group clustered at once against its labels."""
    return V.refine_clusters(_groups(spark, d).withColumnRenamed("vec_id", "seq").withColumnRenamed("label", "speaker"))[1]


@query()
def spectral_labels(spark, d):
    return V.cluster_groups(_groups(spark, d), "meeting_id", method="spectral")


@query()
def agglomerative_labels(spark, d):
    return V.cluster_groups(_groups(spark, d), "meeting_id", method="agglomerative")


@query()
def two_phase_labels(spark, d):
    """Large segments are clustered, pivots make centroids, and the skipped rest goes to the nearest one."""
    v = _groups(spark, d)
    large, skipped = v.where("vec_id % 5 <> 0"), v.where("vec_id % 5 = 0")
    found = V.cluster_groups(large, "meeting_id").join(large.select("vec_id", "embedding"), "vec_id")
    p = V.pivots(found.withColumn("g", F.concat_ws(":", "meeting_id", "cluster")), "g")
    c = V.centroids(p, ["meeting_id", "cluster"])
    j = skipped.select("meeting_id", "vec_id", "embedding").join(c.select("meeting_id", "cluster", "centroid"), "meeting_id")
    j = j.withColumn("score", F.round(cosine(F.col("embedding"), F.col("centroid")), 9))
    best = j.groupBy("meeting_id", "vec_id").agg(F.max(F.struct("score", (-F.col("cluster")).alias("n"))).alias("b")).select("meeting_id", "vec_id", (-F.col("b.n")).alias("cluster"), F.lit("assigned").alias("phase"))
    return found.select("meeting_id", "vec_id", "cluster", F.lit("clustered").alias("phase")).unionByName(best)


#: The largest matching by dynamic programming over sets of clusters that are taken, label after label.
@query("WITH RECURSIVE " + _NEAR + """, p AS (SELECT vec_id // 250 AS meeting_id, label AS g, cluster AS s FROM nc), c AS (SELECT meeting_id, g, s, count(*) AS n FROM p GROUP BY ALL),
  gs AS (SELECT meeting_id, g, row_number() OVER (PARTITION BY meeting_id ORDER BY g) AS i FROM (SELECT DISTINCT meeting_id, g FROM p)), ss AS (SELECT meeting_id, s, row_number() OVER (PARTITION BY meeting_id ORDER BY s) - 1 AS j FROM (SELECT DISTINCT meeting_id, s FROM p)),
  e AS (SELECT c.meeting_id, i, j, n FROM c JOIN gs USING (meeting_id, g) JOIN ss USING (meeting_id, s)), k AS (SELECT meeting_id, i FROM gs),
  f AS (SELECT DISTINCT meeting_id, 0 AS i, 0 AS taken, 0 AS best FROM p
    UNION ALL SELECT meeting_id, i, taken, CAST(max(best) AS INT) FROM (SELECT f.meeting_id, f.i + 1 AS i, f.taken | CASE WHEN e.j IS NULL THEN 0 ELSE 1 << CAST(e.j AS INT) END AS taken, f.best + coalesce(e.n, 0) AS best
      FROM f JOIN k ON k.meeting_id = f.meeting_id AND k.i = f.i + 1 LEFT JOIN (SELECT * FROM e UNION ALL SELECT meeting_id, i, NULL, 0 FROM k) e ON e.meeting_id = f.meeting_id AND e.i = f.i + 1 WHERE e.j IS NULL OR (f.taken >> CAST(e.j AS INT)) % 2 = 0) x GROUP BY meeting_id, i, taken),
  mt AS (SELECT meeting_id, CAST(max(best) AS BIGINT) AS matched FROM f GROUP BY meeting_id)
  SELECT meeting_id, count(DISTINCT g) AS n_true, count(DISTINCT s) AS n_pred, count(*) AS n, matched, round(matched / count(*), 6) AS accuracy FROM p JOIN mt USING (meeting_id) GROUP BY meeting_id, matched""")
def matched_accuracy(spark, d):
    """Share of vectors whose nearest cluster is matched to their label, one to one, in each group."""
    n = _nearest(spark, d).select(F.expr("vec_id div 250").alias("meeting_id"), F.col("label").cast("string").alias("gt"), F.col("cluster").cast("string").alias("sys"))
    return V.matched(n)


@query()
def pca_kmeans_labels(spark, d):
    return V.pca_kmeans(_vectors(spark, d))


@query("WITH RECURSIVE " + A.SEGMENTS_GT + """,
  o AS (SELECT meeting_id, seq, speaker, CAST(seq % 3 AS INT) AS priority, start_ms AS s, end_ms AS e, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, seq % 3 DESC, seq) AS k FROM segments_gt),
  f AS (SELECT meeting_id, 0::BIGINT AS k, CAST([] AS STRUCT(a BIGINT, b BIGINT)[]) AS open, 0::BIGINT AS seq, NULL::BIGINT AS start_ms, NULL::BIGINT AS end_ms FROM (SELECT DISTINCT meeting_id FROM o)
    UNION ALL SELECT meeting_id, k, CASE WHEN te > ts AND NOT covered THEN list_append(near, {'a': ts, 'b': te}) ELSE near END, seq, CASE WHEN te > ts AND NOT covered THEN ts END, CASE WHEN te > ts AND NOT covered THEN te END
    FROM (SELECT *, len(list_filter(near, lambda m: s >= m.a - 0.05 AND e <= m.b + 0.05)) > 0 AS covered,
        coalesce(list_filter(near, lambda m: e > m.a AND s < m.b AND s < m.a)[-1].a, e) AS te, coalesce(list_filter(near, lambda m: e > m.a AND s < m.b AND s >= m.a AND e > m.b)[-1].b, s) AS ts
      FROM (SELECT f.meeting_id, o.k, o.seq, o.s, o.e, list_filter(f.open, lambda m: m.b + 0.05 >= o.s) AS near FROM f JOIN o ON o.meeting_id = f.meeting_id AND o.k = f.k + 1)))
  SELECT f.meeting_id, f.seq, speaker, priority, f.start_ms, f.end_ms FROM f JOIN o ON o.meeting_id = f.meeting_id AND o.k = f.k WHERE f.start_ms IS NOT NULL""")
def stage_merge(spark, d):
    """Segments of three stages by priority, without overlaps."""
    s = A.segments_gt(spark, d).select("meeting_id", "seq", "speaker", (F.col("seq") % 3).cast("int").alias("priority"), "start_ms", "end_ms")
    return V.merge_stages(s)
