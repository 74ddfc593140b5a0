"""Queries over vectors, alignments and families."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import protein, vectors
from seqloom.operators import alignment, family, vectorsearch
from seqloom.operators.graph import components
from seqloom.operators.specificity import top_per_group
from seqloom.runtime import cut, spread, table, written


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding", "label")


def cosine_topk(spark, d):
    """Five nearest rows by cosine of every row whose id is divisible by 20."""
    v = _vectors(spark, d)
    return vectorsearch.nearest(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 5).select("query", "id", "rank", F.round("score", 4).alias("score"))


def l2_nearest(spark, d):
    v = _vectors(spark, d)
    return vectorsearch.nearest(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 1, "l2").select("query", "id", F.round(-F.col("score"), 4).alias("distance"))


def interpolate_nearest(spark, d):
    """Points at a quarter, half and three quarters between rows whose ids are divisible by 20 and their successors, and the row nearest to each."""
    v = _vectors(spark, d)
    a = v.where("vec_id % 20 = 0").select("vec_id", F.col("embedding").alias("va"))
    b = v.where("vec_id % 20 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("vb"))
    steps = a.join(b, "vec_id").withColumn("step", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    points = steps.select((F.col("vec_id") * 4 + F.col("step")).alias("vec_id"), vectors.lerp("va", "vb", F.col("step") / 4).alias("embedding"))
    return vectorsearch.nearest(points, v.select("vec_id", "embedding"), "vec_id", "embedding", 1, "l2", itself=True).select(F.expr("query div 4").alias("first_id"), (F.col("query") % 4).alias("step"), "id")


def _closest(spark, d):
    v = _vectors(spark, d)
    refs = v.groupBy("label").agg(F.min("vec_id").alias("vec_id"), F.min_by("embedding", "vec_id").alias("embedding"))
    return vectorsearch.closest_reference(v, "vec_id", "embedding", refs)


def max_ref_similarity(spark, d):
    return _closest(spark, d).select("vec_id", F.round("sim", 4).alias("sim"), "ref")


def similarity_band(spark, d):
    return _closest(spark, d).where("sim between 0.15 and 0.6").select("vec_id", F.round("sim", 4).alias("sim"))


def top_n_per_ref(spark, d):
    return top_per_group(_closest(spark, d).where("ref is not null"), "ref", 5, F.desc("sim"), F.asc("vec_id")).select("ref", "vec_id", "rank")


def mean_vectors(spark, d):
    return vectorsearch.centroids(_vectors(spark, d), "label", "embedding").select("label", "dim", F.round("mean", 4).alias("mean"))


def parent_identity(spark, d):
    """Identity of each variant with its parent (the first record of that id), and whether it is novel at 0.85."""
    parents = table(spark, d, "mined_proteins").where("seq is not null").groupBy(F.trim("sequence_id").alias("parent")).agg(F.min_by("seq", "rec_id").alias("pseq"))
    pairs = table(spark, d, "drift_variants").select("rec_id", F.trim("parent_id").alias("parent"), protein.letters("seq").alias("seq")).join(parents, "parent").withColumn("pseq", protein.letters("pseq"))
    out = alignment.with_identity(pairs, "seq", "pseq")
    return out.select("rec_id", "parent", F.round("identity", 4).alias("identity"), (F.col("identity") < 0.85).alias("novel"))


def _family_rows(spark, d):
    rows = spread(table(spark, d, "mined_proteins").select("rec_id", "seq")).select(F.col("rec_id").alias("rec"), protein.letters("seq").alias("seq")).where("seq is not null")
    return rows.withColumn("part", protein.motif_count("seq"))


def family_clusters(spark, d):
    return family.families(_family_rows(spark, d))


def similarity_groups(spark, d):
    """Connected groups of profiles of cosine 0.7 or more with the same number of motifs."""
    rows = _family_rows(spark, d)
    points = written(family.profiles(rows, "rec", "seq", "part").withColumnRenamed("rec", "id"), "profiles")
    links = cut(family.similar(points, 0.7))
    return points.select(F.col("id").alias("rec")).join(components(links).withColumnRenamed("node", "rec"), "rec", "left").select("rec", F.coalesce("label", "rec").alias("group_id")).distinct()


QUERIES = {f.__name__: f for f in (cosine_topk, l2_nearest, interpolate_nearest, max_ref_similarity, similarity_band, top_n_per_ref, mean_vectors, parent_identity, family_clusters, similarity_groups)}

_COS = "list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[]))"
_L2 = "list_distance(cast(a.embedding as double[]), cast(b.embedding as double[]))"
_CLOSEST = f"""(select vec_id, greatest(coalesce(max(c), 0), 0) as sim, case when max(c) > 0 then arg_max(ref, struct_pack(c := c, r := -ref)) end as ref
    from (select a.vec_id, b.vec_id as ref, {_COS} as c from embeddings a, (select arg_min(vec_id, vec_id) as vec_id, arg_min(embedding, vec_id) as embedding from embeddings group by label) b) group by 1)"""

# Profiles as family.profiles counts them, all pairs of a part, and the closure of their links.
_GROUPS = """with recursive p as (select rec_id as rec, seq, len(regexp_extract_all(seq, 'R[^\\n]{4,6}H')) as part from (select rec_id, regexp_replace(upper(seq), '[^A-Z]', '', 'g') as seq from mined_proteins where seq is not null) where len(seq) >= 50),
    t as (select rec, part, ((ascii(seq[i]) * 676 + ascii(seq[i+1]) * 26 + ascii(seq[i+2])) * 2654435761) % 4294967296 as w from p, lateral (select unnest(range(1, len(seq) - 1)) as i)),
    v as (select rec, part, w // 16777216 as b, sum(case when (w // 8388608) % 2 = 1 then 1 else -1 end) as x from t group by 1, 2, 3),
    n as (select rec, sqrt(sum(x * x)) as n from v group by 1),
    d as (select y.rec as a, z.rec as b, sum(y.x * z.x) as dot from v y join v z on y.part = z.part and y.b = z.b and y.rec < z.rec group by 1, 2),
    e as (select a, b from d join n na on na.rec = a join n nb on nb.rec = b where dot / (na.n * nb.n) >= 0.7 - 1e-12),
    both_ways as (select a, b from e union select b, a from e),
    reach as (select rec as a, rec as b from p union select reach.a, w.b from reach join both_ways w on w.a = reach.b)
    select a as rec, min(b) as group_id from reach group by 1"""

ORACLE = {
    "similarity_groups": _GROUPS,
    "cosine_topk": f"select query, id, rank, round(c, 4) as score from (select a.vec_id as query, b.vec_id as id, {_COS} as c, row_number() over (partition by a.vec_id order by {_COS} desc, b.vec_id) as rank from embeddings a, embeddings b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id) where rank <= 5",
    "l2_nearest": f"select query, id, round(c, 4) as distance from (select a.vec_id as query, b.vec_id as id, {_L2} as c, row_number() over (partition by a.vec_id order by {_L2}, b.vec_id) as rank from embeddings a, embeddings b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id) where rank = 1",
    "interpolate_nearest": f"""with p as (select x.vec_id as first_id, s as step, list_transform(x.embedding, lambda e, i: (1 - s / 4.0) * cast(e as double) + s / 4.0 * cast(y.embedding[i] as double)) as embedding
            from embeddings x join embeddings y on y.vec_id = x.vec_id + 1, (values (1), (2), (3)) t(s) where x.vec_id % 20 = 0)
        select first_id, step, id from (select a.first_id, a.step, b.vec_id as id, row_number() over (partition by a.first_id, a.step order by round({_L2}, 9), b.vec_id) as rank from p a, embeddings b) where rank = 1""",
    "max_ref_similarity": f"select vec_id, round(sim, 4) as sim, ref from {_CLOSEST}",
    "similarity_band": f"select vec_id, round(sim, 4) as sim from {_CLOSEST} where sim between 0.15 and 0.6",
    "top_n_per_ref": f"select ref, vec_id, rank from (select ref, vec_id, row_number() over (partition by ref order by sim desc, vec_id) as rank from {_CLOSEST} where ref is not null) where rank <= 5",
    "mean_vectors": "select label, i - 1 as dim, round(avg(cast(embedding[i] as double)), 4) + 0.0 as mean from embeddings, range(1, 65) t(i) group by 1, 2",
}
