"""Queries on vector retrieval and quality reports."""

from pyspark.sql import functions as F

from spoorgrid.operators import metrics as M
from spoorgrid.operators import retrieval as R
from spoorgrid.plans.registry import query

DIM = 64


def _vec(src):
    return src.embeds.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"), "label")


def _bank(src, models=1):
    v = _vec(src)
    vec = F.col("e") if models == 1 else F.concat("e", F.reverse("e"))
    return v.select(F.col("vec_id").alias("item"), vec.alias("bvec"))


def _turn(e, s):
    return e if s == 0 else F.concat(F.slice(e, s + 1, DIM - s), F.slice(e, 1, s))


def _queries(src, models=1, variants=1, truth=False):
    v = _vec(src)
    parts = [_turn(F.col("e") if m == 0 else F.reverse("e"), s) for m in range(models) for s in range(variants)]
    q = v.select(F.col("vec_id").alias("qid"), F.concat(*parts).alias("qvec"), "label")
    if not truth:
        return q.drop("label")
    # the truth of a query is the lowest other id of its class
    low = v.groupBy("label").agg(F.min("vec_id").alias("a"))
    rest = v.join(low, "label").where(F.col("vec_id") != F.col("a")).groupBy("label").agg(F.min("vec_id").alias("b"))
    q = q.join(low, "label").join(rest, "label")
    return q.select("qid", "qvec", F.when(F.col("qid") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("truth"))


_E = "e as (select vec_id, cast(embedding as double[]) as e, label from embeds)"
_P = f"""{_E}, p as (select a.vec_id as qid, b.vec_id as item, round(list_dot_product(a.e, b.e), 12) as score,
    round(list_dot_product(list_reverse(a.e), list_reverse(b.e)), 12) as score2 from e a join e b on a.vec_id <> b.vec_id)"""
_TOP = "select qid, item, score, row_number() over (partition by qid order by score desc, item) as rank from"
_TRUTH = """t as (select a.vec_id as qid, min(b.vec_id) as truth from e a join e b on a.label = b.label
    and a.vec_id <> b.vec_id group by a.vec_id)"""
_RANK = f"""{_P}, {_TRUTH}, g as (select t.qid, truth, score as truth_score from t join p on p.qid = t.qid
    and p.item = t.truth), r as (select g.qid, truth, truth_score, 1 + count(*) filter (where p.score > truth_score
    or (p.score = truth_score and p.item < truth)) as truth_rank from g join p on p.qid = g.qid and p.item <> truth
    group by all)"""


def _rot(a: str, s: int) -> str:
    return a if s == 0 else f"list_concat({a}[{s + 1}:{DIM}], {a}[1:{s}])"


_V = f"""{_E}, pv as (select a.vec_id as qid, b.vec_id as item, v, case v """ + " ".join(
    f"when {s} then round(list_dot_product({_rot('a.e', s)}, b.e), 12)" for s in range(3)) + """ end as s0, case v """ + " ".join(
    f"when {s} then round(list_dot_product({_rot('list_reverse(a.e)', s)}, list_reverse(b.e)), 12)" for s in range(3)) + """ end as s1
    from e a join e b on a.vec_id <> b.vec_id, (select unnest([0, 1, 2]) as v) t)"""


@query("J6_vector_scoring_moments", "embeds", f"""with {_P}
    select qid, count(*) as items, avg(score) as mean, stddev_pop(score) as dev, max(score) as best
    from p group by qid""", real="mean dev best")
def _(src):
    q, b = _queries(src), _bank(src)
    m = R.score_moments(q, b)
    best = R.top_k(q, b, 1).select("qid", F.col("score").alias("best"))
    return m.join(best, "qid").select("qid", F.col("n").alias("items"), F.col("mean")[0].alias("mean"),
                                      F.col("std")[0].alias("dev"), "best")


@query("W1_top_k", "embeds", f"with {_P} select * from ({_TOP} p) where rank <= 5", real="score")
def _(src):
    return R.top_k(_queries(src), _bank(src), 5).drop("variant")


@query("L2_shortlist", "embeds", f"with {_P} select qid, item from ({_TOP} p) where rank <= 8")
def _(src):
    return R.top_k(_queries(src), _bank(src), 8).select("qid", "item")


@query("W2_truth_rank", "embeds", f"with {_RANK} select * from r", real="truth_score")
def _(src):
    return R.truth_rank(_queries(src, truth=True), _bank(src))


@query("A12_retrieval_quality", "embeds", f"""with {_RANK} select count(*) as queries, avg((truth_rank = 1)::int) as top1,
    avg((truth_rank <= 1)::int) as recall_1, avg((truth_rank <= 5)::int) as recall_5,
    avg((truth_rank <= 10)::int) as recall_10, avg(1 / truth_rank) as mrr from r""",
       real="top1 recall_1 recall_5 recall_10 mrr")
def _(src):
    return R.retrieval_report(R.truth_rank(_queries(src, truth=True), _bank(src)), (1, 5, 10))


@query("W3_standardised_scores", "embeds", f"""with {_P}, z as (select *, (score - avg(score) over w)
    / stddev_pop(score) over w as z from p window w as (partition by qid))
    select qid, item, z from (select *, row_number() over (partition by qid order by score desc, item) as rank from z)
    where rank <= 5""", real="z")
def _(src):
    q, b = _queries(src), _bank(src)
    top = R.top_k(q, b, 5).join(R.score_moments(q, b), "qid")
    dev = F.col("std")[0]
    return top.select("qid", "item", ((F.col("score") - F.col("mean")[0]) / F.when(dev < 1.0e-6, 1.0).otherwise(dev)).alias("z"))


@query("W4_rotation_search", "embeds", f"""with {_V}, m as (select qid, item, max(s0) as score,
    arg_max(v, (s0, -v)) as variant from pv group by all)
    select * from (select qid, item, score, variant, row_number() over (partition by qid order by score desc, item) as rank
    from m) where rank <= 5""", real="score", whole="variant")
def _(src):
    return R.top_k(_queries(src, variants=3), _bank(src), 5, variants=3)


_BLEND_EACH = f"""{_V}, z as (select qid, item, v, 7e-1 * (s0 - avg(s0) over w) / stddev_pop(s0) over w
    + 3e-1 * (s1 - avg(s1) over w) / stddev_pop(s1) over w as s from pv window w as (partition by qid, v))"""
_BLEND = f"""{_BLEND_EACH}, m as (select qid, item, round(max(s), 12) as score from z group by all),
    bl as (select *, row_number() over (partition by qid order by score desc, item) as rank from m)"""


def _blend(src):
    return R.blended(_queries(src, 2, 3), _bank(src, 2), 0.3, 3, DIM)


@query("W5_score_blend", "embeds", f"with {_BLEND} select qid, item, score, rank from bl where rank <= 5", real="score")
def _(src):
    q, b = _blend(src)
    return R.top_k(q, b, 5, variants=3).drop("variant")


@query("W6_shortlist_rerank", "embeds", f"""with {_BLEND_EACH},
    o as (select *, row_number() over (partition by qid, v order by round(s, 12) desc, item) as rank from z),
    l as (select *, ((qid * 31 + item * 17 + v * 7) % 101) / 101e0 as local_ from o),
    f as (select qid, item, v, round(s + case when rank <= 8 then 4e-1 * (local_ - avg(local_) over w) / stddev_pop(local_) over w else 0 end, 12) as final
          from l window w as (partition by qid, v, rank <= 8)),
    m as (select qid, item, max(final) as final, arg_max(v, (final, -v)) as variant from f group by all)
    select * from (select qid, item, final, variant, row_number() over (partition by qid order by final desc, item) as final_rank from m)
    where final_rank <= 4""", real="final", whole="variant")
def _(src):
    singles, bank = R.blended_variants(_queries(src, 2, 3), _bank(src, 2), 0.3, 3, DIM)
    local = F.pmod(F.col("qid") * 31 + F.col("item") * 17 + F.col("v") * 7, F.lit(101)) / 101.0
    return R.rerank_variants(singles, bank, 3, local, 8, 0.4, 4).select("qid", "item", "final", "variant", "final_rank")


@query("W7_ensemble", "embeds", f"""with {_V}, m as (select qid, item, max(s0) as b0, arg_max(v, (s0, -v)) as v0, max(s1) as b1,
    arg_max(v, (s1, -v)) as v1 from pv group by all),
    z as (select *, (b0 - avg(b0) over w) / stddev_pop(b0) over w * 6e-1 as c0,
          (b1 - avg(b1) over w) / stddev_pop(b1) over w * 4e-1 as c1 from m window w as (partition by qid))
    select * from (select qid, item, round(c0 + c1, 12) as score, case when c1 > c0 then v1 else v0 end as variant,
    row_number() over (partition by qid order by round(c0 + c1, 12) desc, item) as rank from z) where rank <= 5""",
       real="score", whole="variant")
def _(src):
    return R.ensemble_top_k(_queries(src, 2, 3), _bank(src, 2), 5, [3.0, 2.0], variants=3)


@query("A32_contrastive_loss", "embeds", f"""with {_RANK}, k as (select * from ({_TOP} p) where rank <= 5),
    s as (select r.qid, truth_score / 7e-2 as s, true as pos from r union all
          select k.qid, score / 7e-2, false from k join r on r.qid = k.qid where k.item <> r.truth)
    select qid, ln(sum(exp(s))) - max(s) filter (where pos) as loss from s group by qid""", real="loss")
def _(src):
    q, b = _queries(src, truth=True), _bank(src)
    t = R.truth_rank(q, b)
    neg = R.top_k(q.drop("truth"), b, 5).join(t, "qid").where(F.col("item") != F.col("truth"))
    s = t.select("qid", F.col("truth_score").alias("score"), F.lit(True).alias("positive")).unionByName(
        neg.select("qid", "score", F.lit(False).alias("positive")))
    return R.info_nce(s, 0.07)


@query("Q21_candidate_cache", "embeds", f"""with {_RANK}, k as (select * from ({_TOP} p) where rank <= 5),
    f as (select k.qid, truth, rank - 1 as slot, case when rank = 5 and not exists (select 1 from k k2 where k2.qid = k.qid
          and k2.item = truth) then truth else item end as item from k join r on r.qid = k.qid)
    select *, row_number() over (partition by qid order by (item * 7919 + qid * 104729) % 1000003, item) - 1 as shuffled
    from f""", whole="slot")
def _(src):
    q, b = _queries(src, truth=True), _bank(src)
    return R.forced_truth(R.top_k(q.drop("truth"), b, 5), q.select("qid", "truth"), 5, F.col("qid"))


# ---- quality reports ---------------------------------------------------------------------------------------

_SUM = """count(position_error) as n, avg(position_error) as mean_error, max(position_error) as max_error,
    avg((position_error < 5e-1)::int) as below_0p5, avg((position_error < 1)::int) as below_1,
    count(*) filter (where position_error >= 5e-1) as at_least_0p5,
    quantile_cont(position_error, 5e-1) as median_error, quantile_cont(position_error, 95e-2) as p95_error"""
_SUM_REAL = "mean_error max_error below_0p5 below_1 median_error p95_error"


@query("A6_error_summary", "frames", f"select split, {_SUM} from frames group by split", real=_SUM_REAL)
def _(src):
    return M.error_summary(src.frames, "split", "position_error")


@query("A7_two_level_report", "frames", f"""select coalesce(cast(sequence as varchar), 'combined') as sequence, {_SUM}
    from frames group by grouping sets ((sequence), ())""", real=_SUM_REAL)
def _(src):
    return M.error_summary(M.with_combined(src.frames, "sequence"), "sequence", "position_error")


@query("A17_safe_correlation", "frames", """select sequence, corr(position_error, person_ratio) as person_corr,
    null::double as constant_corr from frames group by sequence""", real="person_corr constant_corr", whole="sequence")
def _(src):
    f = src.frames.withColumn("c", F.lit(1.0))
    return f.groupBy("sequence").agg(M.safe_correlation("position_error", "person_ratio").alias("person_corr"),
                                     M.safe_correlation("position_error", "c").alias("constant_corr"))


@query("A18_regression_quality", "frames", """select split, count(*) as n, avg(abs(person_ratio - semi_ratio)) as mae,
    sqrt(avg(pow(person_ratio - semi_ratio, 2))) as rmse, corr(person_ratio, semi_ratio) as pearson
    from frames group by split""", real="mae rmse pearson")
def _(src):
    return M.regression_report(src.frames, "split", "person_ratio", "semi_ratio")


_SWEEP = """with s as (select t as threshold, count(*) filter (where semi_ratio >= t and position_error >= 2e-1) as tp,
    count(*) filter (where semi_ratio >= t and position_error < 2e-1) as fp,
    count(*) filter (where semi_ratio < t and position_error >= 2e-1) as fn
    from frames, (select unnest([5e-2, 1e-1, 15e-2, 2e-1]) as t) x group by t),
    m as (select *, tp / greatest(tp + fp, 1) as precision, tp / greatest(tp + fn, 1) as recall from s),
    f as (select *, 2 * precision * recall / greatest(precision + recall, 1e-8) as f1 from m)"""


def _sweep(src):
    f = src.frames.withColumn("bad", F.col("position_error") >= 0.2)
    return M.threshold_sweep(f, "semi_ratio", "bad", [0.05, 0.1, 0.15, 0.2])


@query("A19_threshold_sweep", "frames", f"{_SWEEP} select * from f", real="threshold precision recall f1")
def _(src):
    return _sweep(src)


@query("A19_best_threshold", "frames", f"{_SWEEP} select * from f order by f1 desc, threshold limit 1",
       real="threshold precision recall f1")
def _(src):
    return M.best_threshold(_sweep(src))


_LAB = "l as (select *, position_error >= 2e-1 as bad, round(semi_ratio + position_error / 10, 3) as score from frames)"


def _scored(src):
    return src.frames.withColumns({"bad": F.col("position_error") >= 0.2,
                                   "score": F.round(F.col("semi_ratio") + F.col("position_error") / 10, 3)})


@query("A20_ranking_quality", "frames", f"""with {_LAB}, c as (select score, count(*) filter (where bad) as p,
    count(*) filter (where not bad) as q from l group by score),
    r as (select *, sum(p) over w as cp, sum(q) over w as cq, sum(p) over () as tp, sum(q) over () as tq from c
          window w as (order by score desc))
    select sum(p) as positives, sum(q) as negatives, sum(p / tp * cp / (cp + cq)) as average_precision,
           sum(p * (tq - cq + q * 5e-1) / (tp * tq)) as roc_auc from r""", real="average_precision roc_auc",
       whole="positives negatives")
def _(src):
    return M.ranking_quality(_scored(src), "score", "bad")


@query("A20_alarm_budgets", "frames", f"""with {_LAB}, r as (select *, row_number() over (order by score desc, event_id) as rn,
    count(*) over () as n from l), b as (select f as fraction, cast(greatest(1, round_even(n * f, 0)) as bigint) as alarms,
    count(*) filter (where bad and rn <= greatest(1, round_even(n * f, 0))) as true_positives, count(*) filter (where bad) as p
    from r, (select unnest([2e-2, 5e-2, 1e-1]) as f) x group by all)
    select fraction, alarms, true_positives, true_positives / p as recall, true_positives / alarms as precision from b""",
       real="fraction recall precision")
def _(src):
    return M.alarm_budgets(_scored(src), "score", [F.col("event_id")], "bad", [0.02, 0.05, 0.10])


@query("W20_alarm_list", "frames", f"""with {_LAB}, r as (select *, row_number() over (order by score desc, event_id) as alarm_rank,
    count(*) over () as n from l) select sequence, frame_idx, patch_id, score, alarm_rank from r
    where alarm_rank <= greatest(1, round_even(n * 5e-2, 0))""", real="score", whole="sequence frame_idx patch_id")
def _(src):
    return M.alarms(_scored(src), "score", [F.col("event_id")], 0.05).select(
        "sequence", "frame_idx", "patch_id", "score", "alarm_rank")


@query("W21_recall_curve", "frames", f"""with {_LAB} select event_id,
    row_number() over w / count(*) over () as budget, sum(bad::int) over w / greatest(sum(bad::int) over (), 1) as recall
    from l window w as (order by score desc, event_id rows unbounded preceding)""", real="budget recall")
def _(src):
    return M.recall_curve(_scored(src).select("event_id", "score", "bad"), "score", [F.col("event_id")], "bad").drop("score", "bad")


@query("A27_quartile_contrast", "frames", """with q as (select quantile_cont(semi_ratio, 25e-2) as q1,
    quantile_cont(semi_ratio, 75e-2) as q3 from frames)
    select max(q1) as q1, max(q3) as q3, count(*) filter (where semi_ratio <= q1) as low_n,
    count(*) filter (where semi_ratio >= q3) as high_n, avg(position_error) filter (where semi_ratio <= q1) as low_mean,
    avg(position_error) filter (where semi_ratio >= q3) as high_mean from frames, q""", real="q1 q3 low_mean high_mean")
def _(src):
    return M.quartile_contrast(src.frames, "semi_ratio", "position_error")


@query("A28_category_counts", "frames", """select split, event_type, count(*) as frames, count(distinct patch_id) as patches
    from frames group by all""")
def _(src):
    return src.frames.groupBy("split", "event_type").agg(F.count("*").alias("frames"),
                                                         F.count_distinct("patch_id").alias("patches"))


@query("A28_most_common", "frames", """select * from (select *, row_number() over
    (partition by sequence order by n desc, patch_id) as rank
    from (select sequence, patch_id, count(*) as n from frames group by all)) where rank <= 3""",
       whole="sequence patch_id")
def _(src):
    from spoorgrid.operators.chunks import top_n

    c = src.frames.groupBy("sequence", "patch_id").agg(F.count("*").alias("n"))
    return top_n(c, ["sequence"], [F.desc("n"), F.col("patch_id")], 3)


@query("A29_permutation_test")
def _(src):
    f = src.frames.withColumn("bad", F.col("position_error") >= 0.2)
    return M.permutation_test(f, "semi_ratio", "bad", trials=20000)


@query("A29_observed_difference", "frames", """select avg(semi_ratio) filter (where position_error >= 2e-1)
    - avg(semi_ratio) filter (where position_error < 2e-1) as mean_difference from frames""", real="mean_difference")
def _(src):
    f = src.frames.withColumn("bad", F.col("position_error") >= 0.2)
    return M.permutation_test(f, "semi_ratio", "bad", trials=1).select("mean_difference")


@query("A31_ratio_prediction", "frames", """select split, avg(abs(person_ratio - semi_ratio)) as mae,
    sqrt(avg(pow(person_ratio - semi_ratio, 2))) as rmse,
    count(*) filter (where person_ratio >= 1e-1 and semi_ratio >= 1e-1) / greatest(count(*) filter (where person_ratio >= 1e-1), 1)
        as precision,
    count(*) filter (where person_ratio >= 1e-1 and semi_ratio >= 1e-1) / greatest(count(*) filter (where semi_ratio >= 1e-1), 1)
        as recall from frames group by split""", real="mae rmse precision recall")
def _(src):
    p, t = F.col("person_ratio") >= 0.1, F.col("semi_ratio") >= 0.1
    d = F.col("person_ratio") - F.col("semi_ratio")
    one = F.lit(1)
    return src.frames.groupBy("split").agg(
        F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"),
        (F.count_if(p & t) / F.greatest(F.count_if(p), one)).alias("precision"),
        (F.count_if(p & t) / F.greatest(F.count_if(t), one)).alias("recall"))


@query("A33_matcher_quality", "candidates", """with b as (select event_id, arg_max(cand, (deep_match_probability, -cand)) as pick,
    arg_max(cand, (-(pow(x - gt_x, 2) + pow(y - gt_y, 2)), -cand)) as truth from candidates group by event_id)
    select avg((pick = truth)::int) as accuracy, avg((abs(pred_x - gt_x) + abs(pred_y - gt_y) + abs(pred_yaw - gt_yaw)) / 3)
    as mean_l1 from b join candidates c on c.event_id = b.event_id and c.cand = b.truth""", real="accuracy mean_l1")
def _(src):
    from spoorgrid.operators.decisions import first_best

    c = src.candidates
    d2 = F.pow(F.col("x") - F.col("gt_x"), 2) + F.pow(F.col("y") - F.col("gt_y"), 2)
    l1 = (F.abs(F.col("pred_x") - F.col("gt_x")) + F.abs(F.col("pred_y") - F.col("gt_y")) + F.abs(F.col("pred_yaw") - F.col("gt_yaw"))) / 3
    per = c.withColumns({"_d2": -d2, "_l1": l1}).groupBy("event_id").agg(
        first_best("cand", "deep_match_probability").alias("pick"), first_best("cand", "_d2").alias("truth"),
        first_best("_l1", "_d2").alias("l1"))
    return per.agg(F.avg((F.col("pick") == F.col("truth")).cast("double")).alias("accuracy"), F.avg("l1").alias("mean_l1"))
