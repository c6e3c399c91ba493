"""Queries for evaluation metrics, on scores that follow from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunestrata.operators import metrics as mt
from tunestrata.operators import recommend as rc
from tunestrata.plans import fixtures as fx
from tunestrata.plans.registry import query

#: Songs in one row of a list.
LIST_CHUNK = 100_000


def areas_sql(table: str, score: str, label: str) -> str:
    """Both areas from cumulative counts over the distinct scores."""
    return f"""
        with c as (select {score} as score, count(*) filter (where {label} = 1)::double as pos,
                          count(*) filter (where {label} <> 1)::double as neg
                   from {table} group by 1),
             w as (select *, sum(pos) over o as tp, sum(neg) over o as fp from c
                   window o as (order by score desc)),
             v as (select *, lag(tp, 1, 0) over o as tp0, lag(fp, 1, 0) over o as fp0 from w
                   window o as (order by score desc))
        select round(sum((fp - fp0) * (tp + tp0) / 2) / (sum(pos) * sum(neg)), 6) as auroc,
               round(sum((tp - tp0) * (tp / (tp + fp) +
                     case when tp0 + fp0 = 0 then tp / (tp + fp) else tp0 / (tp0 + fp0) end) / 2) / sum(pos), 6) as aupr
        from v"""


def _rounded(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, 6) for c in doubles})


@query(areas_sql("judged", "score", "label"))
def areas_distinct_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.binary_areas(fx.judged(spark, sf_dir), score="score"))


@query(areas_sql("judged", "l_quantity", "label"))
def areas_tied_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.binary_areas(fx.judged(spark, sf_dir), score="l_quantity"))


@query(areas_sql("binary_tagged", "f1", "case when genres = 'Electronic' then 1 else 0 end"))
def areas_of_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.binary_tagged(spark, sf_dir).select(
        "f1", F.when(F.col("genres") == "Electronic", 1.0).otherwise(0.0).alias("label")
    )
    return _rounded(mt.binary_areas(rows, score="f1"))


@query(
    f"select auroc from ({areas_sql('judged', 'score', 'label')}) a"
)
def area_under_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.area_under_roc(fx.judged(spark, sf_dir), score="score"))


@query(
    f"select aupr from ({areas_sql('judged', 'score', 'label')}) a"
)
def area_under_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.area_under_pr(fx.judged(spark, sf_dir), score="score"))


@query(
    """select count(*) filter (where label = 1 and prediction = 1) as tp,
              count(*) filter (where label = 0 and prediction = 0) as tn,
              count(*) filter (where label = 1 and prediction = 0) as fn,
              count(*) filter (where label = 0 and prediction = 1) as fp from judged"""
)
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.confusion_counts(fx.judged(spark, sf_dir))


@query("select label, prediction, count(*) as n from judged_classes group by label, prediction")
def confusion_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.confusion_cells(fx.judged_classes(spark, sf_dir))


@query(
    "select label, "
    + ", ".join(f"count(*) filter (where prediction = {i}) as p{i}" for i in range(4))
    + """, 0::bigint as other
         from (select distinct prediction as label from judged_classes) c
         left join (select label as actual, prediction from judged_classes) j on label = actual group by label"""
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.confusion_matrix(mt.confusion_cells(fx.judged_classes(spark, sf_dir)), [0, 1, 2, 3])


def per_class_sql(table: str) -> str:
    return f"""
        select class, actual, case when said = 0 then 0 else tp / said end as precision,
               case when actual = 0 then 0 else tp / actual end as recall,
               case when actual + said = 0 then 0 else 2.0::double * tp / (actual + said) end as f1
        from (select class, (select count(*) from {table} where label = class) as actual,
                     (select count(*) from {table} where prediction = class)::double as said,
                     (select count(*) from {table} where label = class and prediction = class)::double as tp
              from (select label as class from {table} union select prediction from {table}) c) s"""


@query(
    f"select class, actual, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from ({per_class_sql('judged_classes')}) p"
)
def per_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.per_class_metrics(mt.confusion_cells(fx.judged_classes(spark, sf_dir))))


@query(
    f"""select (select round(avg(case when label = prediction then 1.0::double else 0.0::double end), 6)
                from judged_classes) as accuracy,
               round(sum(precision * actual) / sum(actual), 6) as weighted_precision,
               round(sum(recall * actual) / sum(actual), 6) as weighted_recall,
               round(sum(f1 * actual) / sum(actual), 6) as weighted_f1
        from ({per_class_sql('judged_classes')}) p"""
)
def overall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.overall_metrics(mt.confusion_cells(fx.judged_classes(spark, sf_dir))))


def report_sql(table: str, score: str) -> str:
    """The whole report; its first CTE may be put after others."""
    return f"""
        p as ({per_class_sql(table)}), a as ({areas_sql(table, score, 'label')})
        select 'accuracy' as metric, null::double as class,
               round(avg(case when label = prediction then 1.0::double else 0.0::double end), 6) as value from {table}
        union all select 'weighted_precision', null, round(sum(precision * actual) / sum(actual), 6) from p
        union all select 'weighted_recall', null, round(sum(recall * actual) / sum(actual), 6) from p
        union all select 'weighted_f1', null, round(sum(f1 * actual) / sum(actual), 6) from p
        union all select 'precision', class, round(precision, 6) from p
        union all select 'recall', class, round(recall, 6) from p
        union all select 'f1', class, round(f1, 6) from p
        union all select concat('confusion_as_', cast(cast(prediction as int) as varchar)), label, count(*)::double
                  from {table} group by label, prediction
        union all select 'auroc', null, auroc from a
        union all select 'aupr', null, aupr from a"""


@query("with " + report_sql("judged", "score"))
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.classification_report(fx.judged(spark, sf_dir), score="score"))


@query(
    """select round(sqrt(avg((plays - prediction) * (plays - prediction))), 6) as rmse, count(*) as n_rows
       from scored where not isnan(prediction)"""
)
def rmse_of_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mt.rmse(fx.scored(spark, sf_dir), "plays"))


# ---- ranking ----------------------------------------------------------------

_LISTS = """
    ranked as (select user_id, song_id,
                      rank() over (partition by user_id order by prediction desc) as rp,
                      row_number() over (partition by user_id order by prediction desc, song_id) as position,
                      rank() over (partition by user_id order by plays desc) as ra
               from scored where not isnan(prediction)),
    lists as (select user_id, song_id, case when rp <= 10 then position end as position, ra <= 10 as relevant
              from ranked where rp <= 10 or ra <= 10)"""

_BY_USER = f"""
    {_LISTS},
    hits as (select *, relevant and position is not null as hit,
                    count(*) filter (where relevant and position is not null)
                        over (partition by user_id order by position nulls last, song_id) as so_far
             from lists),
    by_user as (select user_id,
                       count(*) filter (where hit and position <= 5) / 5.0::double as precision_at_k,
                       coalesce(sum(case when hit and position <= 10 then 1.0::double / ln(position + 1) end), 0)
                           / (select sum(1.0::double / ln(i + 1)) from range(1, 11) t(i)
                              where i <= count(*) filter (where relevant)) as ndcg_at_k,
                       coalesce(sum(case when hit then so_far::double / position end), 0)
                           / count(*) filter (where relevant) as average_precision
                from hits group by user_id)"""


@query(f"with {_LISTS} select * from lists")
def ranking_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.ranking_rows(fx.scored(spark, sf_dir), "prediction", "plays", 10)


@query(
    f"""with {_LISTS}
        select user_id, 'predicted' as list, position as place, song_id from lists where position is not null
        union all
        select user_id, 'actual', row_number() over (partition by user_id order by ra, song_id), song_id
        from ranked where ra <= 10"""
)
def ranking_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fx.scored(spark, sf_dir)
    pairs = rc.ranking_pairs(scored, "prediction", "plays", 10, LIST_CHUNK)
    both = F.array(
        F.struct(F.lit("predicted").alias("list"), F.col("predicted_songs").alias("songs")),
        F.struct(F.lit("actual").alias("list"), F.col("actual_songs").alias("songs")),
    )
    return pairs.select("user_id", "chunk", F.inline(both)).select(
        "user_id", "chunk", "list", F.posexplode("songs").alias("i", "song_id")
    ).select(
        "user_id",
        "list",
        (F.col("chunk") * F.lit(LIST_CHUNK) + F.col("i") + 1).cast("bigint").alias("place"),
        "song_id",
    )


@query(
    f"""with {_BY_USER}
        select user_id, round(precision_at_k, 6) as precision_at_k, round(ndcg_at_k, 6) as ndcg_at_k,
               round(average_precision, 6) as average_precision from by_user"""
)
def ranking_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fx.scored(spark, sf_dir)
    rows = mt.ranking_rows(scored, "prediction", "plays", 10)
    return _rounded(mt.ranking_by_user(rows))


@query(
    f"""with {_BY_USER}
        select round(avg(precision_at_k), 6) as precision_at_k, round(avg(ndcg_at_k), 6) as ndcg_at_k,
               round(avg(average_precision), 6) as mean_average_precision, count(*) as n_users from by_user"""
)
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fx.scored(spark, sf_dir)
    rows = mt.ranking_rows(scored, "prediction", "plays", 10)
    return _rounded(mt.ranking_metrics(rows))
