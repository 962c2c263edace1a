"""The four jobs as compositions of operators. Each returns its result tables as DataFrames; writing
them is the caller's one action a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from behavex.operators import ads, categories, funnel, products, sessions
from behavex.params import TaskParams


def session_job(actions: DataFrame, users: DataFrame, params: TaskParams, sample: int = 100) -> dict[str, DataFrame]:
    actions = sessions.in_dates(actions, params)
    chosen = sessions.matching(sessions.aggregate(actions, users), params).persist()  # every result reads it; the caller may unpersist
    mine = actions.join(chosen.select("session_id"), "session_id", "left_semi")
    picked = sessions.stratified_sample(chosen, sample)
    top = categories.top(categories.counts(mine))
    best = categories.top_sessions(mine, top)
    return {
        "session_aggr_stat": sessions.ratios(sessions.histogram(chosen)),
        "session_random_extract": picked,
        "session_detail": sessions.detail(actions, picked),
        "top10_category": top,
        "top10_category_session": best,
        "top10_session_detail": best.select("session_id").join(sessions.detail(actions, best), "session_id"),
    }


def page_job(actions: DataFrame, params: TaskParams) -> dict[str, DataFrame]:
    rates = funnel.convert_rates(sessions.in_dates(actions, params), params.targetpageflow or [])
    return {"page_convert_rate": funnel.as_text(rates)}


def area_job(actions: DataFrame, cities: DataFrame, items: DataFrame, params: TaskParams) -> dict[str, DataFrame]:
    counted = products.area_clicks(products.clicks(sessions.in_dates(actions, params)), cities)
    return {"area_top3_product": products.top_products(products.with_product(counted, items))}


def ad_job(clicks: DataFrame, blacklist: DataFrame) -> dict[str, DataFrame]:
    """The streaming job's tables for a finished set of clicks."""
    good = ads.allowed(clicks, blacklist)
    stat = ads.stat(good)
    return {"ad_user_click_count": ads.user_daily(good), "ad_stat": stat, "ad_province_top3": ads.province_top(stat), "ad_click_trend": ads.trend(clicks)}
